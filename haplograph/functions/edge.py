"""Geometry of edges: frames, extensions and canonical direction, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_positions(type1: Column, type2: Column, ord_: Column, pos1: Column, pos2: Column, length: dict[str, Column]) -> tuple[Column, Column]:
    """Positions pos3 and pos4 of an overlap seen from the other strand.

    length: a0, a1, a2 the lengths of read 1 as a single read and of its mates; b0, b1, b2 of read 2.
    """
    ss, sp, ps = (type1 == "s") & (type2 == "s"), (type1 == "s") & (type2 == "p"), (type1 == "p") & (type2 == "s")
    pos3 = (
        F.when(ss, length["a0"] - pos1 - length["b0"])
        .when(sp, length["a0"] - pos2 - length["b2"])
        .when(ps, length["a2"] + pos2 - length["b0"])
        .when(ord_ == "1", length["a2"] - pos2 - length["b2"])
        .otherwise(length["a2"] + pos2 - length["b2"])
    )
    pos4 = F.when(ss, F.lit(0)).when(sp, length["a0"] - pos1 - length["b1"]).when(ps, length["b0"] + pos1 - length["a1"]).otherwise(length["a1"] - pos1 - length["b1"])
    return pos3, pos4


def nonoverlap_length(len1: Column, len2: Column, overlap: Column) -> Column:
    return len1 + len2 - 2 * overlap


def extension(forward: bool, type1: Column, type2: Column, ord_: Column, pos1: Column, pos2: Column, len1: Column, len2: Column, first: Column, second: Column, total: Column) -> Column:
    """Bases by which read 2 extends read 1 forward, or read 1 extends read 2 backward.

    first, second: lengths of read 2's mates in its orientation; total: its whole length.
    """
    pp, ss, sp = (type1 == "p") & (type2 == "p"), (type1 == "s") & (type2 == "s"), (type1 == "s") & (type2 == "p")
    zero = F.lit(0)
    if not forward:
        return F.when(pp & (ord_ == "1"), pos1).otherwise(pos1 + pos2)
    return (
        F.when((pp & (ord_ == "1")) | ss, F.greatest(total - len1 - len2, zero))
        .when(pp, F.greatest(first - len1, zero) + F.greatest(second - pos2 - len2, zero))
        .when(sp, F.greatest(F.greatest(first - len1, zero), F.greatest(second - len2, zero)))
        .otherwise(F.greatest(total - pos2 - len2, zero))
    )


def flipped(edges: DataFrame) -> DataFrame:
    """Every edge seen from the other strand, in canonical direction.

    Columns v1, v2, pos1..pos4, ori1, ori2 (booleans) and ord. Positions swap frames and
    orientations turn; if read 2 now leads (or both start together and v1 is larger) the reads
    swap too. A paired edge's second position keeps its sign in ord.
    """
    swap = (F.col("pos3") < 0) | ((F.col("pos3") == 0) & (F.col("v1") > F.col("v2")))
    paired = F.col("ord") != "-"
    turned = F.col("pos4") < 0
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return edges.select(
        either("v1", "v2").alias("v1"),
        either("v2", "v1").alias("v2"),
        F.abs("pos3").alias("pos1"),
        F.abs("pos4").alias("pos2"),
        F.col("pos1").alias("pos3"),
        F.col("pos2").alias("pos4"),
        F.when(swap, ~F.col("ori2")).otherwise(~F.col("ori1")).alias("ori1"),
        F.when(swap, ~F.col("ori1")).otherwise(~F.col("ori2")).alias("ori2"),
        F.when(swap, F.when(turned, F.lit("1")).when(paired, F.lit("2")).otherwise("-")).otherwise(F.when(turned, F.lit("2")).when(paired, F.lit("1")).otherwise("-")).alias("ord"),
    )


def overlap_percent(kind: str, length: Column, a: Column, b: Column) -> Column:
    """Percent of an overlap: fno floors over the larger share, sfo rounds over the shorter read, blast rounds over the larger share."""
    if kind == "fno":
        return F.floor(100 * F.greatest(length / a, length / b)).cast("int")
    if kind == "sfo":
        return F.least(F.round(100 * length / F.least(a, b)), F.lit(100)).cast("int")
    return F.least(F.round(100 * F.greatest(length / a, length / b)), F.lit(100)).cast("int")
