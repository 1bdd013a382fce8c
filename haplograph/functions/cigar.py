"""Alignment flags and CIGAR strings as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(flag: Column) -> Column:
    """The powers of two set in a flag, ascending."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda b: F.pow(F.lit(2), b).cast("int")), lambda p: flag.bitwiseAND(p) != 0)


def tokens(cigar: Column) -> Column:
    """array<struct<n: int, op: string>> of a CIGAR."""
    number = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1)
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    return F.arrays_zip(F.transform(number, lambda x: x.cast("int")).alias("n"), op.alias("op"))


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment covers, clips counted as the position adjustment counts them."""
    return F.aggregate(tokens(cigar), F.lit(0), lambda a, t: a + F.when(t["op"] == "I", 0).otherwise(t["n"]))


def clip_adjusted(pos: Column, cigar: Column, seq: Column) -> tuple[Column, Column]:
    """Position moved left over a leading clip, and the sequence with hard-clipped ends as N."""
    first, last = F.element_at(tokens(cigar), 1), F.element_at(tokens(cigar), -1)
    front = F.when(first["op"].isin("S", "H"), first["n"]).otherwise(0)
    pad = F.when(first["op"] == "H", F.repeat(F.lit("N"), first["n"])).otherwise("")
    back = F.when(last["op"] == "H", F.repeat(F.lit("N"), last["n"])).otherwise("")
    return pos - front, F.concat(pad, seq, back)


def _walk(cigar: Column, most: Column) -> Column:
    """struct<seq, ref>: read and reference bases of the CIGAR's elements that begin before a reference length."""
    start = F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("p"))

    def step(a: Column, t: Column) -> Column:
        take = F.least(t["n"].cast("long"), most - a["p"])
        on = a["p"] < most
        return F.struct(
            (a["seq"] + F.when(on & (t["op"] != "D"), take).otherwise(0)).cast("long").alias("seq"),
            (a["ref"] + F.when(on & (t["op"] != "I"), take).otherwise(0)).cast("long").alias("ref"),
            (a["p"] + F.when(on & (t["op"] != "I"), t["n"]).otherwise(0)).cast("long").alias("p"),
        )

    return F.aggregate(tokens(cigar), start, step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def overlap_position(pos_front: Column, pos_back: Column, cigar_front: Column, cigar_back: Column) -> Column:
    """Where the back read starts within the front read, corrected for indels; -1 without an overlap."""
    apart = (pos_back - pos_front).cast("long")

    def place(front: Column, back: Column) -> Column:
        back_ref = front["ref"] - apart
        at = apart - ((front["ref"] - front["seq"]) - (back_ref - back["seq"]))
        return F.when((front["ref"] <= apart) | (at < 0), F.lit(-1).cast("long")).otherwise(at)

    walked = lambda front: _let(front["ref"] - apart, lambda most: _let(_walk(cigar_back, most), lambda back: place(front, back)))
    return _let(apart + reference_length(cigar_back), lambda most: _let(_walk(cigar_front, most), walked))
