"""Overlaps between new reads, induced from edges and from shared originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _placed(pairs: DataFrame) -> DataFrame:
    """(id1, id2, pos, len, perc) from a, b with lengths la, lb and delta, the start of b in a's frame."""
    turn = F.col("delta") < 0
    pos = F.abs("delta")
    lead = F.when(turn, F.col("lb")).otherwise(F.col("la"))
    length = F.least(lead - pos, F.col("la"), F.col("lb"))
    out = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("id1"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("id2"), pos.alias("pos"), length.alias("len"), "la", "lb", *[c for c in pairs.columns if c.startswith("_")])
    return out.where("len > 0").withColumn("perc", F.floor(100 * F.greatest(F.col("len") / F.col("la"), F.col("len") / F.col("lb"))).cast("long")).drop("la", "lb")


def from_edges(edges: DataFrame, bridge: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id1, id2, pos, len, perc) between the superreads that hold an edge's two nodes.

    edges (v1, v2, pos); bridge (node, sr, off): where a node lies in a superread, with a row of
    its own for a node in none; lengths (sr, length). One formula covers all cases: the start of
    v2's superread in the frame of v1's is off(v1) + pos - off(v2). Of several edges between two
    superreads the least (v1, v2) decides.
    """
    a = bridge.withColumnsRenamed({"node": "v1", "sr": "a", "off": "off_a"})
    b = bridge.withColumnsRenamed({"node": "v2", "sr": "b", "off": "off_b"})
    e = edges.select("v1", "v2", "pos").join(a, "v1").join(b, "v2").where("a <> b")
    first = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("v1", "v2", "a", "b")
    e = e.withColumn("r", F.row_number().over(first)).where("r = 1")
    e = e.join(lengths.withColumnsRenamed({"sr": "a", "length": "la"}), "a").join(lengths.withColumnsRenamed({"sr": "b", "length": "lb"}), "b")
    return _placed(e.select("a", "b", "la", "lb", (F.col("off_a") + F.col("pos") - F.col("off_b")).alias("delta")))


def from_shared(subreads: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id1, id2, pos, len, perc) between reads that share an original, placed by the least one they share.

    subreads (read_id, orig_id, idx); lengths (read_id, length).
    """
    s = subreads.select("read_id", "orig_id", "idx")
    j = s.select(F.col("read_id").alias("a"), "orig_id", F.col("idx").alias("ia")).join(s.select(F.col("read_id").alias("b"), "orig_id", F.col("idx").alias("ib")), "orig_id").where("a < b")
    least = j.groupBy("a", "b").agg(F.min_by(F.col("ia") - F.col("ib"), "orig_id").alias("delta"))
    least = least.join(lengths.withColumnsRenamed({"read_id": "a", "length": "la"}), "a").join(lengths.withColumnsRenamed({"read_id": "b", "length": "lb"}), "b")
    return _placed(least)


def around_inclusions(edges: DataFrame, included: DataFrame) -> DataFrame:
    """(v1, v2, pos): edges u -> v through an included vertex x (u -> x -> v) that are not there yet."""
    x = included.select(F.col("v").alias("x"))
    into = edges.select(F.col("v1"), F.col("v2").alias("x"), F.col("pos")).join(x, "x", "left_semi")
    out = edges.select(F.col("v1").alias("x"), F.col("v2")).join(x, "x", "left_semi")
    made = into.join(out, "x").where("v1 <> v2").groupBy("v1", "v2").agg(F.min("pos").alias("pos"))
    return made.join(edges.select("v1", "v2"), ["v1", "v2"], "left_anti")


def left_out(overlaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Overlaps (id1, id2) that are not edges in either direction."""
    both = edges.select(F.col("v1").alias("id1"), F.col("v2").alias("id2")).union(edges.select(F.col("v2").alias("id1"), F.col("v1").alias("id2")))
    return overlaps.join(both, ["id1", "id2"], "left_anti")
