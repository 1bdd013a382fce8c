"""Layouts, consensus sequences and lineage of read groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.buffers import string_buffers
from .graph import dense_rank_of
from .overlap import log_chances

#: Order in which equal posteriors are decided.
TIE_ORDER = "ATCG"


def layout(members: DataFrame) -> DataFrame:
    """Adds at (shifted so that the group's least is 0) and total: members (group, read_id, offset, length)."""
    w = Window.partitionBy("group")
    return members.withColumns({"at": F.col("offset") - F.min("offset").over(w), "total": F.max(F.col("offset") + F.col("length")).over(w) - F.min("offset").over(w)})


def downsample(members: DataFrame, k: int) -> DataFrame:
    """Members of groups of more than 3k: the k leftmost, then those that end furthest right, 2k in all."""
    g = Window.partitionBy("group")
    m = members.withColumns({"n": F.count("*").over(g), "from_left": F.row_number().over(g.orderBy("at", "read_id"))})
    m = m.withColumn("from_right", F.row_number().over(Window.partitionBy("group", F.col("from_left") <= k).orderBy(F.desc(F.col("at") + F.col("length")), "read_id")))
    return m.where((F.col("n") <= 3 * k) | (F.col("from_left") <= k) | (F.col("from_right") <= k)).drop("n", "from_left", "from_right")


def columns(members: DataFrame) -> DataFrame:
    """(group, pos, base, q): one row for each base of each member (group, at, seq, qual)."""
    m = members.select("group", "at", F.posexplode(F.arrays_zip(F.split("seq", "").alias("b"), F.split("qual", "").alias("q"))).alias("k", "c"))
    return m.select("group", (F.col("at") + F.col("k")).alias("pos"), F.col("c.b").alias("base"), (F.ascii("c.q") - 33).alias("q"))


def _log(x: Column) -> Column:
    """log10, minus infinity at or below 0 (where it would be null and vanish from a sum)."""
    return F.when(x <= 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def consensus_bases(cols: DataFrame, min_qual: float = 0.9) -> DataFrame:
    """(group, pos, base, depth, phred): the base of largest posterior in each column.

    Log likelihoods are summed for each base under a uniform prior; N rows count towards depth
    alone. N comes out where all are N, where no base is possible, or where a column of depth
    over 1 has a posterior below min_qual. Equal posteriors go by A, T, C, G.
    """
    p = F.pow(F.lit(10.0), -F.col("q") / 10.0)
    known = F.col("base") != "N"
    sums = [F.sum(F.when(known, _log(F.when(F.col("base") == b, 1 - p).otherwise(p / 3)))).alias(f"l{b}") for b in "ACGT"]
    s = cols.groupBy("group", "pos").agg(*sums, F.count("*").alias("depth"))
    top = F.greatest(*(F.col(f"l{b}") for b in "ACGT"))
    none = top.isNull() | (top == float("-inf"))
    weight = lambda b: F.pow(F.lit(10.0), F.col(f"l{b}") - F.col("top"))
    s = s.withColumn("top", top).withColumn("none", F.coalesce(none, F.lit(True)))
    total = weight("A") + weight("C") + weight("G") + weight("T")
    s = s.withColumn("err", F.when(F.col("none"), 1.0).otherwise((total - 1) / total))
    pick = F.coalesce(*(F.when(F.col(f"l{b}") == F.col("top"), b) for b in TIE_ORDER))
    base = F.when(F.col("none") | ((F.col("depth") > 1) & (1 - F.col("err") < min_qual)), "N").otherwise(pick)
    phred = F.when(F.col("err") < 10**-9.3, 93).otherwise(F.round(-10 * F.log10("err"))).cast("long")
    return s.select("group", "pos", base.alias("base"), "depth", F.when(base == "N", 0).otherwise(phred).cast("long").alias("phred"))


def consensus_sequences(bases: DataFrame, min_depth: int = 1) -> DataFrame:
    """(group, seq, length): bases in order of position, ends with less than min_depth cut; empty where a position is missing."""
    w = Window.partitionBy("group")
    good = F.when(F.col("depth") >= min_depth, F.col("pos"))
    b = bases.withColumns({"first": F.min(good).over(w), "last": F.max(good).over(w)}).where("pos >= first AND pos <= last")
    g = b.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    seq = F.when(F.length("seq") == F.col("span"), F.col("seq")).otherwise("")
    return g.select("group", seq.alias("seq"), F.length(seq).cast("long").alias("length"))


def superread_lineage(members: DataFrame, subreads: DataFrame) -> DataFrame:
    """(group, orig_id, idx, len): originals of a group's members, by the smallest member that holds each.

    members: (group, read_id, at); subreads: (read_id, orig_id, idx, len).
    """
    j = members.join(subreads, "read_id").withColumn("place", F.col("at") + F.col("idx"))
    first = Window.partitionBy("group", "orig_id").orderBy("read_id")
    return j.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("group", "orig_id", F.col("place").alias("idx"), "len")


def lineage_reversed(subreads: DataFrame, lengths: DataFrame) -> DataFrame:
    """Places of originals in the reverse complement of their read: subreads (read_id, orig_id, idx, len), lengths (read_id, length)."""
    return subreads.join(lengths, "read_id").select("read_id", "orig_id", (F.col("length") - F.col("len") - F.col("idx")).alias("idx"), "len")


def assign_new_ids(rows: DataFrame) -> DataFrame:
    """Adds new_id: dense from 0 by kind (s singles, t trivials, p pairs), then old id."""
    kind = F.expr("CASE kind WHEN 's' THEN 0 WHEN 't' THEN 1 ELSE 2 END")
    return dense_rank_of(rows.withColumn("_kind", kind).orderBy("_kind", "read_id"), "new_id").drop("_kind")


def _merge_batches(least: int, most: int | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, _ = log_chances(0.0)
        for batch in batches:
            (a, at_a), (qa, at_qa), (b, at_b), (qb, at_qb) = (string_buffers(batch.column(c)) for c in ("seq1", "qual1", "seq2", "qual2"))
            n1, n2 = np.diff(at_a), np.diff(at_b)
            longest = np.where((np.diff(at_qa) == n1) & (np.diff(at_qb) == n2), np.minimum(n1 - 1, n2), 0)
            if most is not None:
                longest = np.minimum(longest, most)
            merged = np.zeros(len(longest), np.int64)
            for overlap in range(max(least, 1), int(longest.max(initial=0)) + 1):
                left = np.flatnonzero((merged == 0) & (longest >= overlap))
                if not len(left):
                    continue
                k = np.arange(overlap)[:, None]
                x, y = a[at_a[left + 1] - overlap + k], b[at_b[left] + k]
                p, q = qa[at_qa[left + 1] - overlap + k].astype(np.int64) - 33, qb[at_qb[left] + k].astype(np.int64) - 33
                counts = (x != 78) & (y != 78)
                total = counts.sum(axis=0)
                log = np.where(counts, logs[(x == y).astype(np.int64), p, q], 0.0).sum(axis=0)
                good = (total > 0) & (np.exp(log / np.maximum(total, 1)) > threshold)
                merged[left[good]] = overlap
            out = pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(merged, pa.int32()), batch.column("seq1"), batch.column("seq2")], names=["pair_id", "overlap", "seq1", "seq2"])
            yield out.filter(pa.array(merged > 0))

    return run


def mate_merge(pairs: DataFrame, least: int = 15, most: int | None = None, threshold: float = 0.99) -> DataFrame:
    """(pair_id, overlap, seq): mates merged at their smallest overlap of at least `least` bases whose score passes.

    pairs (pair_id, seq1, qual1, seq2, qual2). Overlaps reach up to `most` bases, or to all of the second
    mate and all but one base of the first. The score is that of score_overlaps: columns with an N do not
    count. A batch's pairs are scored together, one overlap after another, until each has merged.
    """
    kind = dict(pairs.dtypes)["pair_id"]
    p = pairs.select("pair_id", "seq1", "qual1", "seq2", "qual2")
    found = p.mapInArrow(_merge_batches(least, most, threshold), f"pair_id {kind}, overlap int, seq1 string, seq2 string")
    return found.select("pair_id", "overlap", F.expr("concat(seq1, substring(seq2, overlap + 1))").alias("seq"))
