"""Overlaps: routing, scoring, classification, deduplication and dialects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.buffers import string_buffers


def route(overlaps: DataFrame, min_len: int, min_perc: int, relax: bool = False) -> DataFrame:
    """Adds route: score, nonedge (too short) or drop (long enough, but too small a share, or a self-overlap)."""
    single = (F.col("type1") == "s") & (F.col("type2") == "s")
    half = min_len / 2
    paired_ok = (F.col("len1") + F.col("len2") >= min_len) if relax else (F.col("len1") >= half) & (F.col("len2") >= half)
    long = F.when(single, F.col("len1") >= min_len).otherwise(paired_ok)
    perc = F.when(F.col("perc2") > 0, F.expr("(perc1 + perc2) div 2")).otherwise(F.col("perc1"))
    return overlaps.withColumn("route", F.when(F.col("id1") == F.col("id2"), "drop").when(~long, "nonedge").when(perc < min_perc, "drop").otherwise("score"))


def log_chances(least: float) -> tuple[np.ndarray, np.ndarray]:
    """(log probability, rejected) of columns, by (bases equal, Phred score of the one, of the other)."""
    error = 10.0 ** (-np.arange(94) / 10.0)
    p, q = error[:, None], error[None, :]
    chance = np.stack([p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9, (1 - p) * (1 - q) + p * q / 3])
    with np.errstate(divide="ignore"):
        return np.log(chance), chance < least


def _score_batches(n_own: int, names: list[str], min_read_len: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, rejected = log_chances(least)
        for batch in batches:
            (a, at_a), (qa, at_qa), (b, at_b), (qb, at_qb) = (string_buffers(batch.column(n_own + i)) for i in range(4))
            pos = batch.column(names.index("pos")).to_numpy(zero_copy_only=False).astype(np.int64)
            n1, n2 = np.diff(at_a), np.diff(at_b)
            fits = (pos >= 0) & (pos < n1) & (np.minimum(n1, n2) >= max(min_read_len, 1)) & (np.diff(at_qa) == n1) & (np.diff(at_qb) == n2)
            many = np.where(fits, np.minimum(n1 - pos, n2), 0)
            owner = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            x, y = a[(at_a[:-1] + pos)[owner] + k], b[at_b[:-1][owner] + k]
            p, q = qa[(at_qa[:-1] + pos)[owner] + k].astype(np.int64) - 33, qb[at_qb[:-1][owner] + k].astype(np.int64) - 33
            counts = (x != 78) & (y != 78)
            same = (x == y).astype(np.int64)
            total = np.bincount(owner, counts, len(many))
            log = np.bincount(owner, np.where(counts, logs[same, p, q], 0.0), len(many))
            apart = np.bincount(owner, counts & (same == 0), len(many))
            bad = np.bincount(owner, counts & rejected[same, p, q], len(many)) > 0
            good = (total > 0) & ~bad
            score = np.where(good, np.exp(log / np.maximum(total, 1)), 0.0)
            mismatch = np.where(good, apart / np.maximum(total, 1), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(score), pa.array(mismatch)], names=[*names, "score", "mismatch"])

    return run


def score_overlaps(overlaps: DataFrame, reads: DataFrame, min_read_len: int = 0, mismatch: float = 0.0) -> DataFrame:
    """Adds score (geometric mean of the columns' probabilities) and mismatch (share of differing columns).

    An overlap's columns run from pos of the first read to the end of the shorter remainder.
    Columns with an N do not count. The score is 0 and the mismatch 1 where pos lies outside
    the first read, a read is shorter than min_read_len, a column is less probable than
    `mismatch`, or none counts. Both sides come in equi-joins; each row gives one row, whose
    columns numpy sums in the task that joined it.
    """
    r = reads.select("read_id", "seq", "qual")
    o = overlaps.join(r.withColumnsRenamed({"read_id": "id1", "seq": "_a", "qual": "_qa"}), "id1").join(r.withColumnsRenamed({"read_id": "id2", "seq": "_b", "qual": "_qb"}), "id2")
    names = overlaps.columns
    kinds = dict(o.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "score double", "mismatch double"])
    return o.select(*names, "_a", "_qa", "_b", "_qb").mapInArrow(_score_batches(len(names), names, min_read_len, mismatch), schema)


def combine_paired(score1, score2, mm1, mm2, edge_threshold: float):
    """(score, mismatch) of a paired overlap: the mean if both sides pass, else the smaller; the larger mismatch."""
    both = (score1 > edge_threshold) & (score2 > edge_threshold)
    return F.when(both, (score1 + score2) / 2).otherwise(F.least(score1, score2)), F.greatest(mm1, mm2)


def classify(scored: DataFrame, edge_threshold: float, ov_threshold: float, merge_contigs: float) -> DataFrame:
    """Adds class: edge, nonedge or drop."""
    edge = (F.col("score") > edge_threshold) | (F.col("mismatch") <= merge_contigs)
    return scored.withColumn("class", F.when(edge, "edge").when(F.col("score") > ov_threshold, "nonedge").otherwise("drop"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The best edge of each unordered pair and orientation class, after canonical direction.

    Columns v1, v2, ori1, ori2 (booleans), score, len, mismatch, pos1, pos2. Reads that start
    together are ordered by id first. Ties end with positions, so the choice is fixed.
    """
    swap = (F.col("pos1") == 0) & (F.col("v1") > F.col("v2"))
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in edges.columns if c not in ("v1", "v2", "ori1", "ori2")]
    own = edges.select(either("v1", "v2"), either("v2", "v1"), either("ori1", "ori2"), either("ori2", "ori1"), *rest)
    best = Window.partitionBy(F.least("v1", "v2"), F.greatest("v1", "v2"), F.col("ori1") == F.col("ori2")).orderBy(F.desc("score"), F.desc("len"), "mismatch", "v1", F.desc("ori1"), F.desc("ori2"), "pos1", "pos2")
    return own.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def crosstab(overlaps: DataFrame) -> DataFrame:
    """Counts by read types and orientations, with totals: one row for each type pair and one for all."""
    o = F.concat("ori1", "ori2")
    counts = [F.sum(F.when(o == x, 1).otherwise(0)).alias(name) for x, name in (("++", "pp"), ("+-", "pm"), ("-+", "mp"), ("--", "mm"))]
    return overlaps.withColumn("types", F.concat("type1", "type2")).rollup("types").agg(*counts, F.count("*").alias("total")).withColumn("types", F.coalesce("types", F.lit("all")))


# ---- dialects --------------------------------------------------------------------------------


def sfo_to_overlaps(sfo: DataFrame) -> DataFrame:
    """Overhang rows (id_a, id_b, ori N or I, oha, ohb, ola, olb) as single overlaps."""
    a_first = F.col("oha") >= 0
    len_a = F.col("ola") + F.when(a_first, F.col("oha") + F.greatest(-F.col("ohb"), F.lit(0))).otherwise(F.greatest(-F.col("ohb"), F.lit(0)))
    len_b = F.col("olb") + F.greatest(-F.col("oha"), F.lit(0)) + F.greatest(F.col("ohb"), F.lit(0))
    ori = F.when(F.col("ori") == "N", "+").otherwise("-")
    length = F.least("ola", "olb")
    perc = F.least(F.round(100 * length / F.least(len_a, len_b)), F.lit(100)).cast("long")
    return sfo.select(
        F.when(a_first, F.col("id_a")).otherwise(F.col("id_b")).alias("id1"),
        F.when(a_first, F.col("id_b")).otherwise(F.col("id_a")).alias("id2"),
        F.abs("oha").alias("pos1"),
        F.when(a_first, F.lit("+")).otherwise(ori).alias("ori1"),
        F.when(a_first, ori).otherwise("+").alias("ori2"),
        perc.alias("perc1"),
        length.alias("len1"),
    )


def sfo_normalize(sfo: DataFrame, singles: int, pairs: int) -> DataFrame:
    """Second mates fold to their pair's id; rows with the larger id first are turned round."""
    fold = lambda c: F.when(F.col(c) >= singles + pairs, F.col(c) - pairs).otherwise(F.col(c))
    s = sfo.withColumns({"a": fold("id_a"), "b": fold("id_b")})
    turn, normal = F.col("a") > F.col("b"), F.col("ori") == "N"
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return s.select(
        pick("a", "b").alias("id_a"),
        pick("b", "a").alias("id_b"),
        "ori",
        F.when(turn & normal, -F.col("oha")).when(turn, F.col("ohb")).otherwise(F.col("oha")).alias("oha"),
        F.when(turn & normal, -F.col("ohb")).when(turn, F.col("oha")).otherwise(F.col("ohb")).alias("ohb"),
        pick("ola", "olb").alias("ola"),
        pick("olb", "ola").alias("olb"),
    )


def _turned_sfo(rows: DataFrame, mismatch) -> DataFrame:
    """Orders ids as text, with the overhangs that go with it."""
    turn = F.col("qseqid") > F.col("sseqid")
    normal = F.col("ori") == "N"
    return rows.select(
        F.when(turn, F.col("sseqid")).otherwise(F.col("qseqid")).alias("id_a"),
        F.when(turn, F.col("qseqid")).otherwise(F.col("sseqid")).alias("id_b"),
        "ori",
        F.when(turn & normal, -F.col("oha")).when(turn, F.col("ohb")).otherwise(F.col("oha")).alias("oha"),
        F.when(turn & normal, -F.col("ohb")).when(turn, F.col("oha")).otherwise(F.col("ohb")).alias("ohb"),
        F.col("ola"),
        F.col("ola").alias("olb"),
        mismatch.alias("k"),
    )


def blast_to_sfo(blast: DataFrame, min_len: int) -> DataFrame:
    """Tabular alignments (ids as text, query forward) as overhang rows."""
    b = blast.where((F.col("qseqid") != F.col("sseqid")) & (F.col("length") >= min_len))
    forward = F.col("sstart") <= F.col("send")
    oha = F.when(forward, F.col("qstart") - F.col("sstart")).otherwise(F.col("qstart") - (F.col("slen") - F.col("sstart") + 1))
    ohb = F.when(forward, F.col("slen") - F.col("sstart") - (F.col("qlen") - F.col("qstart"))).otherwise(F.col("sstart") - (F.col("qlen") - F.col("qstart") + 1))
    return _turned_sfo(b.withColumns({"ori": F.when(forward, "N").otherwise("I"), "oha": oha, "ohb": ohb, "ola": F.col("length")}), F.col("mismatch"))


def paf_to_sfo(paf: DataFrame, min_len: int, min_identity: float) -> DataFrame:
    """Chained alignments with match counts as overhang rows; short or diverged ones go."""
    p = paf.where((F.col("length") >= min_len) & (F.col("matches") / F.col("length") >= min_identity))
    normal = F.col("qori") == "+"
    oha = F.when(normal, F.col("qstart") - F.col("sstart")).otherwise(F.col("qstart") - (F.col("slen") - F.col("send")))
    ohb = F.when(normal, F.col("slen") - F.col("sstart") - (F.col("qlen") - F.col("qstart"))).otherwise(F.col("send") - (F.col("qlen") - F.col("qstart")))
    p = p.withColumns({"ori": F.when(normal, "N").otherwise("I"), "oha": oha, "ohb": ohb})
    ola = F.when(F.col("oha") >= 0, F.least(F.col("qlen") - F.col("oha"), F.col("slen"))).otherwise(F.least(F.col("slen") + F.col("oha"), F.col("qlen")))
    return _turned_sfo(p.withColumn("ola", ola), F.col("length") - F.col("matches"))


def blast_to_overlaps(blast: DataFrame, min_len: int) -> DataFrame:
    """Tabular alignments as single overlaps; the reverse strand's coordinates are mirrored."""
    b = blast.where((F.col("qseqid") != F.col("sseqid")) & (F.col("length") >= min_len))
    forward = F.col("sstart") <= F.col("send")
    start = F.when(forward, F.col("sstart")).otherwise(F.col("slen") - F.col("sstart") + 1)
    b = b.withColumns({"at": F.col("qstart") - start, "strand": F.when(forward, "+").otherwise("-")})
    q_first = F.col("at") >= 0
    perc = F.least(F.round(100 * F.greatest(F.col("length") / F.col("qlen"), F.col("length") / F.col("slen"))), F.lit(100)).cast("long")
    return b.select(
        F.when(q_first, F.col("qseqid")).otherwise(F.col("sseqid")).alias("id1"),
        F.when(q_first, F.col("sseqid")).otherwise(F.col("qseqid")).alias("id2"),
        F.abs("at").alias("pos1"),
        F.when(q_first, F.lit("+")).otherwise(F.col("strand")).alias("ori1"),
        F.when(q_first, F.col("strand")).otherwise("+").alias("ori2"),
        perc.alias("perc1"),
        F.col("length").alias("len1"),
    )


def overlaps_to_sfo(overlaps: DataFrame, lengths: DataFrame, min_len: int) -> DataFrame:
    """Single overlaps (ids as text) as overhang rows; lengths: (read_id, length)."""
    o = overlaps.where((F.col("id1") != F.col("id2")) & (F.col("len1") >= min_len))
    o = o.join(lengths.withColumnsRenamed({"read_id": "id1", "length": "l1"}), "id1").join(lengths.withColumnsRenamed({"read_id": "id2", "length": "l2"}), "id2")
    ohb = F.when(F.col("l2") == F.col("len1"), F.col("pos1") + F.col("len1") - F.col("l1")).otherwise(F.col("l2") - F.col("len1"))
    turn = F.col("id1") > F.col("id2")
    o = o.withColumns({"oha": F.when(turn, -F.col("pos1")).otherwise(F.col("pos1")), "ohb": F.when(turn, -ohb).otherwise(ohb), "first": F.when(turn, F.col("ori2")).otherwise(F.col("ori1"))})
    back = F.col("first") == "-"
    return o.select(
        F.when(turn, F.col("id2")).otherwise(F.col("id1")).alias("id_a"),
        F.when(turn, F.col("id1")).otherwise(F.col("id2")).alias("id_b"),
        F.when(F.col("ori1") != F.col("ori2"), "I").otherwise("N").alias("ori"),
        F.when(back, -F.col("ohb")).otherwise(F.col("oha")).alias("oha"),
        F.when(back, -F.col("oha")).otherwise(F.col("ohb")).alias("ohb"),
        F.col("len1").alias("ola"),
        F.col("len1").alias("olb"),
    )
