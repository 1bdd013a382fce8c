"""Layouts, consensus and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import lineage, reads, table, with_tables
from ..operators import consensus as C
from . import query

#: Groups of the fixture: reads by start in bins of 40 positions.
_MEMBERS = "members AS (SELECT start // 40 AS grp, read_id, start AS off, CAST(60 AS BIGINT) AS length, seq, qual FROM reads)"
_LAID = _MEMBERS + ", laid AS (SELECT *, off - min(off) OVER (PARTITION BY grp) AS place, max(off + length) OVER (PARTITION BY grp) - min(off) OVER (PARTITION BY grp) AS total FROM members)"
_COLS = _LAID + ", cell AS (SELECT grp, place + k AS pos, substr(seq, k + 1, 1) AS base, ascii(substr(qual, k + 1, 1)) - 33 AS q FROM (SELECT *, unnest(range(60)) AS k FROM laid)), cells AS (SELECT grp, pos, CASE WHEN (pos * 7 + q) % 41 = 0 THEN 'N' ELSE base END AS base, q FROM cell)"


def _ll(b: str) -> str:
    return f"sum(CASE WHEN base <> 'N' THEN CASE WHEN base = '{b}' THEN log10(1 - pow(10, -q / 10.0)) ELSE log10(pow(10, -q / 10.0) / 3) END END) AS l{b}"


_BASES = _COLS + f""", ls AS (SELECT grp, pos, count(*) AS depth, {', '.join(_ll(b) for b in 'ACGT')} FROM cells GROUP BY 1, 2),
    tp AS (SELECT *, greatest(la, lc, lg, lt) AS top FROM ls),
    er AS (SELECT *, CASE WHEN top IS NULL THEN 1 ELSE (pow(10, la - top) + pow(10, lc - top) + pow(10, lg - top) + pow(10, lt - top) - 1) / (pow(10, la - top) + pow(10, lc - top) + pow(10, lg - top) + pow(10, lt - top)) END AS err FROM tp),
    bs AS (SELECT grp, pos, depth, CASE WHEN top IS NULL OR (depth > 1 AND 1 - err < 0.9) THEN 'N' WHEN la = top THEN 'A' WHEN lt = top THEN 'T' WHEN lc = top THEN 'C' ELSE 'G' END AS base FROM er)"""


def _laid(spark, sf):
    m = reads(spark, sf).select(F.expr("start div 40").alias("group"), "read_id", F.col("start").alias("offset"), F.lit(60).cast("long").alias("length"), "seq", "qual")
    return C.layout(m)


def _bases(spark, sf):
    cols = C.columns(_laid(spark, sf)).withColumn("base", F.expr("IF((pos * 7 + q) % 41 = 0, 'N', base)"))
    return C.consensus_bases(cols)


@query(with_tables("reads", _LAID, "SELECT grp, read_id, place, total FROM laid"))
def layout_positions(spark, sf):
    return _laid(spark, sf).select(F.col("group").alias("grp"), "read_id", F.col("at").alias("place"), "total")


@query(with_tables("reads", _LAID + """, f AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY place, read_id) AS fl FROM laid),
    g AS (SELECT *, row_number() OVER (PARTITION BY grp, fl <= 4 ORDER BY place + length DESC, read_id) AS fr FROM f)""", "SELECT grp, read_id FROM g WHERE n <= 12 OR fl <= 4 OR fr <= 4"))  # fmt: skip
def clique_downsample(spark, sf):
    return C.downsample(_laid(spark, sf), 4).select(F.col("group").alias("grp"), "read_id")


@query(with_tables("reads", _BASES, "SELECT grp, pos, depth, base FROM bs"))
def consensus_base(spark, sf):
    return _bases(spark, sf).select(F.col("group").alias("grp"), "pos", "depth", "base")


_SEQ = ", sq AS (SELECT grp, string_agg(base, '' ORDER BY pos) AS s, max(pos) - min(pos) + 1 AS span FROM {0} GROUP BY grp)"


@query(with_tables("reads", _BASES + _SEQ.format("bs"), "SELECT grp, CASE WHEN length(s) = span THEN s ELSE '' END AS seq, CAST(CASE WHEN length(s) = span THEN length(s) ELSE 0 END AS BIGINT) AS length FROM sq"))
def consensus_seq(spark, sf):
    return C.consensus_sequences(_bases(spark, sf)).withColumnRenamed("group", "grp")


@query(with_tables("reads", _BASES + ", ed AS (SELECT *, min(CASE WHEN depth >= 3 THEN pos END) OVER (PARTITION BY grp) AS a, max(CASE WHEN depth >= 3 THEN pos END) OVER (PARTITION BY grp) AS b FROM bs), kp AS (SELECT * FROM ed WHERE pos >= a AND pos <= b)" + _SEQ.format("kp"),
    "SELECT grp, CASE WHEN length(s) = span THEN s ELSE '' END AS seq, CAST(CASE WHEN length(s) = span THEN length(s) ELSE 0 END AS BIGINT) AS length FROM sq"))
def consensus_trim(spark, sf):
    return C.consensus_sequences(_bases(spark, sf), 3).withColumnRenamed("group", "grp")


@query(with_tables("lineage", "m AS (SELECT DISTINCT read_id // 4 AS grp, read_id, read_id % 4 * 11 AS place FROM lineage), j AS (SELECT grp, orig_id, place + idx AS idx, len, row_number() OVER (PARTITION BY grp, orig_id ORDER BY read_id) AS r FROM m JOIN lineage USING (read_id))",
    "SELECT grp, orig_id, idx, len FROM j WHERE r = 1"))
def superread_lineage(spark, sf):
    l = lineage(spark, sf)
    m = l.select(F.expr("read_id div 4").alias("group"), "read_id", F.expr("read_id % 4 * 11").alias("at")).distinct()
    return C.superread_lineage(m, l).withColumnRenamed("group", "grp")


@query(with_tables("lineage", "", "SELECT read_id, orig_id, 130 + read_id % 20 - len - idx AS idx, len FROM lineage"))
def lineage_reverse(spark, sf):
    l = lineage(spark, sf)
    return C.lineage_reversed(l, l.select("read_id").distinct().withColumn("length", F.expr("130 + read_id % 20")))


@query(with_tables("reads", "", "SELECT read_id, read_id AS orig_id, true AS forward, CAST(0 AS BIGINT) AS idx, CAST(length(seq) AS BIGINT) AS len FROM reads"))
def lineage_init(spark, sf):
    return reads(spark, sf).select("read_id", F.col("read_id").alias("orig_id"), F.lit(True).alias("forward"), F.lit(0).cast("long").alias("idx"), F.length("seq").cast("long").alias("len"))


@query(with_tables("reads", "k AS (SELECT read_id, CASE read_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 't' ELSE 'p' END AS kind FROM reads)",
    "SELECT read_id, kind, row_number() OVER (ORDER BY CASE kind WHEN 's' THEN 0 WHEN 't' THEN 1 ELSE 2 END, read_id) - 1 AS new_id FROM k"))
def assign_new_ids(spark, sf):
    k = reads(spark, sf).select("read_id", F.expr("CASE read_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 't' ELSE 'p' END").alias("kind"))
    return C.assign_new_ids(k)


@query(with_tables("reads", "", "SELECT read_id, seq FROM reads WHERE read_id % 4 <> 0 AND length(seq) >= 50 AND length(seq) - length(replace(seq, 'N', '')) < CAST(0.05 AS DOUBLE) * length(seq)"))
def trivial_superreads(spark, sf):
    """Reads in no group that are long enough and have few N."""
    from ..functions import seq

    grouped = reads(spark, sf).where("read_id % 4 = 0").select("read_id")
    return reads(spark, sf).join(grouped, "read_id", "left_anti").where((F.length("seq") >= 50) & seq.n_rate_ok(F.col("seq"))).select("read_id", "seq")


@query("SELECT p_partkey AS target, p_size * 100 AS length, CAST(p_retailprice AS DOUBLE) AS tpm FROM part WHERE p_retailprice > 910")
def abundance_filter(spark, sf):
    """Contigs whose abundance exceeds a threshold, through a join with the table of abundances."""
    p = table(spark, sf, "part")
    contigs = p.select(F.col("p_partkey").alias("target"), (F.col("p_size") * 100).alias("length"))
    tpm = p.select(F.col("p_partkey").alias("target"), F.col("p_retailprice").cast("double").alias("tpm"))
    return contigs.join(tpm.where("tpm > 910"), "target")
