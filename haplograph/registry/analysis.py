"""Statistics, frequencies, segmentation, phasing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import depth, lineage, reads, table, variants, with_tables
from ..operators import analysis as A
from ..operators import joins
from ..sources import text as src
from . import query


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, CAST(max(length(text)) AS BIGINT) AS longest, round(avg(length(text)), 6) AS mean FROM documents GROUP BY lang")
def read_stats(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query("SELECT CAST(length(text) AS BIGINT) AS length, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy(F.length("text").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query(with_tables("lineage", "c AS (SELECT read_id, count(*) AS size FROM lineage GROUP BY 1)", "SELECT size, count(*) AS n FROM c GROUP BY 1"))
def coverage_histogram(spark, sf):
    return lineage(spark, sf).groupBy("read_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(with_tables("lineage", """l AS (SELECT read_id, orig_id, 130 + read_id % 90 AS length FROM lineage WHERE 130 + read_id % 90 >= 150), h AS (SELECT orig_id, count(*) AS k FROM l GROUP BY 1),
    w AS (SELECT read_id, sum(CAST(1 AS DOUBLE) / k) / (any_value(length) - 99) AS raw FROM l JOIN h USING (orig_id) GROUP BY 1)""", "SELECT read_id, round(raw / (SELECT sum(raw) FROM w), 9) AS frequency FROM w"))  # fmt: skip
def freq_quick(spark, sf):
    l = lineage(spark, sf).select("read_id", "orig_id")
    lengths = l.select("read_id").distinct().withColumn("length", F.expr("130 + read_id % 90"))
    return A.quick_frequencies(l, lengths, 100, 150).select("read_id", F.round("frequency", 9).alias("frequency"))


@query("SELECT p_partkey AS target_id, round(p_retailprice / (SELECT sum(p_retailprice) FROM part WHERE p_size * 100 > 1000), 9) AS frequency FROM part WHERE p_size * 100 > 1000 ORDER BY 2 DESC")
def freq_tpm(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_size") * 100).alias("length"), F.col("p_retailprice").cast("double").alias("tpm"))
    return A.tpm_frequencies(p, 1000).select("target_id", F.round("frequency", 9).alias("frequency")).orderBy(F.desc("frequency"))


_EM = ", ".join(f"""w{i} AS MATERIALIZED (SELECT read, target, rho / length AS w FROM h JOIN r{i} USING (target)), z{i} AS MATERIALIZED (SELECT read, sum(w) AS z FROM w{i} GROUP BY 1),
    r{i + 1} AS MATERIALIZED (SELECT target, sum(w / z) / (SELECT count(DISTINCT read) FROM h) AS rho FROM w{i} JOIN z{i} USING (read) GROUP BY 1)""" for i in range(20))


@query(with_tables("lineage", f"h AS MATERIALIZED (SELECT DISTINCT orig_id AS read, read_id % 50 AS target, 500 + (read_id % 50) * 10 AS length FROM lineage), r0 AS (SELECT DISTINCT target, CAST(1 AS DOUBLE) AS rho FROM h), {_EM}", "SELECT target, round(rho * (SELECT count(DISTINCT read) FROM h), 4) AS est_count FROM r20"))
def em_abundance(spark, sf):
    hits = lineage(spark, sf).select(F.col("orig_id").alias("read"), (F.col("read_id") % 50).alias("target")).distinct()
    lengths = hits.select("target").distinct().withColumn("length", F.expr("500 + target * 10"))
    return A.em_abundance(hits, lengths).select("target", F.round("est_count", 4).alias("est_count"))


@query("""WITH a AS (SELECT l_partkey AS contig, l_suppkey AS target, count(*) AS errors FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY errors, target) AS r FROM a)
    SELECT contig, target, errors FROM r WHERE r = 1""")  # fmt: skip
def best_alignment(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("contig"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("errors"))
    return A.best_alignments(a)


@query("""WITH c AS (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS truth, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'x' ELSE event_type END END AS call FROM events),
    s AS (SELECT CAST(sum(CASE WHEN truth = call THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(truth) AS truths, count(call) AS calls FROM c)
    SELECT hits, truths, calls, round(CAST(hits AS DOUBLE) / truths, 9) AS recall, round(CAST(hits AS DOUBLE) / calls, 9) AS precision FROM s""")  # fmt: skip
def snp_eval(spark, sf):
    c = table(spark, sf, "events").select(F.expr("IF(event_id % 3 <> 0, event_type, NULL)").alias("truth"), F.expr("IF(event_id % 4 <> 0, IF(event_id % 5 = 0, 'x', event_type), NULL)").alias("call"))
    q = A.snp_quality(c)
    return q.select("hits", "truths", "calls", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query(with_tables("depth", "g AS (SELECT *, pos - row_number() OVER (ORDER BY pos) AS g FROM depth), i AS (SELECT min(pos) AS start, max(pos) AS stop, max(depth) AS max_depth FROM g GROUP BY g)", "SELECT start, stop, max_depth FROM i WHERE max_depth > 2 AND stop - start > 100"))
def coverage_islands(spark, sf):
    return A.islands(depth(spark, sf), 8, 100)


@query(with_tables("depth", "g AS (SELECT *, pos - row_number() OVER (ORDER BY pos) AS g FROM depth), i AS (SELECT min(pos) AS start, max(pos) AS stop, max(depth) AS d FROM g GROUP BY g HAVING max(depth) > 2 AND max(pos) - min(pos) > 100)",
    "SELECT f AS start, least(stop, f + 119) AS stop FROM (SELECT stop, unnest(range(start, stop + 1, 100)) AS f FROM i)"))
def region_tiles(spark, sf):
    return A.tiles(A.islands(depth(spark, sf), 8, 100), 100, 20)


@query(with_tables("reads", "t AS (SELECT DISTINCT start // 250 AS region, start // 250 * 250 AS a, start // 250 * 250 + 299 AS b FROM reads)", "SELECT read_id, region FROM reads JOIN t ON start <= b AND start + 59 >= a"))
def region_assign(spark, sf):
    r = reads(spark, sf)
    t = r.select(F.expr("start div 250").alias("region")).distinct().select("region", (F.col("region") * 250).alias("a"), (F.col("region") * 250 + 299).alias("b"))
    return joins.interval_overlaps(r.select("read_id", F.col("start").alias("s"), (F.col("start") + 59).alias("e")), t, ("s", "e"), ("a", "b"), 250).select("read_id", "region")


@query(with_tables("reads", "snp AS (SELECT DISTINCT (start // 97) * 97 AS pos FROM reads)", "SELECT read_id, pos FROM reads JOIN snp ON pos BETWEEN start AND start + 59"))
def snp_coverage(spark, sf):
    r = reads(spark, sf).select("read_id", "start")
    snp = r.select(F.expr("start div 97 * 97").alias("pos")).distinct()
    return joins.binned_range_join(r, snp, F.col("start"), F.col("start") + 59, F.col("pos"), 60).select("read_id", "pos")


_PS = "p AS (SELECT event_id AS pos, user_id // 40 AS ps FROM events), c AS (SELECT *, CASE WHEN lag(ps) OVER (ORDER BY pos) = ps THEN 0 ELSE 1 END AS ch FROM p), b AS (SELECT *, sum(ch) OVER (ORDER BY pos) AS block FROM c)"


def _phase_sets(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.expr("user_id div 40").alias("ps"))


@query(with_tables("", _PS, "SELECT CAST(block AS BIGINT) AS block, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM b GROUP BY 1"))
def phase_set_blocks(spark, sf):
    return A.phase_set_blocks(_phase_sets(spark, sf))


@query(with_tables("variants", "g AS (SELECT pos, block, string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')] AS gt FROM variants), ph AS (SELECT block, CASE WHEN block % 2 = 0 THEN '0|1' ELSE '1|0' END AS phase FROM (SELECT DISTINCT block FROM variants) WHERE block % 3 <> 0)",
    "SELECT pos, CASE WHEN phase IS NULL OR gt = '1|1' THEN gt ELSE phase END AS gt FROM g LEFT JOIN ph USING (block) WHERE gt <> '0/0'"))
def apply_phase(spark, sf):
    """Genotypes with the phase of their block, where it has one and the alleles differ."""
    v = variants(spark, sf)
    g = v.select("pos", "block", src.genotype(F.col("format"), F.col("sample")).alias("gt"))
    phases = v.select("block").distinct().where("block % 3 <> 0").select("block", F.expr("IF(block % 2 = 0, '0|1', '1|0')").alias("phase"))
    het = F.size(F.array_distinct(src.alleles(F.col("gt")))) > 1
    return g.where("gt <> '0/0'").join(phases, "block", "left").select("pos", F.when(F.col("phase").isNull() | ~het, F.col("gt")).otherwise(F.col("phase")).alias("gt"))


_PC = """ref AS (SELECT read_id AS block, start AS first_pos, seq FROM reads), vs AS (SELECT block, first_pos + o AS pos, CASE WHEN o % 2 = 0 THEN ['A', 'G'] ELSE ['T', 'C'] END AS al FROM (SELECT *, unnest([7, 20, 33]) AS o FROM ref)),
    cl AS (SELECT ref.block, hap, k, coalesce(al[hap + 1], substr(seq, k + 1, 1)) AS b FROM (SELECT *, unnest(range(60)) AS k FROM ref) ref CROSS JOIN (SELECT unnest([0, 1]) AS hap) h LEFT JOIN vs ON vs.block = ref.block AND vs.pos = first_pos + k)"""


@query(with_tables("reads", _PC, "SELECT block, hap, string_agg(b, '' ORDER BY k) AS seq FROM cl GROUP BY 1, 2"))
def phase_contigs(spark, sf):
    ref = reads(spark, sf).select(F.col("read_id").alias("block"), F.col("start").alias("first_pos"), "seq")
    v = ref.select("block", "first_pos", F.explode(F.array(F.lit(7), F.lit(20), F.lit(33))).alias("o"))
    v = v.select("block", (F.col("first_pos") + F.col("o")).alias("pos"), F.expr("IF(o % 2 = 0, array('A', 'G'), array('T', 'C'))").alias("alleles"))
    return A.phase_contigs(ref, v)


@query(with_tables("reads", "", "SELECT read_id, CAST('0x' || substr(md5('0:' || (read_id // 2)), 1, 6) AS INT) % 5 AS patch FROM reads"))
def split_patches(spark, sf):
    """A uniform split by fragment, mates together, decided by a seeded hash."""
    digest = F.md5(F.concat(F.lit("0:"), F.expr("CAST(read_id div 2 AS STRING)")).cast("binary"))
    return reads(spark, sf).select("read_id", (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 5).alias("patch"))


@query(with_tables("reads", "l AS (SELECT read_id % 4 AS patch, row_number() OVER (PARTITION BY read_id % 4 ORDER BY read_id) - 1 AS local, read_id FROM reads), s AS (SELECT patch, count(*) AS n FROM l GROUP BY 1), o AS (SELECT patch, coalesce(sum(n) OVER (ORDER BY patch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)",
    "SELECT read_id, patch, local, CAST(base + local AS BIGINT) AS global FROM l JOIN o USING (patch)"))
def combine_patches(spark, sf):
    """Global ids of the patches' local ids: each patch starts after the ones before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("patch").orderBy("read_id")
    l = reads(spark, sf).select("read_id", (F.col("read_id") % 4).alias("patch")).withColumn("local", (F.row_number().over(w) - 1).cast("long"))
    before = Window.orderBy("patch").rowsBetween(Window.unboundedPreceding, -1)
    base = l.groupBy("patch").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return l.join(F.broadcast(base), "patch").select("read_id", "patch", "local", (F.col("base") + F.col("local")).alias("global"))


@query(with_tables("reads", "e AS (SELECT a.read_id AS contig, [i - 1 FOR i IN range(1, 61) IF substr(a.seq, i, 1) <> substr(b.seq, i, 1)] AS l FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0)", "SELECT contig, array_to_string(l, ',') AS errors FROM e"))
def alignment_errors(spark, sf):
    r = reads(spark, sf)
    a = r.where("read_id % 2 = 0").select(F.col("read_id").alias("contig"), "seq")
    b = r.where("read_id % 2 = 1").select((F.col("read_id") - 1).alias("contig"), F.col("seq").alias("ref"))
    j = a.join(b, "contig").withColumns({"pos": F.lit(0), "cigar": F.lit("60M")})
    return A.alignment_errors(j).select("contig", F.array_join(F.col("errors").cast("array<string>"), ",").alias("errors"))
