"""Tabular files: the fixtures written in each format, with lines that do not belong, and read back."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import graph, links, plain_overlaps, reads, sam, table, variants, with_tables
from ..functions import seq
from ..operators import evidence
from ..operators import graph as G
from ..session import cut, scratch
from ..sources import tables as T
from ..sources import text as src
from . import query


def _written(lines: DataFrame, *order: str) -> str:
    """A folder with the lines (value), in order over its files where one is given."""
    path = scratch(lines.sparkSession)
    if order:
        lines = lines.repartitionByRange(3, *order).sortWithinPartitions(*order)
    lines.select("value").write.text(path)
    return path


def _line(df: DataFrame, separator: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.concat_ws(separator, *(F.expr(c).cast("string") for c in columns)).alias("value"), *keep)


@query(with_tables("reads", "", "SELECT read_id AS read_id, seq FROM reads"))
def scan_ids(spark, sf):
    """Reads named by text ids get the ids of a two-column file."""
    r = reads(spark, sf)
    ids = T.read_ids(spark, _written(_line(r, "\t", "read_id", "concat(IF(read_id % 2 = 0, '>', ''), 'r', read_id)")))
    return T.mapped_ids(r.select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_id"), "seq"), ids)


@query(with_tables("overlaps", "", "SELECT id1 AS id_a, id2 AS id_b, CASE WHEN id2 % 7 = 0 THEN 'I' ELSE 'N' END AS ori, pos AS oha, -pos AS ohb, len AS ola, len AS olb, CAST(2 AS BIGINT) AS k FROM ovl WHERE (id1 + id2) % 10 <> 3"))
def scan_sfo(spark, sf):
    """Lines of eight fields; those of seven are passed over."""
    o = plain_overlaps(spark, sf).withColumn("k", F.when((F.col("id1") + F.col("id2")) % 10 != 3, 2))
    return T.read_sfo(spark, _written(_line(o, "  ", "id1", "id2", "IF(id2 % 7 = 0, 'I', 'N')", "pos", "-pos", "len", "len", "k")))


@query(with_tables("overlaps", "", "SELECT 'r' || id1 AS qseqid, 'r' || id2 AS sseqid, CAST(97.5 AS DOUBLE) AS pident, len AS length, id1 % 4 AS mismatch, CAST(0 AS BIGINT) AS gapopen, pos + 1 AS qstart, CAST(60 AS BIGINT) AS qend, CAST(1 AS BIGINT) AS sstart, len AS send, CAST(60 AS BIGINT) AS qlen, CAST(60 AS BIGINT) AS slen FROM ovl"))
def scan_blast(spark, sf):
    return T.read_blast(spark, _written(_line(plain_overlaps(spark, sf), "\t", "concat('r', id1)", "concat('r', id2)", "97.5", "len", "id1 % 4", "0", "pos + 1", "60", "1", "len", "60", "60")))


@query(with_tables("overlaps", "", "SELECT 'r' || id1 AS qseqid, CAST(60 AS BIGINT) AS qlen, pos AS qstart, CAST(60 AS BIGINT) AS qend, CASE WHEN id2 % 7 = 0 THEN '-' ELSE '+' END AS qori, 'r' || id2 AS sseqid, CAST(60 AS BIGINT) AS slen, CAST(0 AS BIGINT) AS sstart, len AS send, len - id1 % 4 AS matches, len AS length, CAST(60 AS BIGINT) AS qual, len || 'M' AS cigar FROM ovl"))
def scan_paf(spark, sf):
    return T.read_paf(spark, _written(_line(plain_overlaps(spark, sf), "\t", "concat('r', id1)", "60", "pos", "60", "IF(id2 % 7 = 0, '-', '+')", "concat('r', id2)", "60", "0", "len", "len - id1 % 4", "len", "60", "concat(len, 'M')")))


@query("""WITH s AS (SELECT event_id, user_id FROM events WHERE event_id % 9 <> 4)
    SELECT 'h' || user_id % 5 AS hap, event_id AS pos FROM s UNION ALL SELECT 'g' || user_id % 3 AS hap, event_id + 3 AS pos FROM s""")
def scan_snps(spark, sf):
    """Differences of two haplotypes, each at its place in both; insertions and deletions and the header are left out."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    lines = _line(e, "\t", "event_id", "'A'", "IF(event_id % 9 = 4, '.', 'G')", "event_id + 3", "31", "1", "concat('h', user_id % 5)", "concat('g', user_id % 3)")
    return T.read_snps(spark, _written(lines.unionAll(spark.sql("SELECT '[P1] [SUB] [SUB] [P2] [FRM] [TAGS]' AS value"))), skip_indels=True)


_ALIGNED = "SELECT CAST(qname AS VARCHAR) AS seq_id, 'g' AS ref_id, pos - 1 AS pos, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS ori, cigar, false AS unmapped FROM sam WHERE flag & 4 = 0 UNION ALL SELECT CAST(qname AS VARCHAR), '*', -1, '*', '*', true FROM sam WHERE flag & 4 <> 0"


@query(with_tables("sam", "", _ALIGNED))
def scan_alignments(spark, sf):
    """Alignments as they are evaluated, with the unmapped sequences apart."""
    lines = _line(sam(spark, sf), "\t", "qname", "flag", "'g'", "pos", "60", "cigar", "'*'", "0", "0", "seq", "seq").unionAll(spark.sql("SELECT '@SQ\tSN:g' AS value"))
    aligned, unmapped = T.read_alignments(spark, _written(lines))
    none = {"ref_id": F.lit("*"), "pos": F.lit(-1).cast("long"), "ori": F.lit("*"), "cigar": F.lit("*"), "unmapped": F.lit(True)}
    return aligned.withColumn("unmapped", F.lit(False)).unionByName(unmapped.withColumns(none))


_REGION = "WHERE pos BETWEEN 100 AND 5000 AND gt LIKE '%|%'"


@query(with_tables("variants", "g AS (SELECT pos, string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')] AS gt FROM variants)", f"SELECT pos, gt FROM g {_REGION}"))
def scan_vcf_region(spark, sf):
    """Phased variants of a region, from a file with headers."""
    lines = _line(variants(spark, sf), "\t", "'g'", "pos", "'.'", "'A'", "'C'", "'.'", "'.'", "'.'", "format", "sample").unionAll(spark.sql("SELECT '##fileformat=VCFv4.2' AS value"))
    v = T.read_vcf(spark, _written(lines)).select("pos", src.genotype(F.col("format"), F.col("sample")).alias("gt"))
    return T.in_region(v, 100, 5000)


@query("""SELECT event_id AS idx, (event_id % 2) || '|' || ((event_id // 2) % 3) AS phase, event_id // 7 + 1 AS block FROM events WHERE event_id % 5 <> 0 AND (event_id // 2) % 3 < 2""")
def scan_phasing(spark, sf):
    """Blocks begin at B lines and end at * lines; rows that are not fully phased, or name an allele beyond the ploidy, go."""
    e = table(spark, sf, "events").select("event_id")
    rows = _line(e, "\t", "event_id", "1 + event_id % 2", "IF(event_id % 5 = 0, '-', CAST(1 + event_id div 2 % 3 AS STRING))", keep=("event_id",)).withColumn("kind", F.lit(1))
    heads = e.where("event_id % 7 = 0").select(F.lit("BLOCK").alias("value"), "event_id", F.lit(0).alias("kind"))
    ends = e.where("event_id % 7 = 6").select(F.lit("********").alias("value"), "event_id", F.lit(2).alias("kind"))
    return T.read_phasing(spark, _written(rows.unionAll(heads).unionAll(ends), "event_id", "kind"))


@query("SELECT 'chr' || user_id % 3 AS chrom, event_id AS pos, event_id % 40 AS depth FROM events")
def scan_depth(spark, sf):
    return T.read_depth(spark, _written(_line(table(spark, sf, "events"), "\t", "concat('chr', user_id % 3)", "event_id", "event_id % 40")))


@query("SELECT event_id AS dist, event_id % 11 AS min_ev FROM events")
def scan_thresholds(spark, sf):
    lines = _line(table(spark, sf, "events"), "\t", "event_id", "event_id % 40", "event_id % 11").unionAll(spark.sql("SELECT '# dist\texp_ev\tmin_ev' AS value"))
    return T.read_thresholds(spark, _written(lines))


_BOTH = "b AS (SELECT u, v FROM links UNION SELECT v, u FROM links), n AS (SELECT greatest(20, count(*) // 6) AS n FROM orders)"


def _vertices(spark, sf) -> int:
    return max(20, table(spark, sf, "orders").count() // 6)


@query(with_tables("links", _BOTH, "SELECT u, v FROM b"))
def scan_dimacs(spark, sf):
    return T.read_dimacs(spark, _written(T.dimacs_lines(links(spark, sf), _vertices(spark, sf)).unionAll(spark.sql("SELECT 'c a comment' AS value"))))


@query(with_tables("links", _BOTH, "SELECT u, v FROM b"))
def scan_metis_file(spark, sf):
    """Vertices are numbered by their lines, empty ones for vertices without neighbours included."""
    path = scratch(spark)
    T.metis_lines(links(spark, sf), _vertices(spark, sf)).write.text(path)
    return T.read_metis(spark, path)


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, (event_id * 7) % 1000 AS vertex FROM events")
def scan_ordering(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("CAST((event_id * 7) % 1000 AS STRING)").alias("value"))
    return T.read_ordering(spark, _written(e, "event_id"))


@query(with_tables("links", _BOTH, "SELECT CAST(n AS VARCHAR) AS value FROM n UNION ALL SELECT CAST(count(*) AS VARCHAR) FROM b UNION ALL SELECT u || ',' || v FROM b"))
def edge_file(spark, sf):
    return T.edge_file_lines(links(spark, sf), _vertices(spark, sf))


@query(with_tables("links", _BOTH, "SELECT u, v FROM b"))
def scan_edge_stream(spark, sf):
    """The lines of an edge file from an open stream, which the driver reads."""
    stream = io.StringIO("\n".join(r[0] for r in T.edge_file_lines(links(spark, sf), _vertices(spark, sf)).toLocalIterator()))
    return T.edges_of_stream(spark, stream)


@query(with_tables("graph", "", "SELECT v1 || chr(9) || v2 AS value FROM graph"))
def digraph_lines(spark, sf):
    return T.digraph_lines(graph(spark, sf))


@query(with_tables("links", _BOTH, "SELECT u || chr(9) || v AS value FROM b"))
def snap_lines(spark, sf):
    return T.snap_lines(links(spark, sf))


@query(with_tables("graph", "t AS (SELECT DISTINCT v1, min(v2) OVER (PARTITION BY v1) AS a, max(v2) OVER (PARTITION BY v1) AS b FROM graph)", "SELECT array_to_string(list_sort(list_distinct([v1, a, b])), ' ') AS value FROM t"))
def clique_lines(spark, sf):
    """Sets of members as lines, sorted in each: here a vertex with its least and greatest successor."""
    t = graph(spark, sf).groupBy("v1").agg(F.min("v2").alias("a"), F.max("v2").alias("b"))
    return T.clique_lines(t.select(F.expr("array_distinct(array(b, a, v1))").alias("members")))


@query(with_tables("graph", "n AS (SELECT v1 AS read_id, string_agg('NODE_' || v2, ',' ORDER BY v2) AS nx FROM (SELECT DISTINCT v1, v2 FROM graph) GROUP BY 1)", "SELECT '>NODE_' || read_id || coalesce(':' || nx, '') || ';' || chr(10) || seq AS value FROM reads LEFT JOIN n USING (read_id)"))
def fastg_lines(spark, sf):
    return T.fastg_lines(reads(spark, sf), graph(spark, sf))


@query(with_tables("reads", "", "SELECT read_id, reverse(qual) AS qual FROM reads"))
def reverse_quality(spark, sf):
    return reads(spark, sf).select("read_id", seq.reversed_quality(F.col("qual")).alias("qual"))


@query(with_tables("sam", "s AS (SELECT pos, 0 AS kind, qname FROM sam WHERE qname % 3 > 0), p AS (SELECT pos, 1 AS kind, qname FROM sam WHERE qname % 3 = 0)", "SELECT row_number() OVER (ORDER BY pos, kind, qname) - 1 AS place, kind, qname, pos FROM (SELECT * FROM s UNION ALL SELECT * FROM p)"))
def merge_streams(spark, sf):
    """Single and paired records in one order by position, singles first where they start together."""
    s = sam(spark, sf)
    singles, pairs = (s.where(f"qname % 3 {op}").select("pos", F.lit(kind).alias("kind"), "qname") for op, kind in (("> 0", 0), ("= 0", 1)))
    return G.dense_rank_of(singles.unionAll(pairs).orderBy("pos", "kind", "qname"), "place")


@query("""WITH s AS (SELECT l_partkey AS component, l_suppkey AS v1, l_linenumber AS v2, count(*) AS support FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY support DESC, v1, v2) AS r FROM s) SELECT component, v1, CAST(v2 AS BIGINT) AS v2, support FROM r WHERE r = 1""")
def top_evidence(spark, sf):
    """The edge of most support in each component."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("component"), F.col("l_suppkey").alias("v1"), F.col("l_linenumber").cast("long").alias("v2")).agg(F.count("*").alias("support"))
    return evidence.best_supported(s)


@query(with_tables("links", "", "SELECT u, v FROM (SELECT u, v FROM links) WHERE u < v"))
def cycle_lines(spark, sf):
    """Removed edges as lines, and back."""
    lines = cut(T.cycle_lines(links(spark, sf)))
    return lines.select(F.split("value", "\t").alias("f")).select(F.col("f")[0].cast("long").alias("u"), F.col("f")[1].cast("long").alias("v"))
