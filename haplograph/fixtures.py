"""Reads, overlaps and graphs derived from the driver's tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins, overlap
from .session import ship

READ = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(number: Column) -> Column:
    return F.translate(F.md5(F.concat(F.lit("g"), number.cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def _replaced(s: str, at: str, to: str) -> Column:
    return F.expr(f"concat(substring({s}, 1, CAST({at} AS INT)), translate(substring({s}, CAST({at} AS INT) + 1, 1), 'ACGT', '{to}'), substring({s}, CAST({at} AS INT) + 2))")


def genome_length(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "orders").count() * 5 + 31) // 32 * 32


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, start, hap, seq, qual): for each order, 60 bases of one of two haplotypes, with errors and qualities 20..39."""
    g = genome_length(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.expr(f"(o_orderkey * 37 + o_custkey * 101) % {g - READ}").alias("start"), (F.col("o_custkey") % 2).alias("hap"))
    at = F.expr("start div 32")
    rows = rows.withColumn("s0", F.concat(_block(at), _block(at + 1), _block(at + 2))).withColumn("s0", F.expr(f"substring(s0, CAST(start % 32 + 1 AS INT), {READ})"))
    rows = rows.withColumns({"k1": F.expr("(97 - start % 97) % 97"), "k2": F.expr("(211 - read_id * 31 % 211) % 211")})
    rows = rows.withColumn("s1", F.when((F.col("hap") == 1) & (F.col("k1") < READ), _replaced("s0", "k1", "CGTA")).otherwise(F.col("s0")))
    rows = rows.withColumn("seq", F.when(F.col("k2") < READ, _replaced("s1", "k2", "TGCA")).otherwise(F.col("s1")))
    qual = F.expr(f"array_join(transform(sequence(0, {READ - 1}), k -> char(53 + (read_id * 7 + k) % 20)), '')")
    return rows.select("read_id", "start", "hap", "seq", qual.alias("qual"))


READS_SQL = """
size AS (SELECT (count(*) * 5 + 31) // 32 * 32 AS g FROM orders),
placed AS (SELECT o_orderkey AS read_id, (o_orderkey * 37 + o_custkey * 101) % (g - 60) AS start, o_custkey % 2 AS hap FROM orders, size),
raw AS (SELECT read_id, start, hap, (97 - start % 97) % 97 AS k1, (211 - read_id * 31 % 211) % 211 AS k2,
        substr(translate(md5('g' || (start // 32)) || md5('g' || (start // 32 + 1)) || md5('g' || (start // 32 + 2)), '0123456789abcdef', 'ACGTACGTACGTACGT'), start % 32 + 1, 60) AS s0 FROM placed),
hapd AS (SELECT *, CASE WHEN hap = 1 AND k1 < 60 THEN substr(s0, 1, k1) || translate(substr(s0, k1 + 1, 1), 'ACGT', 'CGTA') || substr(s0, k1 + 2) ELSE s0 END AS s1 FROM raw),
reads AS (SELECT read_id, start, hap, CASE WHEN k2 < 60 THEN substr(s1, 1, k2) || translate(substr(s1, k2 + 1, 1), 'ACGT', 'TGCA') || substr(s1, k2 + 2) ELSE s1 END AS seq,
          array_to_string([chr(CAST(53 + (read_id * 7 + k) % 20 AS INT)) FOR k IN range(60)], '') AS qual FROM hapd)"""


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, seq1, qual1, seq2, qual2): reads 2i and 2i + 1."""
    r = reads(spark, sf_dir)
    a = r.where("read_id % 2 = 0").select(F.expr("read_id div 2").alias("pair_id"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = r.where("read_id % 2 = 1").select(F.expr("read_id div 2").alias("pair_id"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return a.join(b, "pair_id")


MATES_SQL = """
mates AS (SELECT a.read_id // 2 AS pair_id, a.seq AS seq1, a.qual AS qual1, b.seq AS seq2, b.qual AS qual2
          FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0)"""


def plain_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id1, id2, pos, len): pairs of reads that start within 29 bases of one another."""
    r = reads(spark, sf_dir).select("read_id", "start")
    return joins.start_overlaps(r, READ, 29)


OVERLAPS_SQL = """
ovl AS (SELECT a.read_id AS id1, b.read_id AS id2, b.start - a.start AS pos, 60 - (b.start - a.start) AS len FROM reads a JOIN reads b
             ON b.start >= a.start AND b.start <= a.start + 29 AND (b.start > a.start OR b.read_id > a.read_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id1, id2, pos, len, score, mismatch) of the plain overlaps."""
    return overlap.score_overlaps(plain_overlaps(spark, sf_dir), reads(spark, sf_dir))


SCORED_SQL = """
cols AS (SELECT id1, id2, pos, len, substr(a.seq, pos + k + 1, 1) AS x, substr(b.seq, k + 1, 1) AS y,
         pow(10, -(20 + (id1 * 7 + pos + k) % 20) / 10.0) AS p, pow(10, -(20 + (id2 * 7 + k) % 20) / 10.0) AS q
         FROM (SELECT *, unnest(range(len)) AS k FROM ovl) o JOIN reads a ON a.read_id = id1 JOIN reads b ON b.read_id = id2),
scored AS (SELECT id1, id2, pos, len, exp(avg(ln(CASE WHEN x = y THEN (1 - p) * (1 - q) + p * q / 3 ELSE p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9 END))) AS score,
           avg(CASE WHEN x = y THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS mismatch FROM cols GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v1, v2, pos, len, score, mismatch): the overlaps that classify as edges at 0.97."""
    s = overlap.classify(scored(spark, sf_dir), edge_threshold=0.97, ov_threshold=0.9, merge_contigs=0.0)
    return s.where("class = 'edge'").select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), "pos", "len", "score", "mismatch")


EDGES_SQL = """
edges AS (SELECT id1 AS v1, id2 AS v2, pos, len, score, mismatch FROM scored WHERE score > 0.97 OR mismatch <= 0)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v1, v2, pos, len): a sparse acyclic overlap graph, the plain overlaps of at least 45 bases between reads of one haplotype, and some between the two."""
    r = reads(spark, sf_dir).select("read_id", "hap")
    o = plain_overlaps(spark, sf_dir).where("len >= 45")
    o = o.join(r.withColumnsRenamed({"read_id": "id1", "hap": "h1"}), "id1").join(r.withColumnsRenamed({"read_id": "id2", "hap": "h2"}), "id2")
    return o.where("h1 = h2 OR id1 * id2 % 11 = 0").select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), "pos", "len")


GRAPH_SQL = """
graph AS (SELECT id1 AS v1, id2 AS v2, pos, len FROM ovl JOIN reads a ON a.read_id = id1 JOIN reads b ON b.read_id = id2 WHERE len >= 45 AND (a.hap = b.hap OR id1 * id2 % 11 = 0))"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 columns of an overlap file, with single and paired reads in both orientations."""
    o = plain_overlaps(spark, sf_dir)
    paired = "(id1 % 4 = 0 OR id2 % 5 = 0)"
    return o.select(
        "id1",
        "id2",
        F.col("pos").cast("int").alias("pos1"),
        F.expr(f"CAST(IF({paired}, (id1 + 2 * id2) % 25, 0) AS INT)").alias("pos2"),
        F.expr("CASE WHEN id1 % 4 = 0 AND id2 % 5 = 0 THEN IF((id1 + id2) % 2 = 0, '1', '2') ELSE '-' END").alias("ord"),
        F.lit("+").alias("ori1"),
        F.expr("IF(id2 % 7 = 0, '-', '+')").alias("ori2"),
        F.expr("CAST(100 * len div 60 AS INT)").alias("perc1"),
        F.expr(f"CAST(IF({paired}, 100 * (20 + (id1 + id2) % 30) div 60, 0) AS INT)").alias("perc2"),
        F.col("len").cast("int").alias("len1"),
        F.expr(f"CAST(IF({paired}, 20 + (id1 + id2) % 30, 0) AS INT)").alias("len2"),
        F.expr("IF(id1 % 4 = 0, 'p', 's')").alias("type1"),
        F.expr("IF(id2 % 5 = 0, 'p', 's')").alias("type2"),
    )


MIXED_SQL = """
mixed AS (SELECT id1, id2, CAST(pos AS INT) AS pos1, CAST(CASE WHEN id1 % 4 = 0 OR id2 % 5 = 0 THEN (id1 + 2 * id2) % 25 ELSE 0 END AS INT) AS pos2,
          CASE WHEN id1 % 4 = 0 AND id2 % 5 = 0 THEN CASE WHEN (id1 + id2) % 2 = 0 THEN '1' ELSE '2' END ELSE '-' END AS ord,
          '+' AS ori1, CASE WHEN id2 % 7 = 0 THEN '-' ELSE '+' END AS ori2, CAST(100 * len // 60 AS INT) AS perc1,
          CAST(CASE WHEN id1 % 4 = 0 OR id2 % 5 = 0 THEN 100 * (20 + (id1 + id2) % 30) // 60 ELSE 0 END AS INT) AS perc2, CAST(len AS INT) AS len1,
          CAST(CASE WHEN id1 % 4 = 0 OR id2 % 5 = 0 THEN 20 + (id1 + id2) % 30 ELSE 0 END AS INT) AS len2,
          CASE WHEN id1 % 4 = 0 THEN 'p' ELSE 's' END AS type1, CASE WHEN id2 % 5 = 0 THEN 'p' ELSE 's' END AS type2 FROM ovl)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): a directed graph with cycles, without loops, an arc for each order."""
    o = table(spark, sf_dir, "orders")
    n = max(20, o.count() // 6)
    return o.select(F.expr(f"o_custkey % {n}").alias("u"), F.expr(f"(o_orderkey * 37 + o_custkey) % {n}").alias("v")).where("u <> v").distinct()


ARCS_SQL = """
arcs AS (SELECT DISTINCT u, v FROM (SELECT o_custkey % n AS u, (o_orderkey * 37 + o_custkey) % n AS v FROM orders, (SELECT greatest(20, count(*) // 6) AS n FROM orders)) WHERE u <> v)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v), u < v: the undirected form of arcs."""
    return arcs(spark, sf_dir).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


LINKS_SQL = "links AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM arcs)"


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, orig_id, idx, len): which orders a part's contig holds, and where."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("read_id"), F.col("l_orderkey").alias("orig_id")).distinct()
    return rows.select("read_id", "orig_id", F.expr("(orig_id * 13 + read_id * 7) % 90").alias("idx"), F.lit(40).cast("long").alias("len"))


LINEAGE_SQL = """
lineage AS (SELECT read_id, orig_id, (orig_id * 13 + read_id * 7) % 90 AS idx, CAST(40 AS BIGINT) AS len FROM (SELECT DISTINCT l_partkey AS read_id, l_orderkey AS orig_id FROM lineitem))"""


def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qname, flag, pos, cigar, seq): alignments with clips and indels; pos is 1-based."""
    flag = "CASE read_id % 7 WHEN 1 THEN 16 WHEN 2 THEN 4 WHEN 3 THEN 256 WHEN 4 THEN 272 ELSE 0 END"
    cigar = "CASE read_id % 4 WHEN 0 THEN '60M' WHEN 1 THEN '5S55M' WHEN 2 THEN '30M2I28M' ELSE '30M2D30M' END"
    return reads(spark, sf_dir).select(F.col("read_id").alias("qname"), F.expr(flag).alias("flag"), (F.col("start") + 6).alias("pos"), F.expr(cigar).alias("cigar"), "seq")


SAM_SQL = """
sam AS (SELECT read_id AS qname, CASE read_id % 7 WHEN 1 THEN 16 WHEN 2 THEN 4 WHEN 3 THEN 256 WHEN 4 THEN 272 ELSE 0 END AS flag, start + 6 AS pos,
        CASE read_id % 4 WHEN 0 THEN '60M' WHEN 1 THEN '5S55M' WHEN 2 THEN '30M2I28M' ELSE '30M2D30M' END AS cigar, seq FROM reads)"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, depth) of covered genome positions."""
    r = reads(spark, sf_dir).select(F.explode(F.expr(f"sequence(start, start + {READ - 1})")).alias("pos"))
    return r.groupBy("pos").agg(F.count("*").alias("depth"))


DEPTH_SQL = "depth AS (SELECT pos, count(*) AS depth FROM (SELECT unnest(range(start, start + 60)) AS pos FROM reads) GROUP BY 1)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, format, sample, block): phased genotypes from the events."""
    e = table(spark, sf_dir, "events")
    gt = "CASE event_id % 4 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' ELSE '0/1' END"
    return e.select(F.col("event_id").alias("pos"), F.expr("IF(event_id % 2 = 0, 'GT:PS', 'PS:GT')").alias("format"), F.expr(f"IF(event_id % 2 = 0, concat({gt}, ':', user_id), concat(user_id, ':', {gt}))").alias("sample"), F.expr("event_id div 7").alias("block"))


VARIANTS_SQL = """
gts AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' ELSE '0/1' END AS gt FROM events),
variants AS (SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'GT:PS' ELSE 'PS:GT' END AS format, CASE WHEN event_id % 2 = 0 THEN gt || ':' || user_id ELSE user_id || ':' || gt END AS sample, event_id // 7 AS block FROM gts)"""

#: Common table expressions by name, with what each needs.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "reads": (READS_SQL, ()),
    "mates": (MATES_SQL, ("reads",)),
    "overlaps": (OVERLAPS_SQL, ("reads",)),
    "scored": (SCORED_SQL, ("overlaps",)),
    "edges": (EDGES_SQL, ("scored",)),
    "graph": (GRAPH_SQL, ("overlaps",)),
    "mixed": (MIXED_SQL, ("overlaps",)),
    "arcs": (ARCS_SQL, ()),
    "links": (LINKS_SQL, ("arcs",)),
    "lineage": (LINEAGE_SQL, ()),
    "sam": (SAM_SQL, ("reads",)),
    "depth": (DEPTH_SQL, ("reads",)),
    "variants": (VARIANTS_SQL, ()),
}


def with_tables(names: str, more: str, body: str) -> str:
    """SQL that defines the named fixtures, then more expressions, before a body."""
    done: list[str] = []

    def need(name: str) -> None:
        for x in CTES[name][1]:
            need(x)
        if CTES[name][0] not in done:
            done.append(CTES[name][0])

    for name in names.split():
        need(name)
    parts = [*done, *([more] if more.strip() else [])]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
