"""Readers and writers of files, checked by writing the fixtures and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import graph, links, mates, mixed, plain_overlaps, reads, sam, table, variants, with_tables
from ..operators import analysis
from ..operators.graph import dense_rank_of
from ..session import scratch
from ..sources import text as src
from . import query


@query(with_tables("reads", "", "SELECT CAST(read_id AS VARCHAR) AS read_id, seq, qual FROM reads"))
def scan_fastq(spark, sf):
    path = scratch(spark)
    src.write_fastq(reads(spark, sf), path)
    return src.read_fastq(spark, path).select("read_id", "seq", "qual")


@query(with_tables("mates", "", "SELECT CAST(pair_id AS VARCHAR) AS read_id, CASE WHEN pair_id % 3 = 0 THEN lower(seq1) ELSE seq1 END AS seq1, qual1, CASE WHEN pair_id % 2 = 0 THEN lower(seq2) ELSE seq2 END AS seq2, qual2 FROM mates"))
def scan_fastq_paired(spark, sf):
    """Mates keep the case of their letters."""
    one, two = scratch(spark), scratch(spark)
    m = mates(spark, sf).repartitionByRange(4, "pair_id").sortWithinPartitions("pair_id")
    src.write_fastq(m.select("pair_id", F.expr("IF(pair_id % 3 = 0, lower(seq1), seq1)").alias("seq"), F.col("qual1").alias("qual")), one, "pair_id")
    src.write_fastq(m.select("pair_id", F.expr("IF(pair_id % 2 = 0, lower(seq2), seq2)").alias("seq"), F.col("qual2").alias("qual")), two, "pair_id")
    return src.read_fastq_pairs(spark, one, two)


@query(with_tables("reads", "", "SELECT read_id, seq FROM reads ORDER BY read_id LIMIT 100"))
def scan_limit(spark, sf):
    return reads(spark, sf).orderBy("read_id").limit(100).select("read_id", "seq")


@query(with_tables("reads", "", "SELECT 'r' || read_id AS old_id, read_id AS new_id, seq FROM reads"))
def id_remap(spark, sf):
    """Ids replaced through a table of correspondences; an id without one is an error."""
    r = reads(spark, sf)
    names = r.select(F.col("read_id").alias("new_id"), F.concat(F.lit(">r"), F.col("read_id").cast("string")).alias("name")).select("new_id", F.regexp_replace("name", "^>", "").alias("old_id"))
    mapped = r.select(F.col("read_id").alias("new_id"), "seq").join(names, "new_id", "left")
    return mapped.select(F.coalesce("old_id", F.raise_error(F.lit("an id without a correspondence"))).alias("old_id"), "new_id", "seq")


@query(with_tables("reads", "k AS (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN 1 ELSE 0 END AS paired FROM reads)", "SELECT read_id, paired, row_number() OVER (ORDER BY paired, read_id) - 1 AS vertex FROM k"))
def dense_vertex_ids(spark, sf):
    k = reads(spark, sf).select("read_id", F.expr("IF(read_id % 3 = 0, 1, 0)").alias("paired"))
    return dense_rank_of(k.orderBy("paired", "read_id"), "vertex")


@query(with_tables("reads", "", "SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 + 5000 AS new_id FROM reads"))
def rename_ids(spark, sf):
    return dense_rank_of(reads(spark, sf).select("read_id").orderBy("read_id"), "new_id", 5000)


@query(with_tables("mixed", "", "SELECT id1, id2, pos1, pos2, ord, ori1, ori2, perc1, perc2, len1, len2, type1, type2 FROM mixed"))
def scan_overlaps(spark, sf):
    path = scratch(spark)
    src.overlap_lines(mixed(spark, sf)).write.text(path)
    return src.parse_overlaps(spark.read.text(path))


@query(with_tables("lineage", "", "SELECT read_id, orig_id, orig_id % 2 = 0 AS forward, idx AS idx1, len AS len1 FROM lineage"))
def parse_subreads(spark, sf):
    from ..fixtures import lineage

    path = scratch(spark)
    src.subread_lines(lineage(spark, sf).withColumn("forward", F.expr("orig_id % 2 = 0"))).write.text(path)
    return src.parse_subreads(spark.read.text(path)).select("read_id", "orig_id", "forward", "idx1", "len1")


@query(with_tables("links", "", "SELECT u, v FROM links UNION SELECT v, u FROM links"))
def scan_edges(spark, sf):
    path = scratch(spark)
    both = links(spark, sf)
    both = both.union(both.select("v", "u"))
    both.select(F.concat_ws(",", F.col("u").cast("string"), F.col("v").cast("string")).alias("value")).union(spark.sql("SELECT '20' AS value")).write.text(path)
    return src.read_edges(spark, path)


@query(with_tables("links", "", "SELECT u, v FROM links UNION SELECT v, u FROM links"))
def scan_metis(spark, sf):
    from ..operators import graph as G

    lists = G.adjacency_lists(links(spark, sf))
    lines = lists.select((F.col("u") + 1).alias("vertex"), F.array_join(F.transform("neighbours", lambda x: (x + 1).cast("string")), " ").alias("value"))
    return src.parse_metis(lines)


@query(with_tables("sam", "", "SELECT CAST(qname AS VARCHAR) AS qname, flag, pos, cigar, seq FROM sam WHERE flag & 4 = 0"))
def scan_sam(spark, sf):
    path = scratch(spark)
    s = sam(spark, sf)
    line = F.concat_ws("\t", F.col("qname").cast("string"), F.col("flag").cast("string"), F.lit("ref"), F.col("pos").cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"))
    s.select(line.alias("value")).union(spark.sql("SELECT '@HD\tVN:1.6' AS value")).write.text(path)
    return src.read_sam(spark, path).select("qname", F.col("flag"), "pos", "cigar", "seq")


@query(with_tables("reads", "", "SELECT 'c' || read_id AS name, seq, round(read_id / 1000.0, 4) AS frequency FROM reads"))
def scan_fasta(spark, sf):
    path = scratch(spark)
    r = reads(spark, sf)
    r.select(F.expr("concat('>c', read_id, ' length=60 frequency=', read_id / 1000, '\n', lower(substring(seq, 1, 25)), '\n', substring(seq, 26))").alias("value")).write.text(path)
    f = src.read_fasta(spark, path)
    return f.select("name", "seq", F.round(src.frequency_of(F.col("description")), 4).alias("frequency"))


@query(with_tables("reads", "", "SELECT '>' || read_id || chr(10) || seq AS record FROM reads"))
def fastq_to_fasta(spark, sf):
    return src.fasta_lines(reads(spark, sf)).withColumnRenamed("value", "record")


@query(with_tables("graph", "", """SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line UNION ALL SELECT 'S' || chr(9) || read_id || chr(9) || seq FROM reads
    UNION ALL SELECT 'L' || chr(9) || v1 || chr(9) || '+' || chr(9) || v2 || chr(9) || '+' || chr(9) || len || 'M' FROM graph"""))  # fmt: skip
def gfa_lines(spark, sf):
    return src.gfa_lines(reads(spark, sf), graph(spark, sf))


@query(with_tables("overlaps graph", "", "SELECT (SELECT count(*) FROM reads) AS vertices, (SELECT count(*) FROM graph) AS edges, (SELECT count(*) FROM ovl) AS overlaps, 3 AS iteration"))
def iteration_stats(spark, sf):
    return analysis.iteration_stats(reads(spark, sf), graph(spark, sf), plain_overlaps(spark, sf), 3)


@query("SELECT event_id AS pos, 1 AS hap, event_type AS allele FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 2, event_type FROM events WHERE value IS NOT NULL")
def snps_by_hap(spark, sf):
    """Each row of a SNP table as seen from both haplotypes."""
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_id").alias("pos"), F.col("event_type").alias("allele"))
    return e.select("pos", F.explode(F.array(F.lit(1), F.lit(2))).alias("hap"), "allele")


@query(with_tables("variants", "", "SELECT block, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM variants GROUP BY block"))
def phase_blocks(spark, sf):
    """Blocks of a phasing file: a marker line opens each block, rows follow it."""
    v = variants(spark, sf)
    lines = v.select("pos", "block", F.lit(1).alias("kind")).union(v.groupBy("block").agg(F.min("pos").alias("pos")).select("pos", "block", F.lit(0).alias("kind")))
    order = Window.orderBy("pos", "kind")
    numbered = lines.withColumn("n_open", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(order)).where("kind = 1")
    return numbered.groupBy("n_open").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).select((F.col("n_open") - 1).cast("long").alias("block"), "first_pos", "last_pos", "n")
