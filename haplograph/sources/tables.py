"""Readers and writers of the tabular formats around an assembly: alignments, variants, phasing, depth, thresholds and graphs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the lines of text files and their numbers, from 0, in all files by name.

    Within a file block lines keep their order; one row for each block is summed up in one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = raw.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n")).select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return raw.join(first, ["file", "block"]).select("file", "block", (F.col("base") + F.col("at") - F.col("least")).alias("line"), "value")


def _columns(lines: DataFrame, schema: str, separator: str) -> DataFrame:
    """Typed columns of the lines that have as many fields; others are passed over."""
    names = [x.split() for x in schema.split(", ")]
    f = lines.select(F.split(F.trim("value") if separator == r"\s+" else F.col("value"), separator).alias("f")).where(F.size("f") == len(names))
    return f.select(*(F.col("f")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(new_id, old_id) of a correspondence; a leading > of the old id goes."""
    return _columns(spark.read.text(path), "new_id long, old_id string", "\t").withColumn("old_id", F.regexp_replace("old_id", "^>", ""))


def mapped_ids(rows: DataFrame, ids: DataFrame, id_col: str = "read_id") -> DataFrame:
    """rows with id_col replaced by new ids; an id without a correspondence is an error."""
    j = rows.join(ids.withColumnRenamed("old_id", id_col), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no correspondence for "), F.col(id_col).cast("string")))
    return j.withColumn(id_col, F.when(F.col("new_id").isNull(), missing).otherwise(F.col("new_id"))).select(*rows.columns)


def read_sfo(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark.read.text(path), "id_a long, id_b long, ori string, oha long, ohb long, ola long, olb long, k long", r"\s+")


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark.read.text(path), "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, qlen long, slen long", "\t")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark.read.text(path), "qseqid string, qlen long, qstart long, qend long, qori string, sseqid string, slen long, sstart long, send long, matches long, length long, qual long, cigar string", "\t")


def read_snps(spark: SparkSession, path: str, skip_indels: bool = False) -> DataFrame:
    """(hap, pos): each difference at its place in both haplotypes; lines pos1 base1 base2 pos2 ... hap1 hap2."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where((F.size("f") >= 6) & F.col("f")[0].try_cast("long").isNotNull())
    if skip_indels:
        f = f.where((F.col("f")[1] != ".") & (F.col("f")[2] != "."))
    side = lambda hap, pos: F.struct(F.element_at("f", hap).alias("hap"), F.col("f")[pos].cast("long").alias("pos"))
    return f.select(F.inline(F.array(side(-2, 0), side(-1, 3))))


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((seq_id, ref_id, pos, ori, cigar) with pos from 0, (seq_id) of unmapped sequences) of alignment lines."""
    f = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", r"\s+").alias("f")).where("size(f) >= 6").withColumn("flag", F.col("f")[1].cast("int"))
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    ori = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")
    aligned = f.where(~unmapped).select(F.col("f")[0].alias("seq_id"), F.col("f")[2].alias("ref_id"), (F.col("f")[3].cast("long") - 1).alias("pos"), ori.alias("ori"), F.col("f")[5].alias("cigar"))
    return aligned, f.where(unmapped).select(F.col("f")[0].alias("seq_id"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, format, sample) of the lines below the headers."""
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where("size(f) >= 10")
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), F.col("f")[8].alias("format"), F.col("f")[9].alias("sample"))


def in_region(variants: DataFrame, start: int, end: int, gt_col: str = "gt") -> DataFrame:
    """Phased variants from start to end, both included."""
    return variants.where(F.col("pos").between(start, end) & F.col(gt_col).contains("|"))


def read_phasing(spark: SparkSession, path: str, first_allele: int = 1) -> DataFrame:
    """(idx, phase, block): rows of alleles in blocks that lines with B begin; lines with * are passed over.

    Rows with an unphased allele, or an allele number as large as the ploidy, are no result.
    Alleles are counted from first_allele. A block's number is that of the B lines so far.
    """
    rows = numbered(spark, path).withColumn("b", F.col("value").startswith("B").cast("long"))
    sums = Window.orderBy("file", "fb").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumnRenamed("block", "fb")
    base = rows.groupBy("file", "fb").agg(F.sum("b").alias("n")).select("file", "fb", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "fb").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own", F.sum("b").over(inside)).join(base, ["file", "fb"]).where("b = 0 AND NOT startswith(value, '*')")
    f = rows.select((F.col("base") + F.col("own")).alias("block"), F.split(F.rtrim("value"), "\t").alias("f")).where("size(f) > 1")
    alleles = F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.try_cast("int") - first_allele)
    f = f.select(F.col("f")[0].cast("long").alias("idx"), alleles.alias("a"), "block").where(~F.exists("a", lambda x: x.isNull()) & (F.array_max("a") < F.size("a")))
    return f.select("idx", F.array_join(F.col("a").cast("array<string>"), "|").alias("phase"), "block")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark.read.text(path), "chrom string, pos long, depth long", "\t")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(dist, min_ev): first and third column of an evidence table; # lines are comments."""
    return _columns(spark.read.text(path).where(~F.col("value").startswith("#")), "dist long, expected long, min_ev long", "\t").select("dist", "min_ev")


# ---- graphs ----------------------------------------------------------------------------------


def _no_loop(u: Column, v: Column) -> Column:
    return F.when(u == v, F.raise_error(F.concat(F.lit("a loop at vertex "), u.cast("string")))).otherwise(F.lit(True))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """(u, v), from 0, both directions of each e line."""
    e = spark.read.text(path).where(F.col("value").startswith("e")).select(F.split(F.trim("value"), r"\s+").alias("f")).select((F.col("f")[1].cast("long") - 1).alias("u"), (F.col("f")[2].cast("long") - 1).alias("v"))
    e = e.where(_no_loop(F.col("u"), F.col("v")))
    return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """(u, v), from 0: the header is the first line that is neither empty nor a % comment, and each line after it lists a vertex's neighbours."""
    lines = numbered(spark, path)
    found = lines.where(~F.col("value").startswith("%") & (F.length("value") > 0)).orderBy("line").select("line", "value").first()
    if found is None:
        raise ValueError(f"no vertices and edges are told in {path}")
    n = int(found["value"].split()[0])
    own = lines.where(F.col("line").between(found["line"] + 1, found["line"] + n)).select((F.col("line") - found["line"] - 1).alias("u"), F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1)).alias("v"))
    return own.select("u", (F.col("v").cast("long") - 1).alias("v")).where(_no_loop(F.col("u"), F.col("v")))


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """(place, vertex) of a file with a vertex in each line."""
    return numbered(spark, path).select(F.col("line").alias("place"), F.trim("value").cast("long").alias("vertex"))


def edges_of_stream(spark: SparkSession, stream: Iterable[str], chunk: int = 100_000) -> DataFrame:
    """(u, v) of the edge lines u,v of an open stream, such as standard input; the two leading counts have no comma.

    A stream is read by the driver, in chunks, of which each becomes a part of the result.
    """
    out = spark.createDataFrame([], "u long, v long")
    rest = iter(stream)
    while lines := list(islice(rest, chunk)):
        pairs = [tuple(map(int, x.split(","))) for x in lines if "," in x]
        if any(u == v for u, v in pairs):
            raise ValueError("a loop in the edge lines")
        out = out.unionAll(spark.createDataFrame(pairs, "u long, v long"))
    return out


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _headed(spark: SparkSession, heads: list[str], body: DataFrame, *order: str) -> DataFrame:
    """Lines in order: heads, then body's value."""
    top = spark.createDataFrame(list(enumerate(heads)), "o long, value string")
    lines = top.select(F.lit(0).alias("_part"), *(F.col("o").alias(f"_{c}") for c in order), "value").unionAll(body.select(F.lit(1), *order, "value"))
    return lines.orderBy("_part", *(f"_{c}" for c in order)).select("value")


def edge_file_lines(pairs: DataFrame, vertices: int) -> DataFrame:
    """An undirected graph (u, v): the number of vertices, of directed edges, and a line u,v for each."""
    both = _both(pairs)
    return _headed(pairs.sparkSession, [str(vertices), str(both.count())], both.withColumn("value", F.concat_ws(",", "u", "v")), "u", "v")


def digraph_lines(edges: DataFrame) -> DataFrame:
    """v1, tab, v2 for each edge, in order."""
    return edges.orderBy("v1", "v2").select(F.concat_ws("\t", "v1", "v2").alias("value"))


def snap_lines(pairs: DataFrame) -> DataFrame:
    """Both directions of an undirected graph, tab-separated, in order."""
    return _both(pairs).orderBy("u", "v").select(F.concat_ws("\t", "u", "v").alias("value"))


def metis_lines(pairs: DataFrame, vertices: int) -> DataFrame:
    """Vertices and undirected edges, then each vertex's neighbours from 1 in order, vertices without any included."""
    both = _both(pairs)
    lists = both.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: (v + 1).cast("string")), " ").alias("value"))
    everyone = pairs.sparkSession.range(vertices).withColumnRenamed("id", "u").join(lists, "u", "left").select("u", F.coalesce("value", F.lit("")).alias("value"))
    return _headed(pairs.sparkSession, [f"{vertices} {both.count() // 2}"], everyone, "u")


def dimacs_lines(pairs: DataFrame, vertices: int) -> DataFrame:
    """p edge n m, then e u v, from 1, once for each undirected edge."""
    once = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return _headed(pairs.sparkSession, [f"p edge {vertices} {once.count()}"], once.withColumn("value", F.concat_ws(" ", F.lit("e"), F.col("u") + 1, F.col("v") + 1)), "u", "v")


def clique_lines(cliques: DataFrame) -> DataFrame:
    """The members of each clique, in order, in a line."""
    return cliques.select(F.array_join(F.array_sort("members").cast("array<string>"), " ").alias("value"))


def cycle_lines(removed: DataFrame) -> DataFrame:
    """The edges (u, v) that were taken out to break cycles, tab-separated."""
    return removed.orderBy("u", "v").select(F.concat_ws("\t", "u", "v").alias("value"))


def fastg_lines(reads: DataFrame, edges: DataFrame) -> DataFrame:
    """A record for each read (read_id, seq), its header naming the reads that follow it (v1, v2)."""
    after = edges.groupBy(F.col("v1").alias("read_id")).agg(F.concat(F.lit(":"), F.array_join(F.transform(F.array_sort(F.collect_set("v2")), lambda v: F.concat(F.lit("NODE_"), v.cast("string"))), ",")).alias("next"))
    return reads.join(after, "read_id", "left").orderBy("read_id").select(F.concat(F.lit(">NODE_"), F.col("read_id").cast("string"), F.coalesce("next", F.lit("")), F.lit(";\n"), "seq").alias("value"))
