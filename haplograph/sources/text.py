"""Text formats as DataFrames. Every reader takes any path that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records of each file block with their place in it, and the halves that its borders cut.

    A record that a border cuts has its place in the block of its tail.
    """
    where, open_head, fresh, at = None, None, True, 0
    for pdf in frames:
        out = []

        def close() -> None:
            if open_head is not None:
                out.append((*where, None, "head", open_head))

        for file, block, piece in zip(pdf["file"], pdf["block"], pdf["value"]):
            if (file, block) != where:
                close()
                where, open_head, fresh, at = (file, block), None, True, 0
            piece = piece.rstrip("\r\n")
            if open_head is not None:
                piece, open_head = f"{open_head}\n@{piece}", None
            if not piece:
                continue
            lines = [x.rstrip("\r") for x in piece.split("\n")]
            if len(lines) == 4 and lines[2].startswith("+") and len(lines[1]) == len(lines[3]):
                out.append((*where, at, "record", "\n".join(lines)))
                at += 1
            elif len(lines) == 3 and lines[2].startswith("+"):
                open_head = "\n".join(lines)  # its quality line begins with @
            elif fresh and block > 0 and len(lines) == 1:
                out.append((*where, at, "tail", lines[0]))
                at += 1
            else:
                raise ValueError(f"not a FASTQ record in {file}: {piece[:80]!r}")
            fresh = False
        yield pd.DataFrame(out, columns=_RECORD)
    if open_head is not None:
        yield pd.DataFrame([(*where, None, "head", open_head)], columns=_RECORD)


_RECORD = ["file", "block", "at", "kind", "body"]


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, read_id, seq, qual) of four-line records, as they are.

    Files are split at lines that begin with @. Where that is a quality line, its record's
    halves follow one another in a block and are joined there; the few that a block's border
    parts meet in a window over those halves alone.
    """
    raw = spark.read.option("lineSep", "\n@").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = raw.mapInPandas(_records, "file string, block long, at long, kind string, body string")
    whole = rows.where("kind = 'record'").select("file", "block", "at", "body")
    w = Window.partitionBy("file").orderBy("block", F.expr("IF(kind = 'tail', 0, 1)"))
    halves = rows.where("kind <> 'record'").withColumn("head", F.lag("body").over(w)).where("kind = 'tail'")
    lines = whole.union(halves.select("file", "block", "at", F.concat("head", F.lit("\n@"), "body").alias("body"))).select("file", "block", "at", F.split("body", "\n").alias("r"))
    line = lambda i: F.get("r", F.lit(i))
    name = F.regexp_extract(F.regexp_replace(line(0), "^@", ""), r"^(\S+)", 1)
    good = (name != "") & (F.length(line(1)) > 0)
    named = F.when(good, name).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), line(0))))
    return lines.select("file", "block", "at", named.alias("read_id"), line(1).alias("seq"), line(3).alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, qual) of four-line records, sequences in upper case."""
    return _fastq(spark, path).select("read_id", F.upper("seq").alias("seq"), "qual")


def _placed(records: DataFrame) -> DataFrame:
    """Adds place: a record's number in all files by name. One row for each block of a file is summed up in one task."""
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = records.groupBy("file", "block").agg((F.max("at") + 1).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    return records.join(first, ["file", "block"]).withColumn("place", F.col("first") + F.col("at"))


def read_fastq_pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """(read_id, seq1, qual1, seq2, qual2): the mates of two files, record by record, letters as they are.

    The files must list the same ids in the same order; another id at a place, or none, is an error.
    """
    a = _placed(_fastq(spark, path1)).select("place", F.col("read_id").alias("a"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = _placed(_fastq(spark, path2)).select("place", F.col("read_id").alias("b"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    j = a.join(b, "place", "full_outer")
    wrong = F.raise_error(F.concat(F.lit("mates are not in the same order: "), F.coalesce("a", F.lit("none")), F.lit(" and "), F.coalesce("b", F.lit("none"))))
    return j.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(wrong).alias("read_id"), "seq1", "qual1", "seq2", "qual2")


def fastq_lines(reads: DataFrame, id_col: str = "read_id") -> DataFrame:
    """One value of four lines for each read (id, seq, qual)."""
    return reads.select(F.concat(F.lit("@"), F.col(id_col).cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, id_col: str = "read_id") -> None:
    fastq_lines(reads, id_col).write.text(path)


def fasta_lines(reads: DataFrame, id_col: str = "read_id") -> DataFrame:
    return reads.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), "seq").alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq): records at lines that begin with >, wrapped sequence lines joined, upper case."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("length(trim(value)) > 0")
    head = F.regexp_replace("value", "^>", "")
    line = F.regexp_extract(head, r"^([^\r\n]*)", 1)
    return raw.select(F.regexp_extract(line, r"^(\S+)", 1).alias("name"), line.alias("description"), F.upper(F.regexp_replace(F.regexp_replace(head, r"^[^\n]*\n?", ""), r"\s+", "")).alias("seq"))


def frequency_of(description):
    """The number after frequency= in a record's description."""
    return F.regexp_extract(description, r"frequency=([0-9.eE+-]+)", 1).cast("double")


OVERLAP_COLUMNS = ("id1 long, id2 long, pos1 int, pos2 int, ord string, ori1 string, ori2 string, perc1 int, perc2 int, len1 int, len2 int, type1 string, type2 string").split(", ")


def parse_overlaps(lines: DataFrame) -> DataFrame:
    """The 13 columns of overlap lines (value); lines of other widths are passed over, '-' means 0."""
    f = lines.select(F.split("value", r"\s+").alias("f")).where(F.size("f") == 13)
    cols = []
    for i, spec in enumerate(OVERLAP_COLUMNS):
        name, kind = spec.split()
        own = F.col("f")[i]
        cols.append((own if kind == "string" else F.when(own == "-", "0").otherwise(own).cast(kind)).alias(name))
    return f.select(*cols)


def overlap_lines(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(F.concat_ws("\t", *(F.col(c.split()[0]).cast("string") for c in OVERLAP_COLUMNS)).alias("value")).distinct()


def validate_overlaps(overlaps: DataFrame) -> DataFrame:
    """Adds valid: signs, shares, orders, orientations and types are possible together."""
    paired = (F.col("type1") == "p") & (F.col("type2") == "p")
    ok = (
        (F.col("id1") >= 0) & (F.col("id2") >= 0) & (F.col("pos1") >= 0) & (F.col("pos2") >= 0) & F.col("perc1").between(0, 100) & F.col("perc2").between(0, 100)
        & F.col("ori1").isin("+", "-") & F.col("ori2").isin("+", "-") & F.col("type1").isin("s", "p") & F.col("type2").isin("s", "p")
        & F.when(paired, F.col("ord").isin("1", "2")).otherwise(F.col("ord") == "-")
    )
    return overlaps.withColumn("valid", ok)


def parse_subreads(lines: DataFrame) -> DataFrame:
    """(read_id, orig_id, forward, idx1, idx2, len1, len2) of lineage lines: id, then orig:+:idx[,idx]:len[,len] tokens."""
    t = lines.select(F.split("value", "\t").alias("f")).select(F.col("f")[0].cast("long").alias("read_id"), F.explode(F.expr("slice(f, 2, size(f) - 1)")).alias("t"))
    p = t.select("read_id", F.split("t", "[:,]").alias("p")).where("size(p) IN (4, 6)")
    two = F.size("p") == 6
    at = lambda i: F.get("p", F.lit(i)).cast("long")
    return p.select("read_id", at(0).alias("orig_id"), (F.col("p")[1] == "+").alias("forward"), at(2).alias("idx1"), F.when(two, at(3)).alias("idx2"), F.when(two, at(4)).otherwise(at(3)).alias("len1"), F.when(two, at(5)).alias("len2"))


def subread_lines(subreads: DataFrame) -> DataFrame:
    """Lineage lines of (read_id, orig_id, forward, idx, len), originals in order of id."""
    token = F.concat_ws(":", F.col("orig_id").cast("string"), F.when(F.col("forward"), "+").otherwise("-"), F.col("idx").cast("string"), F.col("len").cast("string"))
    g = subreads.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("orig_id", token.alias("t")))).alias("t"))
    return g.select(F.concat_ws("\t", F.col("read_id").cast("string"), F.array_join(F.transform("t", lambda x: x["t"]), "\t")).alias("value"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of an edge file: the two leading counts have no comma; loops are rejected."""
    f = spark.read.text(path).where(F.col("value").contains(",")).select(F.split("value", ",").alias("f"))
    e = f.select(F.trim(F.col("f")[0]).cast("long").alias("u"), F.trim(F.col("f")[1]).cast("long").alias("v"))
    return e.where(F.when(F.col("u") == F.col("v"), F.raise_error(F.lit("a loop in the edge file"))).otherwise(F.lit(True)))


def parse_metis(lines: DataFrame) -> DataFrame:
    """(u, v), 0-based, of adjacency lines (vertex, value): 1-based neighbours, % lines left out."""
    n = lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select("vertex", F.explode(F.split(F.trim("value"), r"\s+")).alias("x"))
    return n.select((F.col("vertex") - 1).alias("u"), (F.col("x").cast("long") - 1).alias("v"))


def gfa_lines(reads: DataFrame, edges: DataFrame) -> DataFrame:
    """Header, one S line for each read (read_id, seq), one L line for each edge (v1, v2, len)."""
    spark = reads.sparkSession
    head = spark.range(1).select(F.lit("H\tVN:Z:1.0").alias("line"))
    s = reads.select(F.concat_ws("\t", F.lit("S"), F.col("read_id").cast("string"), "seq").alias("line"))
    e = edges.select(F.concat(F.lit("L\t"), F.col("v1").cast("string"), F.lit("\t+\t"), F.col("v2").cast("string"), F.lit("\t+\t"), F.col("len").cast("string"), F.lit("M")).alias("line"))
    return head.union(s).union(e)


SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def read_sam(spark: SparkSession, path: str, drop: int = 4) -> DataFrame:
    """The 11 columns of alignment lines; headers and rows with any flag bit of drop are left out."""
    f = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    numbers = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [(F.col("f")[i].cast("long") if c in numbers else F.col("f")[i]).alias(c) for i, c in enumerate(SAM_COLUMNS)]
    return f.select(*cols).where(F.col("flag").bitwiseAND(F.lit(drop)) == 0)


def genotype(format_col, sample_col):
    """The GT field of a sample, by its place in the format."""
    return F.get(F.split(sample_col, ":"), F.array_position(F.split(format_col, ":"), "GT").cast("int") - 1)


def alleles(gt):
    """The alleles of a genotype, phased or not."""
    return F.split(gt, r"[|/]")
