"""Range and seeded joins as equi-joins with a residual predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import revcomp


def binned_range_join(intervals: DataFrame, points: DataFrame, low: Column, high: Column, point: Column, width: int, on: list[str] | None = None, extra: Column | None = None) -> DataFrame:
    """Pairs of an interval and a point with low <= point <= high, and equal columns `on`.

    Intervals are copied into each bin of `width` that they touch and points lie in one bin, so
    the join is an equi-join (shuffled or broadcast as the optimizer sees fit, split by AQE when
    a bin is hot) and no pair comes twice.
    """
    on = on or []
    left = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    right = points.withColumn("_bin", F.floor(point / width))
    residual = (point >= low) & (point <= high)
    if extra is not None:
        residual &= extra
    return left.join(right, ["_bin", *on]).where(residual).drop("_bin")


def start_overlaps(reads: DataFrame, length: int, most: int, on: list[str] | None = None) -> DataFrame:
    """(id1, id2, pos, len) of fixed-length reads whose starts lie at most `most` apart, the earlier first, ties by id."""
    keys = on or []
    a = reads.select(*keys, F.col("read_id").alias("id1"), F.col("start").alias("s1"))
    b = reads.select(*keys, F.col("read_id").alias("id2"), F.col("start").alias("s2"))
    both = binned_range_join(a, b, F.col("s1"), F.col("s1") + most, F.col("s2"), most + 1, keys, (F.col("s2") > F.col("s1")) | (F.col("id2") > F.col("id1")))
    return both.select(*keys, "id1", "id2", (F.col("s2") - F.col("s1")).alias("pos"), (F.lit(length) - (F.col("s2") - F.col("s1"))).alias("len"))


def kmers(reads: DataFrame, k: int, step: int = 1, prefix_only: bool = False) -> DataFrame:
    """(read_id, at, kmer): substrings of length k at 0-based places; prefix_only keeps each read's first."""
    places = F.sequence(F.lit(0), F.length("seq") - k, F.lit(step))
    at = F.lit(0) if prefix_only else F.explode(places)
    return reads.where(F.length("seq") >= k).select("read_id", at.alias("at"), "seq").select("read_id", "at", F.expr(f"substring(seq, at + 1, {k})").alias("kmer"))


def suffix_prefix(reads: DataFrame, min_len: int) -> DataFrame:
    """(id1, id2, pos, len): the suffix of read 1 from pos equals the prefix of read 2, over at least min_len bases.

    The first min_len bases of read 2 seed an equi-join with all substrings of read 1.
    """
    own = reads.select("read_id", "seq")
    right = own.where(F.length("seq") >= min_len).select(F.col("read_id").alias("id2"), F.substring("seq", 1, min_len).alias("kmer"))
    # ids alone meet in the seeds; sequences join what they find
    left = kmers(own, min_len).select(F.col("read_id").alias("id1"), "at", "kmer")
    found = left.join(right, "kmer").where("id1 <> id2").select("id1", "id2", "at")
    both = found.join(own.withColumnsRenamed({"read_id": "id1", "seq": "seq1"}), "id1").join(own.withColumnsRenamed({"read_id": "id2", "seq": "seq2"}), "id2")
    both = both.withColumn("len", F.least(F.length("seq1") - F.col("at"), F.length("seq2")))
    both = both.where(F.expr("substring(seq1, at + 1, len) = substring(seq2, 1, len)")).where("at > 0 OR id1 < id2")
    return both.select("id1", "id2", F.col("at").cast("long").alias("pos"), F.col("len").cast("long").alias("len"))


def suffix_prefix_approx(reads: DataFrame, min_len: int, mismatches: int) -> DataFrame:
    """(id1, id2, pos, len, mm): as suffix_prefix, with at most `mismatches` differing bases.

    Any such overlap has, among mismatches + 1 consecutive pieces of its first min_len bases,
    one without a difference; each piece is a seed. Every offset is then compared in full.
    """
    k = min_len // (mismatches + 1)
    own = reads.select("read_id", "seq")
    seeds = own.where(F.length("seq") >= min_len).select(F.col("read_id").alias("id2"), F.explode(F.array(*(F.lit(i * k) for i in range(mismatches + 1)))).alias("off"), "seq")
    seeds = seeds.select("id2", "off", F.expr(f"substring(seq, off + 1, {k})").alias("kmer"))
    left = kmers(own, k).select(F.col("read_id").alias("id1"), "at", "kmer")
    found = left.join(seeds, "kmer").where("id1 <> id2 AND at >= off").select("id1", "id2", (F.col("at") - F.col("off")).alias("pos")).distinct()
    found = found.join(own.withColumnsRenamed({"read_id": "id1", "seq": "a"}), "id1").join(own.withColumnsRenamed({"read_id": "id2", "seq": "b"}), "id2")
    found = found.withColumn("len", F.least(F.length("a") - F.col("pos"), F.length("b"))).where(F.col("len") >= min_len)
    mm = F.expr("size(filter(sequence(1, len), i -> substring(a, pos + i, 1) <> substring(b, i, 1)))")
    return found.withColumn("mm", mm).where(F.col("mm") <= mismatches).where("pos > 0 OR id1 < id2").select("id1", "id2", F.col("pos").cast("long"), F.col("len").cast("long"), F.col("mm").cast("long"))


def both_strands(reads: DataFrame) -> DataFrame:
    """(read_id, seq): each read under 2 * read_id, and its reverse complement under the next number."""
    own = reads.select("read_id", "seq")
    return own.select((F.col("read_id") * 2).alias("read_id"), "seq").unionAll(own.select((F.col("read_id") * 2 + 1).alias("read_id"), revcomp(F.col("seq")).alias("seq")))


def stranded_overlaps(reads: DataFrame, min_len: int, mismatches: int = 0, inclusions: bool = True) -> DataFrame:
    """(id1, id2, ori1, ori2, pos, len, mm): overlaps of reads and of reverse complements, each once.

    The same overlap seen from the other strand has both reads turned and may have them in the
    other order; of the two views the one with fewer turned reads, then of the least ids, stays.
    Reads do not overlap themselves. Without inclusions, overlaps in which one read lies wholly
    within the other are left out.
    """
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("n"))
    o = suffix_prefix_approx(both_strands(reads), min_len, mismatches)
    o = o.withColumns({"a": F.expr("id1 div 2"), "b": F.expr("id2 div 2")}).where("a <> b")
    o = o.join(lengths.withColumnsRenamed({"read_id": "a", "n": "n1"}), "a").join(lengths.withColumnsRenamed({"read_id": "b", "n": "n2"}), "b")
    beyond = F.col("pos") + F.col("n2") - F.col("n1")  # by how much the second read ends after the first
    if not inclusions:
        o = o.where((F.col("pos") > 0) & (beyond > 0))
    turned = lambda v: v.bitwiseXOR(F.lit(1))
    view = lambda x, y, pos: F.struct((x % 2 + y % 2).alias("turns"), (x % 2).alias("s1"), x.alias("x"), y.alias("y"), pos.cast("long").alias("pos"))
    x, y = turned(F.col("id1")), turned(F.col("id2"))
    other = F.when(beyond > 0, view(y, x, beyond)).when(beyond < 0, view(x, y, -beyond)).otherwise(view(F.least(x, y), F.greatest(x, y), F.lit(0)))
    best = o.select(F.least(view(F.col("id1"), F.col("id2"), F.col("pos")), other).alias("v"), "len", "mm").distinct()
    ori = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    return best.select(F.expr("v.x div 2").alias("id1"), F.expr("v.y div 2").alias("id2"), ori("v.x").alias("ori1"), ori("v.y").alias("ori2"), "v.pos", "len", "mm")


def interval_overlaps(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of overlapping closed intervals; each pair is found in the first bin that both touch."""
    l = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a[0]) / width), F.floor(F.col(a[1]) / width))))
    r = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(b[0]) / width), F.floor(F.col(b[1]) / width))))
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return l.join(r, "_bin").where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("_bin") == first)).drop("_bin")
