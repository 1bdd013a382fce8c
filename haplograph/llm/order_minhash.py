"""Document fingerprints by Order MinHash, in DataFrame and SQL functions alone.

k-mers of words are numbered by occurrence, so that repeats count, and hashed. The hash's top
bits deal them to bins (one permutation for all bins); each bin keeps its l least k-mers, puts
them back in text order and hashes that tuple. A bin of two texts agrees when the same k-mers
stand in the same order, so agreement falls with edit distance, not only with set difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a k-mer, and bits of the number of bins. Two k-mers of each bin are kept.
KMER = 3
BIN_BITS = 6
#: Low bits of a packed hash that hold the k-mer's place in the text.
PLACE_BITS = 26
#: Rows of a bucket of neighbouring ids on average, and most buckets (then they hold more rows).
BUCKET_ROWS, BUCKETS = 512, 1 << 16


def signature(text: str, kmer: int = KMER, bin_bits: int = BIN_BITS) -> Column:
    """The sorted array of bin hashes (bin in the top bits) of a SQL expression's text; null counts as empty.

    A text of fewer words than a k-mer is one k-mer. transform(array(x), v -> ...)[0] names a
    value, so that it is computed once.
    """
    place = (1 << PLACE_BITS) - 1
    key = f"{~place}L"
    grams = ", ".join(f"get(w, i + {k})" for k in range(kmer))
    steps = ", ".join(str(1 << b) for b in range(PLACE_BITS - 1, -1, -1))
    bins = lambda x: f"shiftrightunsigned({x}, {64 - bin_bits})"
    hashed = f"sort_array(transform(sequence(0, greatest(size(w) - {kmer}, 0)), i -> (xxhash64({grams}) & {key}) | CAST(i & {place} AS BIGINT)))"
    number = f"IF(i > 0 AND (get(p, i - 1) & {key}) = (x & {key}), aggregate(array({steps}), 0, (d, s) -> IF(i - d - s >= 0 AND (get(p, i - d - s) & {key}) = (x & {key}), d + s, d)), 0)"
    numbered = f"sort_array(transform(p, (x, i) -> (xxhash64(x & {key}, {number}) & {key}) | (x & {place}L)))"
    least = f"filter(s, (x, i) -> i < 2 OR {bins('get(s, i - 2)')} <> {bins('x')})"
    order = f"IF((get(e, i - 1) & {place}L) < (x & {place}L), xxhash64(get(e, i - 1) & {key}, x & {key}), xxhash64(x & {key}, get(e, i - 1) & {key}))"
    tuple_hash = f"IF(i > 0 AND {bins('get(e, i - 1)')} = {bins('x')}, {order}, xxhash64(x & {key}))"
    last = f"(i = size(e) - 1 OR {bins('get(e, i + 1)')} <> {bins('x')})"
    joined = f"filter(transform(e, (x, i) -> IF({last}, shiftleft({bins('x')}, {64 - bin_bits}) | shiftrightunsigned({tuple_hash}, {bin_bits}), NULL)), y -> y IS NOT NULL)"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    words = f"split(trim(coalesce({text}, '')), '\\\\s+')"
    return F.expr(let(words, "w", let(hashed, "p", let(numbered, "s", let(least, "e", joined)))))


def fingerprint(sig: str) -> Column:
    """The signature as a string."""
    return F.expr(f"array_join(transform({sig}, x -> lower(hex(x))), ',')")


def likeness(a: str, b: str, bin_bits: int = BIN_BITS) -> Column:
    """The share of agreeing bins among those that either text fills, 0 to 1."""
    shift = 64 - bin_bits
    same = f"size(array_intersect({a}, {b}))"
    both = f"size(array_intersect(transform({a}, x -> shiftrightunsigned(x, {shift})), transform({b}, x -> shiftrightunsigned(x, {shift}))))"
    return F.expr(f"CAST({same} AS DOUBLE) / greatest(size({a}) + size({b}) - {both}, 1)")


def dealt(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with columns bucket and ghost: buckets of neighbouring ids, and a copy (ghost) of each bucket's first row.

    Buckets are cut at quantiles of the ids, so that they hold about as many rows each however
    the ids are spread; rows of one id share a bucket. The copy stands in the bucket before (by
    ascending id; that of the first of all in the last), so that every row finds its next by
    descending id in its own bucket. A null id has the lowest bucket. The cuts, and the list of
    one id for each bucket that finds the copies, have BUCKETS entries at most.
    """
    n = docs.agg(F.count(id_col)).first()[0]
    wanted = min(BUCKETS // 2, max(1, -(-n // BUCKET_ROWS)))
    cuts: list[int] = []
    if wanted > 1:
        shares = ",".join(repr(k / wanted) for k in range(1, wanted))
        found = docs.agg(F.expr(f"percentile_approx({id_col}, CAST(split('{shares}', ',') AS ARRAY<DOUBLE>), {max(10_000, 8 * wanted)})")).first()[0]
        cuts = sorted(set(found))
    steps = ", ".join(str(1 << b) for b in range(max(len(cuts).bit_length() - 1, 0), -1, -1))
    listed = f"CAST(split('{','.join(map(str, cuts))}', ',') AS ARRAY<BIGINT>)"
    place = f"aggregate(array({steps}), 0, (d, s) -> IF(get({listed}, d + s - 1) <= {id_col}, d + s, d))" if cuts else "0"
    bucket = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.expr(place)).cast("long")
    tops = docs.select(id_col, bucket.alias("bucket")).groupBy("bucket").agg(F.max(id_col).alias("top_id"))
    line = Window.orderBy(F.desc("bucket"))
    everyone = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    targets = tops.select("top_id", F.coalesce(F.lag("bucket").over(line), F.last("bucket").over(everyone)).alias("target"))
    ghosts = docs.join(F.broadcast(targets), docs[id_col].eqNullSafe(F.col("top_id"))).drop("top_id").withColumnRenamed("target", "bucket")
    return docs.withColumn("bucket", bucket).withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))


def with_next(rows: DataFrame, carried: list[str], id_col: str = "doc_id") -> DataFrame:
    """dealt() rows with a column next, the carried columns of the next row by descending id, and without the copies.

    After the last row comes the first. A null id comes last; rows of one id are ordered by the
    hash of the first carried column.
    """
    order = Window.partitionBy("bucket").orderBy("ghost", F.col(id_col).desc_nulls_last(), F.xxhash64(carried[0]))
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(order)).where(~F.col("ghost")).drop("bucket", "ghost")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and likeness to that and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, by descending id. Null texts count as empty; equal texts have
    equal fingerprints. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = dealt(own).select("doc_id", "text", "bucket", "ghost", signature("text").alias("sig"))
    paired = with_next(own, ["text", "sig"])
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next.text, 1, n_chars div 2))")
    paired = paired.withColumn("n_chars", F.char_length("text").cast("int")).select("doc_id", "n_chars", "sig", F.col("next.sig").alias("next_sig"), edited.alias("edited"))
    paired = paired.select("doc_id", "n_chars", "sig", "next_sig", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature("edited").alias("edited_sig"))
    return paired.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint("sig").alias("fingerprint"),
        fingerprint("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
