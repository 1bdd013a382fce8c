"""The queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import context_mixing, decontaminate, html_extract, order_minhash, packing, rangecoder, sharding, superminhash, token_counts, toxicity
from .common import table


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts share a shard."""
    shards = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with its suffix sums."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size, its component under links of similarity 0.8 over two words, and whether it stays."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, count and digest of ids, read back from the coded files; end id 2."""
    return rangecoder.round_trip(table(spark, sf_dir, "documents"), end_id=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, hit words and benchmark items whose windows it holds."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with end id 1, in sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=1)


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of the documents outside remainder 0, beside the smoothed unigram's."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text, with their likeness and that to the next document."""
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a network that learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=toxicity.held_out_fold(F.col("doc_id")))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", toxicity.held_out_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minimax_shards": op1_minimax_shards,
    "op2_token_counts": op2_token_counts,
    "op3_superminhash": op3_superminhash,
    "op4_range_coder": op4_range_coder,
    "op5_decontaminate": op5_decontaminate,
    "op6_vector_packing": op6_vector_packing,
    "op7_context_mixing": op7_context_mixing,
    "op8_order_minhash": op8_order_minhash,
    "op9_html_min_cut": op9_html_min_cut,
    "op10_toxicity": op10_toxicity,
}

#: Lower-casing of A-Z alone, in DuckDB.
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicate_sql(words: int, relation: str = "documents") -> str:
    """(doc_id, n_shingles, component_id, kept) by an exact self-join of all shingles."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER_SQL}, ''), '[^\x20\x09-\x0D]+') AS w FROM {relation}),
    l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
          ELSE list_distinct([{gram} FOR i IN range(1, len(w) - {words - 2})]) END AS s FROM w),
    s AS (SELECT doc_id, unnest(s) AS s FROM l),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
    r AS (SELECT DISTINCT a AS v, a AS r FROM e UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.v),
    c AS (SELECT v, min(r) AS c FROM r GROUP BY 1)
    SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
    FROM l d LEFT JOIN c ON c.v = d.doc_id"""


def decontaminate_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by joining all windows."""
    words = rf"regexp_extract_all(coalesce({LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH iw AS (SELECT item_id, {words} AS w FROM {items} WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT k FROM win),
    dw AS (SELECT doc_id, {words} AS w FROM {docs}),
    dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
    m AS (SELECT DISTINCT doc_id, i, k, item_id FROM dg JOIN win USING (k, s)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
           sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate_sql(),
    "op3_superminhash": near_duplicate_sql(2),
}
