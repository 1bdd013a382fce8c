"""MinHash near-duplicate detection with SuperMinHash signatures.

Every element of a set draws a random permutation of the signature's positions. At level j it
offers the value j + r at the j-th position of its permutation, so that a set fills positions
evenly. A set stops at the first level that no position can still gain from: after one or two
levels for a usual document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.fixpoint import connected_components as components
from .common import SPACED, Words, cut, freeing, mix, shingles, text_steps

#: Positions of a signature, and of one band: a pair at similarity 0.8 shares none of 24 bands once in 300,000 times.
POSITIONS, BAND = 96, 4
#: Sets, and shingles of all of them, that one task compares with one another; a larger cluster is compared in pairs of blocks of half of that.
CLUSTER, CLUSTER_SHINGLES = 4096, 1 << 22


def signatures(elements: np.ndarray, first: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """SuperMinHash signatures (sets x m, uint64: level in the high 16 bits) of sets of 64-bit hashes.

    first: first element of each set, and one past the last. An empty set has all ones.
    """
    n = len(first) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * m, top, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    items = elements
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(items):
            break
        draw = mix(items + np.uint64(((j + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        value = np.uint64(j << 48) | (draw >> np.uint64(16))
        swap = j + (mix(draw) % np.uint64(m - j)).astype(np.int64)
        rows = np.arange(len(items))
        if perm is None:
            at = swap  # level 0: the permutation is still the identity
        else:
            at = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[:, j]
        np.minimum.at(sig, owner * m + at, value)
        # a set goes on while a position holds more than the next level's least value
        open_sets = (sig.reshape(n, m).max(axis=1) >> np.uint64(48)) > np.uint64(j)
        go = open_sets[owner]
        if perm is None:
            items, owner, swap = items[go], owner[go], swap[go]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(items), 1))
            perm[np.arange(len(items)), swap] = 0
        else:
            items, owner, perm = items[go], owner[go], perm[go]
    return sig.reshape(n, m)


def _fold(values: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each row."""
    out = np.full(len(values), np.uint64(seed), np.uint64)
    for i in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return out


def _sketch_batches(words: int, m: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, data, offsets in text_steps(texts):
                sets, first = shingles(Words(data, offsets, SPACED), words)
                size = np.diff(first)
                sig = signatures(sets, first, m)
                keys = np.stack([_fold(sig[:, b : b + band], b + 1) for b in range(0, m, band)], axis=1)
                # two independent sums over a set's elements name the set
                one, two = mix(sets + np.uint64(7)), mix(sets + np.uint64(11))
                safe = np.minimum(first[:-1], max(len(sets) - 1, 0))
                names = [np.where(size > 0, np.add.reduceat(x, safe), np.uint64(0)) if len(sets) else np.zeros(j - i, np.uint64) for x in (one, two)]
                flat = pa.array(keys.reshape(-1).view(np.int64))
                step = m // band
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in names), pa.ListArray.from_arrays(pa.array(np.arange(0, step * (j - i) + 1, step, dtype=np.int32)), flat)],
                    names=["doc_id", "n_shingles", "hi", "lo", "bands"],
                )

    return run


def sketch(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", m: int = POSITIONS, band: int = BAND) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, bands): each document's set size, 128-bit set name and band hashes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(_sketch_batches(words, m, band)), "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _linked(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that span the components of the sets under 100 * intersection >= percent * union.

    An inverted index gives one set's intersections with all others at once. Sets that the
    best-covered one links to need no look of their own: a link between two of them changes
    nothing, and a link to any other set is found from that one's side.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    posting = owner[order]
    value, begin, many = np.unique(flat[order], return_index=True, return_counts=True)
    at = np.searchsorted(value, flat)
    edge = np.concatenate([[0], np.cumsum(size)])
    cover = np.add.reduceat(many[at], edge[:-1]) / size
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []

    def look(x: int) -> None:
        own = at[edge[x] : edge[x + 1]]
        lens = many[own]
        index = np.arange(lens.sum()) + np.repeat(begin[own] - (np.cumsum(lens) - lens), lens)
        both = np.bincount(posting[index], minlength=len(sets))
        for y in np.flatnonzero(100 * both >= percent * (size + size[x] - both)):
            a, b = find(x), find(int(y))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))

    centre = int(np.argmax(cover))
    look(centre)
    if len(sets) > 2 or not out:
        main = find(centre)
        for x in sorted((x for x in range(len(sets)) if find(x) != main), key=lambda x: -cover[x]):
            look(x)
    return out


def _verify_groups(words: int, percent: int):
    def flush(ids: list[np.ndarray], texts: list[pa.Array]) -> list[tuple[int, int]]:
        keys = np.concatenate(ids)
        if len(keys) < 2:
            return []
        sets: list[np.ndarray] = []
        for _, _, data, offsets in text_steps(pa.concat_arrays(texts)):
            flat, first = shingles(Words(data, offsets, SPACED), words)
            sets += [flat[first[k] : first[k + 1]] for k in range(len(first) - 1)]
        return _linked(sets, keys, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, texts = None, [], []
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            found: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.diff(g)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if a == b:
                    continue
                if g[a] != group:
                    if ids:
                        found += flush(ids, texts)
                    group, ids, texts = g[a], [], []
                ids.append(node[a:b])
                texts.append(batch.column(2).slice(a, b - a).cast(pa.large_string()).fill_null(""))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])
        if ids and (found := flush(ids, texts)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Sets of distinct word shingles link when 100 * intersection >= percent * union. component_id
    is the smallest doc_id reachable by links (itself included). kept: doc_id = component_id.
    Equal sets count once; candidates share a band; all candidates that meet through buckets
    form a cluster, whose full sets are compared exactly. A null or empty text has no shingles
    and no links. A row with a null doc_id has no links, a null component_id and is kept. Rows
    that repeat a doc_id get one component together. Other columns are ignored.
    """
    rows = cut(sketch(docs, words, id_col, text_col))
    own = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(own.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")))
    member = classes.select("rep", F.posexplode("bands")).select("rep", F.xxhash64("pos", "col").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    star = member.join(shared, "bucket").where("rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    place = cut(components(star))
    sizes = place.join(classes.select(F.col("rep").alias("node"), "size"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    share = F.greatest(F.col("n") / F.lit(cluster), F.col("shingles") / F.lit(CLUSTER_SHINGLES))
    sizes = sizes.select("component", F.when(share <= 1, F.lit(1)).otherwise(F.least(F.ceil(2 * share), F.col("n"))).cast("int").alias("blocks"))
    many = sizes.where("blocks > 1").agg(F.count("*")).first()[0] > 0
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(place, "node")
    # a repeated doc_id may name several sets: the edge to its own row joins them in any case
    if many:
        texts = texts.join(F.broadcast(sizes.where("blocks > 1")), "component", "left")
        blocks = F.coalesce("blocks", F.lit(1))
        block = F.pmod(F.xxhash64("node"), blocks).cast("int")
        texts = texts.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))))
        texts = texts.select(F.when(blocks == 1, F.col("component")).otherwise(F.xxhash64("component", "pair.i", "pair.j")).alias("task"), "node", "text")
    else:
        texts = texts.select(F.col("component").alias("task"), "node", "text")
    links = texts.repartition("task").sortWithinPartitions("task", "node").mapInArrow(freeing(_verify_groups(words, percent)), "u long, v long")
    final = components(links)
    label = classes.select("hi", "lo", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "hi", "lo").join(label, ["hi", "lo"], "left").select("doc_id", "n_shingles", linked.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates() does not keep.

    Of rows that repeat an id, the one with the least text hash stays. Rows without an id stay.
    """
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    again = cut(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col))
    if again.isEmpty():
        return left
    one = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    repeated = left.join(again, id_col, "left_semi").withColumn("_rank", F.row_number().over(one)).where("_rank = 1")
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))
