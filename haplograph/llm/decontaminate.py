"""Benchmark decontamination: a prefix-filtered join of documents with item windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, BASE, MIX2, Words, freeing, mix, text_steps

#: Words of a window.
WINDOW = 13
#: Bytes of item texts that are indexed at once; more items go in further blocks. A window costs
#: about 40 bytes of the broadcast index, at most one window for each word: some 80 MB for words of four letters.
BLOCK_BYTES = 8 << 20


class Index:
    """The distinct windows of a block of items, found by their rarest word.

    Containment of a whole window needs all its words, so the necessary prefix in order of
    rarity is one word: the rarest. Its place in the window then fixes where the window starts.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t for _, t in items], pa.large_string())
        stream, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_steps(texts):
            words = Words(data, offsets, ALNUM)
            stream.append(words.hashes)
            many.append(words.counts())
        #: All words of the items, one item after another; a window is a run of them.
        self.stream, counts = np.concatenate(stream), np.concatenate(many)
        wide = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(counts)), wide)
        start = np.repeat(np.cumsum(counts) - counts, wide) + np.arange(len(owner)) - np.repeat(np.cumsum(wide) - wide, wide)
        size = np.minimum(counts, window)[owner]
        low, high = np.zeros(len(start), np.uint64), size.astype(np.uint64)
        for i in range(window):
            h = self.stream[np.minimum(start + i, max(len(self.stream) - 1, 0))]
            inside = size > i
            low = np.where(inside, mix(low * np.uint64(BASE) + h), low)
            high = np.where(inside, mix(high * np.uint64(MIX2) + h), high)
        # windows of equal words are one, with all the items that they occur in
        item = np.array([i for i, _ in items], np.int64)[owner]
        order = np.lexsort((item, low, high))
        low, high, item, start, size = low[order], high[order], item[order], start[order], size[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        again = ~fresh
        again[1:] &= item[1:] == item[:-1]
        self.start, self.size = start[fresh].astype(np.int32), size[fresh].astype(np.int32)
        self.items = item[~again]
        self.item_first = np.append(np.flatnonzero(fresh[~again]), len(self.items))
        self.vocabulary = np.unique(self.stream)

    def word(self, windows: np.ndarray, i: int) -> np.ndarray:
        """The word at place i of each window; any word where a window is shorter."""
        return self.stream[np.minimum(self.start[windows] + i, len(self.stream) - 1)]

    def order(self, counts: np.ndarray) -> None:
        """counts: how often each word of the vocabulary occurs in the documents."""
        n = len(self.size)
        rank = np.zeros(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(rank))
        if not n:
            self.prefix, self.prefix_first, self.by_prefix, self.place = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            everyone, best = np.arange(n), np.full(n, len(rank))
            self.place = np.zeros(n, np.int32)
            for i in range(self.window):
                own = np.where(self.size > i, rank[np.searchsorted(self.vocabulary, self.word(everyone, i))], len(rank))
                self.place[own < best] = i
                best = np.minimum(best, own)
            rarest = self.word(everyone, 0)
            for i in range(1, self.window):
                rarest = np.where(self.place == i, self.word(everyone, i), rarest)
            self.by_prefix = np.argsort(rarest, kind="stable")
            self.prefix, first = np.unique(rarest[self.by_prefix], return_index=True)
            self.prefix_first = np.append(first, n)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.prefix >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence of a window."""
        h = words.hashes
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        slot = np.searchsorted(self.prefix, h[at])
        real = slot < len(self.prefix)
        real[real] = self.prefix[slot[real]] == h[at[real]]
        at, slot = at[real], slot[real]
        many = self.prefix_first[slot + 1] - self.prefix_first[slot] if len(slot) else np.zeros(0, np.int64)
        doc = np.searchsorted(words.first, at, "right") - 1
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        window = self.by_prefix[np.repeat(self.prefix_first[slot], many) + inner] if len(at) else np.zeros(0, np.int64)
        start = at - self.place[window] if len(at) else at
        # positional and length bounds: the whole window lies in the document
        keep = (start >= words.first[doc]) & (start + self.size[window] <= words.first[doc + 1])
        doc, start, window = doc[keep], start[keep], window[keep]
        for i in range(self.window):
            if not len(start):
                break
            short = self.size[window] <= i
            keep = short | (h[np.minimum(start + i, len(h) - 1)] == self.word(window, i))
            doc, start, window = doc[keep], start[keep], window[keep]
        return doc, start, window


def _count_batches(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        total = np.zeros(len(words) + 1, np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[(words >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                h = Words(data, offsets, ALNUM).hashes
                h = h[maybe[(h >> np.uint64(44)).astype(np.int64)]]
                at = np.searchsorted(words, h)
                at[(at >= len(words)) | (words[np.minimum(at, len(words) - 1)] != h)] = len(words)
                total += np.bincount(at, minlength=len(total))
        hit = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(total[hit])], names=["word", "n"])

    return run


def _match_batches(shared, text_col: str, last: bool, digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            held_words, held_items = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            row = batch.column("doc_id")
            text = batch.column("text") if "text" in batch.schema.names else row.field(text_col)
            for i, j, data, offsets in text_steps(text):
                words = Words(data, offsets, ALNUM)
                doc, start, window = index.matches(words)
                step = np.zeros(len(words.hashes) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, start + index.size[window], -1)
                covered = np.cumsum(step[:-1]) > 0
                items: dict[int, set[int]] = {}
                if len(doc):
                    for d, w in np.unique(np.stack([doc, window], axis=1), axis=0):
                        items.setdefault(int(d), set()).update(index.items[index.item_first[w] : index.item_first[w + 1]].tolist())
                n_words, out_spans, out_items = words.counts(), [], []
                for k in range(j - i):
                    old, own = held_words[i + k], items.get(k)
                    span = None
                    if own or old:
                        bits = covered[words.first[k] : words.first[k + 1]]
                        if old:
                            bits = bits | np.unpackbits(np.frombuffer(old, np.uint8), count=len(bits)).astype(bool)
                        span = np.packbits(bits).tobytes()
                    out_spans.append(span)
                    out_items.append(sorted({*(own or ()), *(held_items[i + k] or ())}))
                found = {"doc_id": row.slice(i, j - i)}
                if not last:
                    if "text" in batch.schema.names:
                        found["text"] = text.slice(i, j - i)
                    found |= {"hit": pa.array(out_spans, pa.binary()), "items": pa.array(out_items, pa.list_(pa.int64()))}
                else:
                    found |= digest(n_words, out_spans, out_items) if digest else {"hit": pa.array(out_spans, pa.binary()), "items": pa.array(out_items, pa.list_(pa.int64())), "n_words": pa.array(n_words.astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def _digest(n_words: np.ndarray, spans: list[bytes | None], items: list[list[int]]) -> dict[str, pa.Array]:
    n_hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in spans]
    names = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
    return {
        "n_words": pa.array(n_words.astype(np.int64)),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array(names, pa.string()),
        "contaminated": pa.array([h > 0 and 20 * h >= int(n) for h, n in zip(n_hit, n_words)], pa.bool_()),
    }


SPANS = [T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType())]
DIGEST = [*(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def blocks_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about block_bytes of text, by a hash of item_id."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, hit, items, n_words) for every row of docs.

    hit: a bit for each word, set inside an occurrence of a window (null where none is);
    items: the sorted ids of the items with occurring windows; n_words: the words of the text.
    A window is 13 consecutive words of an item, or all of a shorter item. Null or empty texts
    have no words; items without words or without an id match nothing; repeated items count
    once. Other columns are ignored. Items go to the tasks in blocks of a checked size.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _matched(own, docs, items, window, text_col, item_col, item_text_col, block_bytes)


def _matched(own: DataFrame, docs: DataFrame, items: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, block_bytes: int, digest=None) -> DataFrame:
    """As matched(), for columns doc_id and text, or for whole rows of docs as one struct doc_id; with digest, its columns instead."""
    spark = docs.sparkSession
    state = own.withColumns({"hit": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<long>")})
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    blocks = blocks_of(asked, block_bytes)
    for k, block in enumerate(blocks):
        index = Index([tuple(r) for r in block.distinct().collect()], window)
        words = spark.sparkContext.broadcast(index.vocabulary)
        counts = np.zeros(len(index.vocabulary), np.int64)
        if len(counts):
            for word, n in docs.select(F.col(text_col).alias("text")).mapInArrow(_count_batches(words), "word long, n long").groupBy("word").agg(F.sum("n")).collect():
                counts[word] = n
        index.order(counts)
        state = state.select(*own.columns, "hit", "items")
        last = k == len(blocks) - 1
        fields = [own.schema["doc_id"], *(DIGEST if digest else SPANS)] if last else list(state.schema)
        state = state.mapInArrow(freeing(_match_batches(spark.sparkContext.broadcast(index), text_col, last, digest)), T.StructType(fields))
    return state


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; see contamination()."""
    own = docs.select(F.struct(*docs.columns).alias("doc_id"))
    state = _matched(own, docs, items, window, text_col, item_col, item_text_col, block_bytes, _digest)
    return state.where("not contaminated").select("doc_id.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs; see matched().

    contaminated: some word is hit, and at least a twentieth of the words are.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _matched(own, docs, items, window, text_col, item_col, item_text_col, block_bytes, _digest)
