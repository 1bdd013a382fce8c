"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, crc_mod, cut, freeing, release, text_steps

#: Labelled rows of each label that training takes at most, those with the least hash of their id.
SAMPLE_ROWS = 4096
#: Slots of the embedding tables, one for whole words and one for each prefix length (in bytes).
SLOTS = 1 << 18
PREFIXES = (4, 5)
#: Embedding dimensions of a channel, and filters of each width.
DIMS = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Documents to which a feature's log-odds are drawn back.
SHRINK = 8.0
#: Passes over the sample: as many as make about STEPS steps of 64 documents, between these bounds.
EPOCHS, STEPS = (5, 40), 320
STEP_BYTES = 1 << 19
#: Bins of a score's logit in calibration, over -LOGITS..LOGITS.
BINS, LOGITS = 4096, 16.0


def _features(words: Words) -> np.ndarray:
    """(words x channels) slots: of the word and of its prefixes."""
    lengths = words.lengths()
    hashes = [words.hashes] + [words.prefixes(k, lengths) for k in PREFIXES]
    return np.stack([(h >> np.uint64(64 - 18)).astype(np.int64) for h in hashes], axis=1)


@dataclass
class Classifier:
    """The network: tables (channel x slot x dim), filters by width, and a logistic layer."""

    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def words(self, slots: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[c][slots[:, c]] for c in range(slots.shape[1])], axis=1)

    def pooled(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(documents x filters) maxima over the places of each document, and the responses of each width.

        Places past a document's end count as zero vectors, so every word starts a window of each width.
        """
        n = len(first) - 1
        many = np.diff(first)
        end = np.repeat(first[1:], many)
        out, responses = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), []
        some = np.flatnonzero(many)
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.biases)):
            z = x @ f[0]
            for i in range(1, w):
                y = x[i:] @ f[i]
                z[:-i] += np.where((np.arange(len(y)) + i < end[: len(y)])[:, None], y, 0)
            z += b
            responses.append(z)
            block = np.tile(b, (n, 1))
            if len(some):
                block[some] = np.maximum.reduceat(z, first[some], axis=0)
            out[:, k * FILTERS : (k + 1) * FILTERS] = block
        return out, responses

    def scores(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(self.words(slots), first)
        return 1 / (1 + np.exp(-(np.maximum(top, 0) @ self.weights + self.bias).astype(np.float64)))

    def threshold(self, lang: Column) -> Column:
        """The calibrated threshold of a row's language; the one of all languages for others."""
        rest = F.lit(self.thresholds[""])
        own = {k: v for k, v in self.thresholds.items() if k}
        if not own:
            return rest
        return F.coalesce(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[lang], rest)


def _documents(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_steps(texts, STEP_BYTES):
        words = Words(data, offsets, ALNUM)
        slots = _features(words).astype(np.int32)
        out += [slots[words.first[k] : words.first[k + 1]] for k in range(len(offsets) - 1)]
    return out


def _log_odds(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """(channel x slot) shrunken log-odds of label 1 over documents that hold the slot, against the base rate."""
    seen = np.zeros((2, 1 + len(PREFIXES), SLOTS), np.float64)
    for d, y in zip(docs, labels):
        for c in range(d.shape[1]):
            seen[int(y), c, np.unique(d[:, c])] += 1
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    return np.log((seen[1] + SHRINK * share) / (seen[0] + SHRINK * (1 - share))) - np.log(share / (1 - share))


def train(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray, seed: int = 7) -> tuple[Classifier, np.ndarray]:
    """(network, positions of the rows it has seen): a fifth of the rows is kept from it."""
    rng = np.random.default_rng(seed)
    docs = _documents(texts)
    labels = np.asarray(labels, np.float64)
    order = rng.permutation(len(docs))
    fit = order[len(docs) // 5 :]
    channels = 1 + len(PREFIXES)
    tables = rng.normal(0, 0.01, (channels, SLOTS, DIMS)).astype(np.float32)
    if len(fit):
        tables[:, :, 0] += _log_odds([docs[i] for i in fit], labels[fit]) / 4
    filters = [rng.normal(0, 0.15, (w, channels * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, ::DIMS] = np.abs(f[:, ::DIMS]) + 0.1
    net = Classifier(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0, {"": 0.5})
    if len(fit) and 0 < labels[fit].sum() < len(fit):
        _descend(net, docs, labels, fit, rng)
    return net, fit


def _descend(net: Classifier, docs: list[np.ndarray], labels: np.ndarray, fit: np.ndarray, rng, size: int = 64) -> None:
    dense = [*net.filters, *net.biases, net.weights]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    b1 = b2 = 0.0
    squares = np.full(net.tables.shape[:2], 1e-4, np.float32)
    step = 0
    epochs = min(max(-(-STEPS * size // len(fit)), EPOCHS[0]), EPOCHS[1])
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), size):
            own = fit[at : at + size]
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in own])])
            slots = np.concatenate([docs[i] for i in own])
            x = net.words(slots)
            top, responses = net.pooled(x, first)
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(active @ net.weights + net.bias)))
            error = ((p - labels[own]) / len(own)).astype(np.float32)
            g_top = error[:, None] * net.weights * (top > 0)
            grads_f, grads_b = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.biases]
            g_x: list[tuple[np.ndarray, np.ndarray]] = []
            for k, w in enumerate(WIDTHS):
                for d in range(len(own)):
                    a, b = first[d], first[d + 1]
                    if a == b:
                        continue
                    best = a + responses[k][a:b].argmax(axis=0)
                    g = g_top[d, k * FILTERS : (k + 1) * FILTERS]
                    grads_b[k] += g
                    for i in range(w):
                        inside = best + i < b
                        place, part = best[inside] + i, g[inside]
                        grads_f[k][i][:, inside] += x[place].T * part
                        g_x.append((place, (net.filters[k][i][:, inside] * part).T))
            step += 1
            grads = [*grads_f, *grads_b, active.T @ error]
            for param, grad, u, v in zip(dense, grads, m1, m2):
                u += 0.1 * (grad - u)
                v += 0.001 * (grad * grad - v)
                param -= 0.01 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            g = float(error.sum())
            b1, b2 = b1 + 0.1 * (g - b1), b2 + 0.001 * (g * g - b2)
            net.bias -= 0.01 * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-7)
            if g_x:
                place, grad = np.concatenate([a for a, _ in g_x]), np.concatenate([b for _, b in g_x])
                for c in range(net.tables.shape[0]):
                    slot, part = slots[place, c], grad[:, c * DIMS : (c + 1) * DIMS]
                    np.add.at(squares[c], slot, (part * part).sum(axis=1))
                    np.add.at(net.tables[c], slot, -0.02 * part / np.sqrt(squares[c][slot])[:, None])


def _edge(at: int) -> float:
    """The least score of a bin."""
    return 1 / (1 + math.exp(LOGITS - 2 * LOGITS * at / BINS)) if at > 0 else 0.0


def _best(hist: np.ndarray, totals: np.ndarray, least: int) -> float | None:
    """The threshold of the best F1, from (label x bin) counts of unseen rows, weighted to the totals of each label."""
    seen = hist.sum(axis=1)
    if seen.min() < least:
        return None
    clean, toxic = (hist * (totals / seen)[:, None])[:, ::-1]
    hit, taken = np.cumsum(toxic), np.cumsum(clean + toxic)
    some = np.flatnonzero(clean + toxic)
    at = int(np.argmax((2 * hit / (taken + totals[1]))[some]))
    low = BINS - 1 - some[at]
    below = _edge(BINS - some[at + 1]) if at + 1 < len(some) else 0.0
    return (_edge(low) + below) / 2


def _calibrate(net: Classifier, texts: DataFrame, known: DataFrame, fitted: DataFrame, least: int = 30) -> None:
    """Sets thresholds of the best F1 at the label shares of all labelled rows: texts (doc_id, text, lang) and known (doc_id, y).

    Every row is scored where it lies, so that no text is shuffled, and counted by language, label and bin. Scores of the rows
    that the network has seen (fitted) speak too well of it: those rows count in the shares alone.
    A language with fewer than `least` unseen rows of a label shares the threshold of all.
    """
    rows = texts.select(F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).alias("doc_id"), "text")
    place = F.floor((F.log(F.col("score") / (1 - F.col("score"))) + LOGITS) * (BINS / (2 * LOGITS)))
    place = F.when(F.col("score") >= 1, BINS - 1).when(F.col("score") <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place))).cast("int")
    scored = _scored(rows, net, "text").select("doc_id.*", place.alias("bin")).join(known, "doc_id")
    scored = scored.join(F.broadcast(fitted.select("doc_id", F.lit(True).alias("seen"))), "doc_id", "left").withColumn("fitted", F.col("seen").isNotNull())
    hist = cut(scored.groupBy("lang", F.col("y").cast("int").alias("y"), "fitted", "bin").count())
    enough = [F.sum(F.when((F.col("y") == y) & ~F.col("fitted"), F.col("count"))) >= least for y in (0, 1)]
    langs = hist.where("lang <> ''").groupBy("lang").agg((enough[0] & enough[1]).alias("enough")).where("enough").select("lang")
    found = hist.join(langs, "lang", "left_semi").unionByName(hist.groupBy("y", "fitted", "bin").agg(F.sum("count").alias("count")).withColumn("lang", F.lit("")))
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang, y, fitted, at, n in found.select("lang", "y", "fitted", "bin", "count").toLocalIterator():
        own, totals = counts.setdefault(lang, (np.zeros((2, BINS)), np.zeros(2)))
        totals[y] += n
        if not fitted:
            own[y, at] += n
    for lang, (own, totals) in counts.items():
        threshold = _best(own, totals, least)
        if threshold is not None:
            net.thresholds[lang] = threshold


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Classifier:
    """Trains on at most `rows` labelled rows of each label, never on rows of the held-out fold.

    Thresholds are set by all labelled rows outside that fold, at the shares that their labels have.

    Labels other than 0 and 1 and null ids are passed over; a doc_id labelled twice counts with
    its larger label. Without usable rows the network keeps its first weights.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    if held_out is not None:
        known = known.where(~held_out)
    taken = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        taken = own if taken is None else taken.unionAll(own)
    # at most twice `rows` ids: a bounded table
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Arrow buffers to the driver: rows of Python strings would take it many times their size
    found = texts.join(F.broadcast(taken), "doc_id").select("doc_id", "text", F.col("y").cast("double").alias("y")).toArrow()
    found = found.set_column(1, "text", found["text"].cast(pa.large_string())).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids, sample, y = found["doc_id"].to_pylist(), found["text"], found["y"].to_numpy()
    del found
    net, seen = train(sample, y)
    del sample, y
    fitted = docs.sparkSession.createDataFrame([(x,) for x in sorted({ids[i] for i in seen})], T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType)]))
    _calibrate(net, texts.where("doc_id is not null") if held_out is None else texts.where(F.col("doc_id").isNotNull() & ~held_out), known, fitted)
    release()  # the driver goes on with less
    return net


def _score_batches(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Classifier = shared.value
        for batch in batches:
            row = batch.column(0)
            text = row.field(text_col) if batch.num_columns == 1 else batch.column(1)
            for i, j, data, offsets in text_steps(text, STEP_BYTES):
                words = Words(data, offsets, ALNUM)
                slots = _features(words) if len(words.hashes) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), pa.array(net.scores(slots, words.first))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row.

    A score depends on the whole text alone; null and empty texts get the score of no words.
    """
    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net, text_col)


def _scored(own: DataFrame, net: Classifier, text_col: str) -> DataFrame:
    """(doc_id, score) from columns doc_id and text, or from whole rows as one struct doc_id."""
    schema = T.StructType([own.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return own.mapInArrow(freeing(_score_batches(own.sparkSession.sparkContext.broadcast(net), text_col)), schema)


def reject_toxic(docs: DataFrame, net: Classifier, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose score stays below the calibrated threshold of their language."""
    scored = _scored(docs.select(F.struct(*docs.columns).alias("doc_id")), net, text_col)
    return scored.where(F.col("score") < net.threshold(F.col(f"doc_id.{lang_col}"))).select("doc_id.*")


def held_out_fold(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2
