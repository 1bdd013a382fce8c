"""Vector bin packing of training examples by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing
from .tokens import default_path, encoded_runs, encoder

#: Waiting examples among which a bin chooses.
WINDOW = 256
#: Sequence ids of a task start at its partition's number times this.
SEQUENCES_PER_TASK = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


@dataclass
class Packer:
    """Fills one sequence at a time from a bounded window of waiting examples.

    An example is a vector (tokens, segments, loss tokens). Of those that fit, the bin takes the
    one with the largest dot product of its vector with what is left, each dimension scaled by
    its limit and weighted by the window's demand for it. With cut, an example may be divided: one that fits
    nowhere fills up the bin, and the rest of it waits. Without cut, an example beyond a limit
    gets a sequence of its own.
    """

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    window: int = WINDOW

    def __post_init__(self):
        self._keys: list = []
        self._sizes = np.zeros((2 * self.window + 8, 3), np.int64)
        self._n = 0

    def _push(self, key, size) -> None:
        if self._n == len(self._sizes):
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
        self._sizes[self._n] = size
        self._keys.append(key)
        self._n += 1

    def _pop(self, at: int):
        key, size = self._keys[at], self._sizes[at].copy()
        self._n -= 1
        self._keys[at] = self._keys[-1]
        self._keys.pop()
        self._sizes[at] = self._sizes[self._n]
        return key, size

    def add(self, key, start: int, tokens: int, loss: int) -> Iterator[list[tuple]]:
        """Takes an example; yields the sequences that are full, each a list of (key, start, tokens)."""
        top = self.limits.vector()
        if self.cut:
            whole = min(self.limits.tokens, self.limits.loss) if loss else self.limits.tokens
            while tokens >= whole:
                yield [(key, start, whole)]
                start, tokens, loss = start + whole, tokens - whole, max(0, loss - whole)
            if not tokens:
                return
        elif (np.array([tokens, 1, loss]) > top).any():
            yield [(key, start, tokens)]
            return
        self._push((key, start), (tokens, 1, loss))
        while self._n >= self.window:
            yield self._fill()

    def _fill(self) -> list[tuple]:
        top = self.limits.vector()
        left, out = top.copy(), []
        weight = self._sizes[: self._n].sum(axis=0) / top
        weight /= weight.sum() or 1
        while self._n and left[0] and left[1]:
            sizes = self._sizes[: self._n]
            score = np.where((sizes <= left).all(axis=1), (sizes / top) @ (weight * left / top), -1.0)
            at = int(np.argmax(score))
            if score[at] >= 0:
                key, size = self._pop(at)
                out.append((*key, int(size[0])))
                left -= size
                continue
            if not self.cut:
                break
            at = int(np.argmax(sizes[:, 0]))
            tokens, _, loss = (int(x) for x in sizes[at])
            take = int(min(left[0], tokens, left[2] if loss else tokens))
            if not take:
                break
            key, _ = self._pop(at)
            out.append((*key, take))
            paid = min(loss, take)
            left -= (take, 1, paid)
            if tokens > take:
                self._push((key[0], key[1] + take), (tokens - take, 1, loss - paid))
            if not left[2]:
                break
        return out

    def finish(self) -> Iterator[list[tuple]]:
        """The sequences of what still waits.

        With cut, what is left over after the last full sequence goes into sequences whose
        lengths are powers of two, which need no padding.
        """
        while self._n:
            out = self._fill()
            total = sum(x[2] for x in out)
            if not self.cut or total == self.limits.tokens:
                yield out
                continue
            size = 1 << (total.bit_length() - 1)
            now, room = [], size
            for key, start, tokens in out:
                while tokens:
                    take = min(tokens, room)
                    now.append((key, start, take))
                    start, tokens, room = start + take, tokens - take, room - take
                    total -= take
                    if not room:
                        yield now
                        size = 1 << (total.bit_length() - 1) if total else 0
                        now, room = [], size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_batches(path: str, end_id: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path), Packer(limits)
        end = np.array([end_id], coder.dtype)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        rows: list[tuple] = []

        def note(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc, ids), start, length in pieces:
                piece = ids[start : start + length].astype("<u4")
                rows.append((doc, start, length, zlib.crc32(piece.tobytes()), len(ids), sequence, offset))
                offset += length
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, last, flat, ends in encoded_runs(coder, batch.column(1)):
                for doc, a, b in zip(docs[first:last], [0, *ends.tolist()], ends.tolist()):
                    ids = np.concatenate([flat[a:b], end])  # a copy: what waits must not hold the whole run
                    for pieces in packer.add((doc, ids), 0, len(ids), len(ids)):
                        note(pieces)
                if rows:
                    yield batch_of()
        for pieces in packer.finish():
            note(pieces)
        if rows:
            yield batch_of()

    return run


def pack_documents(docs: DataFrame, limits: Limits | None = None, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document, as placed in the sequences.

    A document is the ids of its whole text and end_id; a null or empty text is end_id alone.
    Every id lies in exactly one piece. doc_id may be null or repeat; such rows are packed like
    others. Each task packs what it reads, holding a bounded window of examples, so sequence
    ids are unique but not dense. Cut the lineage of an input whose row order can change.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(_pack_batches(path or default_path(), end_id, limits or Limits())), SCHEMA)


def _pack_lengths(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK

        def batch_of(found: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in found:
                offset = 0
                for key, _, tokens in pieces:
                    rows.append((key, tokens, sequence, offset))
                    offset += tokens
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["example_id", "length", "sequence_id", "offset"])

        for batch in batches:
            for key, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield from batch_of(list(packer.add(key, 0, tokens or 0, min(loss or 0, tokens or 0))))
        yield from batch_of(list(packer.finish()))

    return run


def pack_examples(examples: DataFrame, limits: Limits | None = None, id_col: str = "example_id", tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """(example_id, length, sequence_id, offset) of undivided examples of given lengths.

    Null lengths count as 0. An example beyond a limit has a sequence of its own.
    """
    return examples.select(F.col(id_col).cast("long"), F.col(tokens_col).cast("long"), F.col(loss_col).cast("long")).mapInArrow(_pack_lengths(limits or Limits()), "example_id long, length long, sequence_id long, offset long")
