"""What the operators share: sessions, shared folders, text buffers and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, scratch, ship  # noqa: F401

#: Fixed odd multipliers of the polynomial hash and of the finishing mix.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text that one vectorised step takes at once (a longer document is taken alone).
STEP_BYTES = 1 << 20

def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased, by arithmetic, which is quicker than a look into a table."""
    low = (data - np.uint8(65) < np.uint8(26)).view(np.uint8)
    low <<= np.uint8(5)
    low |= data
    return low


LOWER = lowered(np.arange(256, dtype=np.uint8))


def _mask(outside: list[tuple[int, int]]) -> np.ndarray:
    mask = np.ones(256, bool)
    for lo, hi in outside:
        mask[lo : hi + 1] = False
    return mask


#: Which bytes of lower-cased UTF-8 belong to a word: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = _mask([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def marked(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """inside[data], from the ranges of bytes that lie outside."""
    border = np.flatnonzero(np.diff(inside, prepend=True, append=True))
    out = np.ones(len(data), bool)
    for lo, end in border.reshape(-1, 2).tolist():
        out &= data - np.uint8(lo) > np.uint8(end - 1 - lo)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n: the folds of the contracts (a null id falls in fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def release() -> None:
    """Gives memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run):
    """run, a function of batches, with a release() at its end.

    Workers stay for later stages, and what they keep would add up over the stages of a pipeline.
    """

    def freed(batches):
        yield from run(batches)
        release()

    return freed


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last+1, bytes, offsets) of runs of documents that hold about step_bytes together."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_POW: dict[int, np.ndarray] = {}
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _POW[base] = np.cumprod(have, dtype=np.uint64)
        if len(have) > 8 * STEP_BYTES:
            del _POW[base]  # a single huge text: not kept
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finishing mix of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX2)
    return h ^ (h >> np.uint64(31))


def hashes_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start, in ascending order, to the next one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = np.zeros(len(data) + 1, np.uint64)  # a start may lie at the end
    np.add(data, np.uint64(1), out=terms[:-1], dtype=np.uint64)
    terms[:-1] *= _powers(BASE, len(data))
    return mix(np.add.reduceat(terms, starts) * _powers(_INVERSE, len(data) + 1)[starts])


class Words:
    """The words of a run of documents: 64-bit hashes, byte spans and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        low = lowered(data)
        word = marked(low, inside)
        n = len(low)
        begins = word.copy()
        if n:
            begins[1:] &= ~word[:-1]
            cuts = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < n)]
            begins[cuts] = word[cuts]
        self.low, self.starts = low, np.flatnonzero(begins)
        self.word = word
        self.first = np.searchsorted(self.starts, offsets)  # of each document, and one past the last
        if len(self.starts):
            terms = low.astype(np.uint16)
            terms += np.uint16(1)
            terms *= word
            self._terms = terms.astype(np.uint64)
            self._terms *= _powers(BASE, n)
            h = np.add.reduceat(self._terms, self.starts)
            self._shift = _powers(_INVERSE, n)[self.starts]
            self.hashes = mix(h * self._shift)
        else:
            self.hashes = np.zeros(0, np.uint64)

    def lengths(self) -> np.ndarray:
        """Bytes of each word."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        return np.add.reduceat(self.word.astype(np.int64), self.starts)

    def prefixes(self, k: int, lengths: np.ndarray) -> np.ndarray:
        """Hashes of the first k bytes of each word (of all of a shorter one)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        h = np.zeros(len(self.starts), np.uint64)
        last = len(self._terms) - 1
        for i in range(k):
            h += np.where(lengths > i, self._terms[np.minimum(self.starts + i, last)], np.uint64(0))
        return mix(h * self._shift + np.uint64(k))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The document of each word, as its position in the run."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (hashes, first shingle of each document and one past the last), sorted in a document.

    A document of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n, h = words.counts(), words.hashes
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][owner]
    size = np.minimum(n, k)[owner]
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        nxt = mix(out * np.uint64(BASE) + h[np.minimum(at + i, len(h) - 1)] + np.uint64(i + 1)) if len(at) else out
        out = np.where(size > i, nxt, out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))
