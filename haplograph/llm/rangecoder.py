"""Token ids in files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block's ids are dealt to lanes, contiguous stretches that are coded in step with one another
and share one model. The block's distinct ids are ranked by frequency; the most frequent ones
are the symbols of the mixed model, and one more symbol stands before each rarer id, whose own
adaptive order-0 frequencies then code it. A symbol's probability is a weighted mean of three
predictions: adaptive order-0 frequencies, order-1 frequencies after the last symbol, and the
symbol that followed the last two when they were last seen. Weights belong to a gate, chosen by
how much the order-1 and order-2 contexts have seen, and follow the share that each prediction
had in what came (online expectation-maximisation). A carry-less range coder narrows the
interval. A block starts from a fresh model, carries its documents' table and ends with a crc32
of all its bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, scratch
from .tokens import default_path, encoded_runs, encoder

MAGIC = b"TIDS2\0\0\0"
#: Ids after which a block is closed at the next end of a document.
BLOCK_IDS = 1 << 21
LANES, STEPS = 4096, 256
#: Most symbols of the mixed model, and slots of the order-2 table (bits).
SYMBOLS, TABLE_BITS = 1024, 18
#: Bits of a prediction's total and of the weights' total; an interval's total is their product.
PART_BITS, WEIGHT_BITS = 15, 13
TOTAL_BITS = PART_BITS + WEIGHT_BITS
PART, WEIGHT = 1 << PART_BITS, 1 << WEIGHT_BITS
#: Order 0 keeps this weight, so that every symbol can come.
LEAST_WEIGHT = 32
#: Totals beyond which an order-1 row, the order-0 counts and a gate's memory are halved.
ROW_MOST, ORDER0_MOST, GATE_MOST = 1 << 14, 1 << 20, 1 << 15
#: Steps between two looks at the counts; at the start, each that is a power of two.
REFRESH = 32
#: Rows of the order-1 counts that are cumulated at once.
CHUNK = 32
#: Steps between two lessons of the gates.
GATE_STEPS = 4
#: Steps whose known symbols get their intervals in one call of each function.
GROUP = 4
U = np.uint64
_TOP, _BOTTOM, _LOW32 = U(1 << 48), U(1 << 32), U((1 << 32) - 1)
#: Classes of an order-2 slot's confidence (0 to 15), and of an order-1 row's total by its bit length.
_ROW_CLASSES = 10
_SURE = np.array([0, 1, 2, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 6], np.int64) * _ROW_CLASSES
#: A slot's confidence after a wrong guess, and after a right one.
_AFTER = np.array([max(c >> 1, 1) for c in range(16)] + [min(c + 1, 15) for c in range(16)], np.int8)


def _looks(step: int) -> bool:
    return step % REFRESH == 0 or (step < REFRESH and step & (step - 1) == 0)


class Model:
    """Adaptive order-0 to order-2 predictions of symbols below `size`, a power of two, for all lanes of a block.

    Pairs lie symbol by symbol, each with all symbols before it: sums over symbols then run over
    whole rows, and the first steps of a search look at few of them.
    """

    def __init__(self, size: int, lanes: int):
        self.size, self.bits = size, size.bit_length() - 1
        self.count0 = np.ones(size, np.int64)
        # whole numbers below 2^24, which 32-bit floats hold exactly
        self.count1, self.total1 = np.zeros((size, size), np.float32), np.zeros(size, np.int64)
        self.cum0, self.part0 = np.zeros(size + 1, np.int32), np.zeros(size, np.int32)
        self.cum1 = np.zeros((size + 1, size), np.int32)
        self.flat = self.cum1.reshape(-1)
        # what followed the last two symbols, and in the low 4 bits how sure that is
        self.notes = np.zeros(1 << TABLE_BITS, np.int16)
        self.gate = np.tile(np.array([8.0, 8.0, 4.0]), (7 * _ROW_CLASSES, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        chunk = min(CHUNK, size)
        self._summed, self._scaled = np.zeros((chunk, size), np.float32), np.zeros((chunk, size), np.float32)
        self.step = 0
        self.seen: list[np.ndarray] = []

    def _refresh(self) -> None:
        """Cumulated frequencies, each scaled to PART, and the gates' weights."""
        size = self.size
        if self.seen:
            seen = np.concatenate(self.seen)
            np.add.at(self.count1.reshape(-1), seen, np.full(len(seen), 2, np.float32))
            self.count0 += np.bincount(seen >> self.bits, minlength=size)
            self.total1 += 2 * np.bincount(seen & (size - 1), minlength=size)
            self.seen.clear()
        if int(self.count0.sum()) > ORDER0_MOST:
            self.count0 = (self.count0 + 1) >> 1
        cum = np.cumsum(self.count0)
        self.cum0[1:] = cum * (PART - size) // cum[-1] + np.arange(1, size + 1)
        self.part0 = np.diff(self.cum0)
        many = np.flatnonzero(self.total1 > ROW_MOST)
        if len(many):
            self.count1[:, many] = np.floor(self.count1[:, many] * np.float32(0.5))
            self.total1[many] = self.count1[:, many].sum(axis=0)
        scale = (PART / np.maximum(self.total1, 1)).astype(np.float32)
        sums, before = self._summed, np.zeros(size, np.float32)
        for first in range(0, size, len(sums)):
            for below, count in zip(sums, self.count1[first : first + len(sums)]):
                before = np.add(before, count, out=below)
            np.multiply(sums, scale, out=self._scaled)
            np.copyto(self.cum1[first + 1 : first + 1 + len(sums)], self._scaled, casting="unsafe")
        self.cum1[size] = PART
        self.row_class = np.minimum(np.ceil(np.log2(self.total1 + 1)), _ROW_CLASSES - 1).astype(np.int64)
        big = self.gate.sum(axis=1) > GATE_MOST
        self.gate[big] *= 0.5
        share = self.gate / self.gate.sum(axis=1, keepdims=True)
        key = np.arange(len(share))
        # nothing for a context that has not been seen
        self.weight1 = np.where(key % _ROW_CLASSES > 0, (share[:, 1] * (WEIGHT - 2 * LEAST_WEIGHT)).astype(np.int32), 0).astype(np.int32)
        self.weight2 = np.where(key >= _ROW_CLASSES, (share[:, 2] * (WEIGHT - 2 * LEAST_WEIGHT)).astype(np.int32), 0).astype(np.int32)

    def predict(self) -> None:
        if _looks(self.step):
            self._refresh()
        self.slot = self._slots(self.last, self.before)
        self._weigh(self.notes.take(self.slot, mode="clip").astype(np.int64))

    def _slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return ((last * 0x9E3779B1 + before * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - TABLE_BITS)

    def _weigh(self, note: np.ndarray) -> None:
        self.guess, self.sure = note >> 4, note & 15
        self.key = _SURE.take(self.sure, mode="clip")
        self.key += self.row_class.take(self.last, mode="clip")
        self.w1, self.w2 = self.weight1.take(self.key, mode="clip"), self.weight2.take(self.key, mode="clip")
        self.w0 = WEIGHT - self.w1 - self.w2
        self.extra = self.w2 << PART_BITS

    def interval(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of each lane's symbol; notes what each prediction gave it."""
        self.at = (symbol << self.bits) + self.last
        c1 = self.flat.take(self.at, mode="clip")
        self.got0 = self.w0 * self.part0.take(symbol, mode="clip")
        self.got1 = self.w1 * (self.flat.take(self.at + self.size, mode="clip") - c1)
        self.right = (symbol == self.guess) & (self.sure > 0)
        start = self.w0 * self.cum0.take(symbol, mode="clip")
        start += self.w1 * c1
        start += self.extra * (symbol > self.guess)
        self.width = self.got0 + self.got1
        self.width += self.extra * self.right
        return start.astype(np.uint64), self.width.astype(np.uint64)

    def find(self, target: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds each lane's target."""
        target = target.astype(np.int32)
        at = (self.guess << self.bits) + self.last
        low = self.w0 * self.cum0.take(self.guess, mode="clip") + self.w1 * self.flat.take(at, mode="clip")
        at += self.size
        high = self.w0 * self.cum0.take(self.guess + 1, mode="clip") + self.w1 * self.flat.take(at, mode="clip") + self.extra
        beyond = target >= high
        found = self.guess.copy()
        lanes = np.flatnonzero(beyond | (target < low))
        target = (target - self.extra * beyond).take(lanes)
        place, w0, w1 = self.last.take(lanes), self.w0.take(lanes), self.w1.take(lanes)
        step = self.cum1.size - self.size >> 1
        while step >= self.size:
            at = place + step
            below = self.flat.take(at, mode="clip")
            below *= w1
            at >>= self.bits
            below0 = self.cum0.take(at, mode="clip")
            below0 *= w0
            below += below0
            place += (below <= target) * step
            step >>= 1
        found[lanes] = place >> self.bits
        return found

    def update(self, symbol: np.ndarray) -> None:
        self.seen.append(self.at)
        if self.step % GATE_STEPS == 0:
            self._teach(self.key, self.got0, self.got1, self.width)
        self.notes[self.slot] = self._noted(self.guess, self.sure, self.right, symbol)
        self.before, self.last = self.last, symbol
        self.step += 1

    def _teach(self, key: np.ndarray, got0: np.ndarray, got1: np.ndarray, width: np.ndarray) -> None:
        """A lesson of the gates."""
        share = 1.0 / width
        part0, part1 = got0 * share, got1 * share
        for k, part in enumerate((part0, part1, 1.0 - part0 - part1)):
            self.gate[:, k] += np.bincount(key, part, len(self.gate))

    def _noted(self, guess: np.ndarray, sure: np.ndarray, right: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        # a sure guess stays, half as sure, when another symbol came
        note = np.where(sure > 1, guess, symbol)
        note <<= 4
        note += _AFTER.take(sure + 16 * right, mode="clip")
        return note

    def intervals(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """interval() of some steps, a row each, before the next look at the counts, and their update().

        Only the order-2 table changes from one of these steps to the next.
        """
        if _looks(self.step):
            self._refresh()
        lasts = np.concatenate([self.last[None], symbols[:-1]])
        befores = np.concatenate([self.before[None], lasts[:-1]])
        notes, short = np.empty(symbols.shape, np.int16), symbols.astype(np.int16)
        for slot, symbol, note in zip(self._slots(lasts, befores), short, notes):
            self.notes.take(slot, out=note, mode="clip")
            guess, sure = note >> 4, note & 15
            self.notes[slot] = self._noted(guess, sure, (symbol == guess) & (sure > 0), symbol)
        self.last = lasts
        self._weigh(notes.astype(np.int64))
        start, width = self.interval(symbols)
        for i in range(-self.step % GATE_STEPS, len(symbols), GATE_STEPS):
            self._teach(self.key[i], self.got0[i], self.got1[i], self.width[i])
        self.seen.append(self.at.reshape(-1))
        self.before, self.last = lasts[-1], symbols[-1]
        self.step += len(symbols)
        return start, width


class Rare:
    """Adaptive order-0 frequencies of the ids that have no symbol of their own, looked at anew every few steps."""

    def __init__(self, many: int):
        self.count = np.ones(max(many, 1), np.int64)
        self.cum = np.zeros(len(self.count) + 1, np.int64)
        self.total = 1 << TOTAL_BITS

    def refresh(self, step: int) -> None:
        if _looks(step):
            cum, n = np.cumsum(self.count), len(self.count)
            self.cum[1:] = cum * (self.total - n) // cum[-1] + np.arange(1, n + 1)

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.cum[rank]
        return low.astype(np.uint64), (self.cum[rank + 1] - low).astype(np.uint64)

    def find(self, target: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cum, target, "right") - 1

    def update(self, rank: np.ndarray) -> None:
        np.add.at(self.count, rank, 16)


def _symbols(n: int, distinct: int) -> int:
    """Symbols of a block of n ids: a power of two, and a table of pairs that the block can fill."""
    size = 2
    while size < min(SYMBOLS, distinct + 1) and 4 * size * size <= 4 * n:
        size *= 2
    return size


_ALL = slice(None)


def _turned(grid: np.ndarray, edge: int = 64) -> np.ndarray:
    """The transposed grid, copied square by square: columns that lie a power of two apart would push one another out of the caches."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, grid.shape[0], edge):
        for b in range(0, grid.shape[1], edge):
            out[b : b + edge, a : a + edge] = grid[a : a + edge, b : b + edge].T
    return out


class _Lanes:
    """The interval of each lane, narrowed in step."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, at, start: np.ndarray, size: np.ndarray):
        """Takes an interval in the lanes at; yields (lanes, what leaves on their left) until all are wide again."""
        unit = self.width[at] >> U(TOTAL_BITS)
        low, width = self.low[at] + unit * start, unit * size
        if at is _ALL:
            self.low, self.width = low, width
        else:
            self.low[at], self.width[at] = low, width
        settled = (low ^ (low + width)) < _TOP
        due = np.flatnonzero(settled | (width < _BOTTOM))
        lanes = due if at is _ALL else at[due]
        own, span, settled = low[due], width[due], settled[due]
        while len(lanes):
            if not settled.all():
                span = np.where(settled, span, (~own + U(1)) & _LOW32)
            yield lanes, (own >> U(48)).astype(np.uint16)
            own, span = own << U(16), span << U(16)
            self.low[lanes], self.width[lanes] = own, span
            settled = (own ^ (own + span)) < _TOP
            more = settled | (span < _BOTTOM)
            if not more.any():
                return
            lanes, own, span, settled = lanes[more], own[more], span[more], settled[more]


def encode_ids(ids: np.ndarray, ranked: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, 16-bit words of each lane, all words, lane after lane); ranked: the distinct ids, most frequent first."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // STEPS)))
    steps = -(-n // lanes)
    rank = np.zeros(int(ranked.max()) + 1, np.int32)
    rank[ranked] = np.arange(len(ranked))
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = rank[ids]
    grid = _turned(grid.reshape(lanes, steps))
    size = _symbols(n, len(ranked))
    model, rare, state = Model(size, lanes), Rare(len(ranked) - size + 1), _Lanes(lanes)
    out_lane, out_word = [], []
    ready = []
    for step in range(steps):
        if not ready:
            end = next((k for k in range(step + 1, min(step + GROUP, steps)) if _looks(k)), min(step + GROUP, steps))
            symbols = np.minimum(grid[step:end], size - 1, dtype=np.int64)
            ready = list(zip(symbols, *model.intervals(symbols)))[::-1]
        symbol, *interval = ready.pop()
        rare.refresh(step)
        for lane, word in state.narrow(_ALL, *interval):
            out_lane.append(lane.astype(np.uint16))
            out_word.append(word)
        escaped = np.flatnonzero(symbol == size - 1)
        if len(escaped):
            own = grid[step][escaped].astype(np.int64) - (size - 1)
            for lane, word in state.narrow(escaped, *rare.interval(own)):
                out_lane.append(lane.astype(np.uint16))
                out_word.append(word)
            rare.update(own)
    for shift in (48, 32, 16, 0):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append(((state.low >> U(shift)) & U(0xFFFF)).astype(np.uint16))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    return lanes, np.bincount(lane, minlength=lanes), word[np.argsort(lane, kind="stable")]


def decode_ids(n: int, ranked: np.ndarray, lanes: int, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    steps = -(-n // lanes)
    size = _symbols(n, len(ranked))
    model, rare, state = Model(size, lanes), Rare(len(ranked) - size + 1), _Lanes(lanes)
    stream = np.concatenate([words, np.zeros(8, words.dtype)]).astype(np.uint64)
    at = np.cumsum(lengths) - lengths
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << U(16)) | stream[at]
        at = at + 1

    def take(where, found, source) -> np.ndarray:
        """The symbols in the lanes where, which leave their words behind."""
        target = (code[where] - state.low[where]) // (state.width[where] >> U(TOTAL_BITS))
        symbol = found(np.minimum(target, U((1 << TOTAL_BITS) - 1)).astype(np.int64))
        for lane, _ in state.narrow(where, *source.interval(symbol)):
            next_word, read = at.take(lane), code.take(lane)
            read <<= U(16)
            read |= stream.take(next_word)
            code[lane] = read
            next_word += 1
            at[lane] = next_word
        source.update(symbol)
        return symbol

    grid = np.zeros((steps, lanes), np.int32)
    for step in range(steps):
        model.predict()
        rare.refresh(step)
        symbol = take(_ALL, model.find, model)
        escaped = np.flatnonzero(symbol == size - 1)
        if len(escaped):
            symbol = symbol.copy()
            symbol[escaped] += take(escaped, rare.find, rare)
        grid[step] = symbol
    return ranked[_turned(grid).reshape(-1)[:n]]


HEAD = "<QQIIIQ"


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One self-contained block of the file format."""
    many = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    distinct = np.flatnonzero(many)
    ranked = distinct[np.argsort(-many[distinct], kind="stable")]
    lanes, per_lane, words = encode_ids(ids, ranked) if len(ids) else (0, np.zeros(0, np.int64), np.zeros(0, np.uint16))
    there = np.array([d is not None for d in doc_ids], bool)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    head = zlib.compress(names.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + np.packbits(there).tobytes() + per_lane.astype("<u4").tobytes() + ranked.astype("<u4").tobytes(), 6)
    body = MAGIC + struct.pack(HEAD, len(doc_ids), len(ids), len(ranked), lanes, len(head), len(words)) + head + words.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, all ids); raises ValueError on any damage."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    if body[:8] != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged block of token ids")
    docs, n, distinct, lanes, head, words = struct.unpack_from(HEAD, body, 8)
    at = 8 + struct.calcsize(HEAD)
    plain = zlib.decompress(body[at : at + head])
    names = np.frombuffer(plain, "<i8", docs)
    lengths = np.frombuffer(plain, "<u4", docs, 8 * docs).astype(np.int64)
    flags = -(-docs // 8)
    there = np.unpackbits(np.frombuffer(plain, np.uint8, flags, 12 * docs), count=docs).astype(bool)
    per_lane = np.frombuffer(plain, "<u4", lanes, 12 * docs + flags).astype(np.int64)
    ranked = np.frombuffer(plain, "<u4", distinct, 12 * docs + flags + 4 * lanes).astype(np.int64)
    stream = np.frombuffer(body, "<u2", words, at + head)
    ids = decode_ids(n, ranked, lanes, per_lane, stream) if n else np.zeros(0, np.int64)
    return [int(d) if t else None for d, t in zip(names, there)], lengths, ids


def _write_batches(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = np.array([end_id], coder.dtype)
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        runs: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held
            block = write_block(docs, np.array(lengths, np.int64), np.concatenate(runs))
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_ids": held, "block": block}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())]))
            seq, before, held = seq + 1, before + held, 0
            docs.clear()
            lengths.clear()
            runs.clear()
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, ids, ends in encoded_runs(coder, batch.column(1)):
                many = np.diff(ends, prepend=0) + 1
                ids = np.insert(ids, ends, end)
                ends = np.cumsum(many)
                a = 0
                while a < last - first:
                    # documents up to the one with which the block is full
                    done = int(ends[a - 1]) if a else 0
                    b = min(last - first, int(np.searchsorted(ends, done + block_ids - held)) + 1)
                    docs += names[first + a : first + b]
                    lengths += many[a:b].tolist()
                    runs.append(ids[done : ends[b - 1]])
                    held += len(runs[-1])
                    a = b
                    if held >= block_ids:
                        yield close()
        if docs:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int = 2, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes every document's ids and end_id, in ascending doc_id order, as blocks in files under path.

    Null and empty texts have end_id alone. Null ids come first; rows that repeat an id follow
    one another. Files go through Spark's commit protocol, each holding one range of ids.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    blocks = ordered.mapInArrow(freeing(_write_batches(vocabulary_path or default_path(), end_id, block_ids)), "part int, seq int, before long, n_ids long, block binary")
    blocks.write.option("compression", "none").parquet(path)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs, lengths, ids = read_block(batch.column("block")[row].as_py())
            ids = ids.astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            first = batch.column("first")[row].as_py()
            for i in range(0, len(docs), 4096):
                part = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[part], pa.int64()), pa.array(starts[part] + first), pa.array(lengths[part]), pa.array([ids[a:b].tobytes() for a, b in zip(starts[part], ends[part])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read_batches(batches):
        crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark, path: str) -> DataFrame:
    """The blocks with the number of ids before each; one row for each file comes to the driver."""
    blocks = spark.read.schema("part int, seq int, before long, n_ids long, block binary").parquet(path)
    parts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    total, bases = 0, []
    for part, n in parts:
        bases.append((part, total))
        total += n
    return blocks.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select((F.col("base") + F.col("before")).alias("first"), "block")


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: little-endian unsigned 32-bit) of every document written under path."""
    return _placed(spark, path).mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the ids to files, reads the files back and digests what they hold: (doc_id, start, n_tokens, ids_crc32)."""
    path = path or scratch(docs.sparkSession)
    write_ids(docs, path, **options)
    return _placed(docs.sparkSession, path).mapInArrow(freeing(_digest_batches), "doc_id long, start long, n_tokens long, ids_crc32 long")
