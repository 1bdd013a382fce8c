"""LM scoring by online logistic context mixing.

A token is a short string of symbols, and a symbol a path of bits in a code: one symbol names a
very frequent word, or else the group of a word's first bytes; a second one the group of its
last bytes, or that it is a rare word; a third one a word that is not rare within both groups. A
rare word is either one of the training rows' rare words, with its share of their counts, or a
new one, spelled in bytes. Each bit has four predictors, tables of bit counts under hashed
contexts. Their logits are combined by weights that a gate picks, by kind of symbol and by how
much the longer contexts have seen. The weights start from a fit on held-back training rows;
every document then refines its own copy online, block after block, so that a score uses nothing
but the training rows and the document's own past.

What is learned grows with the training rows: the counts of all their words, in a table that is
joined and never collected, and the predictors' tables, whose slots grow as the square root of
the tokens. The tasks hold the counts of the most frequent words; all others are rare words.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX1, MIX2, SPACED, Words, crc_mod, cut, discard, freeing, mix, text_steps

U = np.uint64
#: Most words whose counts the tasks hold (a word counted once is rare in any case), and words with a symbol of their own.
VOCABULARY, TOP = 1 << 20, 128
#: Groups of first and of last bytes, some of which take the rarer ones by a hash, and pairs of them.
PREFIXES, SUFFIXES, OTHER = 112, 48, 16
ENDINGS = SUFFIXES + OTHER
GROUPS = (PREFIXES + OTHER) * ENDINGS
#: Slots of a predictor's table that travel in one row, predictors.
CHUNK, K = 1 << 14, 4
#: Tokens after which a document's weights are refined, and the rate of that.
BLOCK, RATE = 128, 0.05
#: Newton steps of the first fit, and its pull towards equal weights.
FIT_STEPS, FIT_RIDGE = 8, 20.0
#: Held-back training rows (remainder 9) from which the fit to all of them starts, and the move at which it ends.
FIT_ROWS, FIT_MOVE = 512, 0.02
STEP_BYTES = 1 << 18
#: Bits of a predictor that a task sorts before it counts them, so that it walks through the table in order.
SORTED_BITS = 3 << 19
#: Bits in a row of one gate, on the average, from which on they are mixed in the order in which they come.
SHORT_RUN = 8
#: Words, and kinds of bits, that a task counts before it passes the counts on.
COUNT_FLUSH, BITS_FLUSH = 1 << 22, 1 << 20
#: Kinds of symbols, and gates of each.
MAIN, ENDING, WORD, BYTE = range(4)
GATE_BITS = 4
KIND_GATES = 1 << GATE_BITS
GATES = 4 * KIND_GATES
#: A slot's state: a logit in steps of 1 / LOGIT_STEPS, and in the low two bits how much it has seen.
LOGIT_STEPS = 3.2
#: Rare words that the training rows' share of new ones counts for, beside a document's own.
NEW_WEIGHT = 1.0
#: Odd multipliers of the predictors' tables.
ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_START = np.array([0x243F6A8885A308D3], np.uint64)
_END = 0x13198A2E03707344


def table_bits(tokens: int) -> int:
    """Bits of a predictor's slots: they grow as the square root of the tokens, as distinct words do at least."""
    return max(16, round(math.log2(max(tokens, 1)) / 2 + 8.5))


def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, bits, lengths) of each symbol's path; every symbol has one."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    n = len(counts)
    while len(heap) > 1:
        (a, ka, x), (b, kb, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, min(ka, kb), n))
        n += 1
    paths = []
    for i in range(len(counts)):
        path = []
        while i in parent:
            i, bit = parent[i]
            path.append((i, bit))
        paths.append(path[::-1])
    longest = max(map(len, paths))
    nodes, bits = np.zeros((len(paths), longest), np.uint64), np.zeros((len(paths), longest), bool)
    for i, path in enumerate(paths):
        for j, (node, bit) in enumerate(path):
            nodes[i, j], bits[i, j] = node, bit
    return nodes, bits, np.array([len(p) for p in paths])


def short(hashes: np.ndarray) -> np.ndarray:
    """The top 32 bits of mixed 64."""
    return (hashes >> U(32)).astype(np.uint32)


def _own_memory(state: dict) -> dict:
    """An unpickled object's state with arrays of their own: those that lie in what was read are slow to look into at random.

    numpy asks for large pages for its own.
    """
    return {name: x.copy() if isinstance(x, np.ndarray) else x for name, x in state.items()}


@dataclass
class Code:
    """A Huffman code: the hashed node and the bit at each place of each symbol's path."""

    nodes: np.ndarray
    bits: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, kind: int, counts: np.ndarray) -> Code:
        nodes, bits, lengths = _huffman(counts)
        return cls(short(mix((nodes + U(1)) * U(MIX1) + U(kind + 1))), bits, lengths)

    def paths(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of each bit, the bit, its node)."""
        many = self.lengths.take(symbol)
        owner = np.repeat(np.arange(len(symbol)), many)
        # the place of a symbol's path in the table, less the events before it
        shift = symbol * self.nodes.shape[1] - (np.cumsum(many) - many)
        flat = shift.take(owner, mode="clip")
        flat += np.arange(len(owner))
        return owner, self.bits.reshape(-1).take(flat, mode="clip"), self.nodes.reshape(-1).take(flat, mode="clip")


def _shannon(weights: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, length, first, states) of each member in its group's Shannon code: the first bits of the share of heavier members.

    states[first : first + length]: the order-0 prediction of each bit of a member's path, from
    the weights of the members that share the path so far.
    """
    order = np.lexsort((-weights, groups))
    w, g = weights[order], groups[order]
    total = np.bincount(g, w, GROUPS)
    # weights of a group below 2^30 in all, so that codes are exact in 64 bits
    scale = np.maximum(np.ceil(np.log2(np.maximum(total, 1))) - 29, 0).astype(np.int64)[g]
    w = np.maximum(w >> scale, 1)
    ends = np.cumsum(w)
    begin = np.flatnonzero(np.diff(g, prepend=-1))
    many = np.diff(begin, append=len(g))
    before = ends - w - np.repeat(ends[begin] - w[begin], many)
    total = np.repeat(np.add.reduceat(w, begin) if len(g) else w, many)
    length = np.ceil(np.log2(total / w)).astype(np.int64)
    length += (w << length) < total
    length -= (length > 0) & ((w << np.maximum(length - 1, 0)) >= total)
    code = (before << length) // total
    first = np.cumsum(length) - length
    states = np.zeros(int(length.sum()), np.uint8)
    for depth in range(int(length.max(initial=0))):
        # members of one path so far follow one another
        at = np.flatnonzero(length > depth)
        path = (code[at] >> (length[at] - depth - 1)) + (g[at] << 34)
        border = np.flatnonzero(np.diff(path >> 1, prepend=-1))
        mass = w[at].astype(np.float64)
        ones = np.add.reduceat(np.where(path & 1, mass, 0.0), border)
        zeros = np.add.reduceat(mass, border) - ones
        states[first[at] + depth] = np.repeat(_state(np.log((ones + 0.1) / (zeros + 0.1)), 3), np.diff(border, append=len(at)))
    out = np.empty((3, len(order)), np.int64)
    out[:, order] = code, length, first
    return *out, states


class Vocabulary:
    """Counted words: ranks by hash, groups by first and last bytes, and all codes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, affixes: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = hashes[order], counts[order]
        affixes = affixes[order]
        n = len(self.hashes)

        def groups(keys: np.ndarray, most: int) -> np.ndarray:
            """By 16-bit key: the most counted keys get a group each, the others share some."""
            weight = np.bincount(keys, self.counts, 1 << 16)
            group = (most + np.arange(1 << 16) % OTHER).astype(np.int16)
            own = np.argsort(-weight, kind="stable")[:most]
            group[own[weight[own] > 0]] = np.flatnonzero(weight[own] > 0)
            return group

        self._first, self._last = groups(affixes >> np.uint32(16), PREFIXES), groups(affixes & np.uint32(0xFFFF), SUFFIXES)
        self.end = TOP + PREFIXES + OTHER
        self.main, self.ending = self.places(affixes)
        top = np.arange(n) < TOP
        self.main[top], self.ending[top] = np.flatnonzero(top), -1
        self._index(n)

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(_own_memory(state))

    def firsts(self, affixes: np.ndarray) -> np.ndarray:
        """Main symbols of words without one of their own."""
        return (TOP + self._first[affixes >> np.uint32(16)]).astype(np.int16)

    def places(self, affixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(main symbol, ending) of words without a symbol of their own."""
        return self.firsts(affixes), self._last[affixes & np.uint32(0xFFFF)].astype(np.int8)

    def code(self, tokens: np.ndarray, once: int, held: int, end: int, byte_counts: np.ndarray) -> None:
        """Makes the codes from the tokens of the rare words of each group of first bytes.

        once: tokens of words counted once, which would be new had they been left out; held:
        tokens of words that would then be rare, but known.
        """
        own = self.ending >= 0
        group = group_of(self.main[own], self.ending[own])
        self.word, self.word_length, self.word_path = np.zeros(len(own), np.uint32), np.zeros(len(own), np.uint8), np.zeros(len(own), np.uint32)
        self.word[own], self.word_length[own], self.word_path[own], self.paths = _shannon(self.counts[own], group)
        main = np.bincount(self.main, self.counts, self.end + 1)
        main[TOP:-1] += tokens
        main[self.end] = end
        ending = np.append(np.bincount(self.ending[own], self.counts[own], ENDINGS), tokens.sum())
        self.codes = {MAIN: Code.of(MAIN, main), ENDING: Code.of(ENDING, ending), BYTE: Code.of(BYTE, byte_counts)}
        #: The share of rare words that are new, and for each group of first bytes log10 of what one of its rare tokens is of them.
        self.new = float((once + 0.5) / (once + held + 1.0))
        self.known = -np.log10(np.maximum(tokens, 1))

    def _index(self, n: int) -> None:
        """An open-addressing table of ranks by the hash's top bits, filled in runs of words."""
        bits = max(4, int(n).bit_length() + 1)
        self._shift = U(64 - bits)
        self._table = np.full(1 << bits, -1, np.int32)
        self._probes = 0
        for start in range(0, n, 1 << 18):
            rest, probe = np.arange(start, min(n, start + (1 << 18))), 0
            while len(rest):
                slot = ((self.hashes[rest] >> self._shift).astype(np.int64) + probe) & (len(self._table) - 1)
                free = self._table[slot] < 0
                _, first = np.unique(slot[free], return_index=True)
                won = np.flatnonzero(free)[first]
                self._table[slot[won]] = rest[won]
                rest = np.delete(rest, won)
                probe += 1
            self._probes = max(self._probes, probe)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each hash, -1 outside the vocabulary."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        rest, base = np.arange(len(h)), (h >> self._shift).astype(np.int64)
        for probe in range(self._probes):
            found = self._table[(base[rest] + probe) & (len(self._table) - 1)]
            same = (found >= 0) & (self.hashes[np.maximum(found, 0)] == h[rest])
            out[rest[same]] = found[same]
            rest = rest[(found >= 0) & ~same]
            if not len(rest):
                break
        return out


def group_of(main: np.ndarray, ending: np.ndarray) -> np.ndarray:
    return (main.astype(np.int64) - TOP) * ENDINGS + ending


@dataclass
class Symbols:
    """Symbols of one kind: the token of each, what codes it, and its four contexts (32 mixed bits, or None for none)."""

    kind: int
    token: np.ndarray
    contexts: list[np.ndarray | None]
    symbol: np.ndarray
    code: Code | None = None
    # of the kind WORD, whose symbols are codes themselves: code length, group, and where the paths' order-0 states begin
    length: np.ndarray | None = None
    group: np.ndarray | None = None
    path: np.ndarray | None = None

    def ordered(self, order: np.ndarray) -> Symbols:
        pick = lambda x: None if x is None else x[order]
        return replace(self, token=self.token[order], contexts=[pick(c) for c in self.contexts], symbol=self.symbol[order], length=pick(self.length), group=pick(self.group), path=pick(self.path))

    def lengths(self) -> np.ndarray:
        return self.length.astype(np.int64) if self.code is None else self.code.lengths[self.symbol]

    def events(self, bits: int, counting: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(symbol of each bit, the bit, its slot in each table of 2^bits slots; first, for the kind WORD, in the paths).

        counting: twice the slot, and the bit, in 32 bits instead of the slot; nothing in the paths.
        """
        owner, bit, slots = self.walk(bits, counting)
        return owner, bit, list(slots)

    def walk(self, bits: int, counting: bool = False) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
        """events() with the slots made one table after the other, so that they need not be held together."""
        if self.code is not None:
            owner, bit, node = self.code.paths(self.symbol)
        else:
            many = self.lengths()
            owner = np.repeat(np.arange(len(many)), many)
            after = np.cumsum(many).take(owner, mode="clip")
            after -= np.arange(1, len(owner) + 1)  # bits after this one
            code = (self.symbol.astype(np.int64) | (1 << many)).take(owner, mode="clip")
            code >>= after
            bit = code.astype(np.uint8)
            bit &= np.uint8(1)
            bit = bit.view(bool)
            code >>= 1
            code += (self.group << 34).take(owner, mode="clip")
            node = code.view(np.uint64)
            node *= U(MIX1)
            node = short(node)

        def slots() -> Iterator[np.ndarray]:
            for k, c in enumerate(self.contexts):
                if k == 0 and self.path is not None:
                    if counting:
                        yield None
                        continue
                    slot = (self.path.astype(np.int64) + many - 1).take(owner, mode="clip")
                    slot -= after
                    yield slot
                    continue
                if c is None:
                    slot = node * ODD[k]
                else:
                    slot = c.take(owner, mode="clip")
                    slot += node
                    slot *= ODD[k]
                slot >>= np.uint32(32 - bits)
                if counting:
                    slot <<= np.uint32(1)
                    slot |= bit
                yield slot if counting else slot.astype(np.int64)

        return owner, bit, slots()


@dataclass
class Tokens:
    """The tokens of a run of documents, each document's words and its end."""

    words: Words
    rank: np.ndarray  # of each word, -1 for a rare one
    first: np.ndarray  # token of each document, and one past the last
    symbols: list[Symbols]
    rare: np.ndarray  # the words that are rare
    rare_at: np.ndarray  # their tokens
    rare_first: np.ndarray  # their groups of first bytes


def tokens_of(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, spell: np.ndarray | None = None) -> Tokens:
    """Tokens, symbols and the four hashed contexts of each symbol; rare words are also spelled.

    spell: whether each document's are, all where it is not given.
    """
    words = Words(data, offsets, SPACED)
    rank = vocabulary.ranks(words.hashes)
    at = np.arange(len(rank)) + words.owners()  # token of each word
    first = words.first + np.arange(len(offsets))
    n = int(first[-1])
    rare = np.flatnonzero(rank < 0)
    sizes = words.lengths()
    main, ending, hashes = np.full(n, vocabulary.end, np.int64), np.full(n, -1, np.int64), np.full(n, U(_END))
    code, length, path = np.zeros(n, np.uint32), np.zeros(n, np.uint8), np.zeros(n, np.uint32)
    hashes[at] = words.hashes
    if len(vocabulary.main):
        main[at], ending[at], code[at], length[at], path[at] = (x[rank] for x in (vocabulary.main, vocabulary.ending, vocabulary.word, vocabulary.word_length, vocabulary.word_path))
    rare_at = at[rare]
    main[rare_at], ending[rare_at], length[rare_at] = vocabulary.firsts(_affixes(words, sizes, rare)), ENDINGS, 0

    def past(x: np.ndarray, back: int, fill: int) -> np.ndarray:
        out = np.full(n, fill, x.dtype)
        out[back:] = x[:-back] if back < n else x[:0]
        for i in range(back):
            starts = first[:-1] + i
            out[starts[starts < first[1:]]] = fill
        return out

    h1, h2 = past(hashes, 1, int(_START[0])), past(hashes, 2, int(_START[0]))
    # as contexts rare words are a class of their own: where one stands, others follow
    seen_main, seen_ending = main.copy(), ending.copy()
    seen_main[rare_at], seen_ending[rare_at] = vocabulary.end + 1, -1
    m1, m2, s1 = past(seen_main, 1, vocabulary.end), past(seen_main, 2, vocabulary.end), past(seen_ending, 1, -1)
    kind1 = (m1 * 64 + s1 + 1).astype(np.uint64)
    one, both = short(h1), short(mix(h1 + h2 * U(MIX2)))
    classes = short(mix(kind1 * U(512) + m2.astype(np.uint64)))
    symbols = [Symbols(MAIN, np.arange(n), [None, one, both, classes], main, vocabulary.codes[MAIN])]
    some = np.flatnonzero(ending >= 0)
    own = main[some].astype(np.uint64)
    near = [own * U(MIX1), mix(own + h1[some]), mix(own + kind1[some] * U(MIX2)), mix(own * U(1024) + m1[some].astype(np.uint64) + U(3))]
    symbols.append(Symbols(ENDING, some, [short(c) for c in near], ending[some], vocabulary.codes[ENDING]))
    some = some[length[some] > 0]
    symbols.append(Symbols(WORD, some, [None, one[some], short(mix(kind1[some] + U(5))), classes[some]], code[some], length=length[some], group=group_of(main[some], ending[some]), path=path[some]))
    spelled = rare if spell is None else rare[np.asarray(spell)[at[rare] - rare]]
    spelled_at, sizes = at[spelled], sizes[spelled]
    many = sizes + 1
    which = np.repeat(np.arange(len(spelled)), many)
    place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    low = np.append(words.low, 0).astype(np.int64)
    start = words.starts[spelled][which]
    byte = np.where(place < sizes[which], low[np.minimum(start + place, len(low) - 1)], 256)
    before = [np.where(place >= back, low[np.maximum(start + place - back, 0)], 257).astype(np.uint64) for back in (1, 2, 3, 4)]
    token = spelled_at[which]
    # the group, coded before, tells a word's first two bytes
    told = np.where(place < 2, main[token], 0).astype(np.uint64)
    two = ((before[0] + U(1)) * U(512) + before[1]) * U(1024) + told
    three = two * U(512) + before[2]
    near = [mix(two), mix(three + U(1)), mix(three * U(512) + before[3] + U(2)), mix((two * U(512) + m1[token].astype(np.uint64)) * U(4) + U(3))]
    symbols.append(Symbols(BYTE, token, [short(c) for c in near], byte, vocabulary.codes[BYTE]))
    return Tokens(words, rank, first, symbols, rare, rare_at, main[rare_at] - TOP)


# ---- counting words --------------------------------------------------------------------------


def _affixes(words: Words, lengths: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The first two and the last two bytes of the words at, in 32 bits."""
    low = np.append(words.low, 0).astype(np.uint32)
    start, lengths = words.starts[at], lengths[at]
    first = low[start] * np.uint32(256) + np.where(lengths > 1, low[np.minimum(start + 1, len(low) - 1)], np.uint32(0))
    end = start + lengths - 1
    last = low[end] + np.uint32(256) * np.where(lengths > 1, low[np.maximum(end - 1, 0)], np.uint32(0))
    return (first << np.uint32(16)) | last


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal hashes together, where each run begins in it)."""
    order = np.argsort(hashes)
    return order, np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and with the affix -1 how often each byte, and the end of a word (256), occurs in the distinct words of each run."""
    spelled = np.zeros(257, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, affix = (np.concatenate([x[i] for x in held]) for i in range(3))
        order, first = _runs(h)
        return h[order[first]], np.add.reduceat(n[order], first), affix[order[first]]

    def row(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], names=["word", "n", "affix"])

    for batch in batches:
        for _, _, data, offsets in text_steps(batch.column(0)):
            words = Words(data, offsets, SPACED)
            if not len(words.hashes):
                continue
            order, first = _runs(words.hashes)
            at, many = order[first], np.diff(first, append=len(order))
            lengths = words.lengths()
            held.append((words.hashes[at], many, _affixes(words, lengths, at).astype(np.int64)))
            many = lengths[at]
            ends = np.cumsum(many)
            inside = np.repeat(words.starts[at] - (ends - many), many)
            inside += np.arange(len(inside))
            spelled[:256] += np.bincount(words.low[inside], minlength=256)
            spelled[256] += len(at)
            size += len(at)
            if size > COUNT_FLUSH:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > COUNT_FLUSH // 2:
                    yield row(held.pop())
                    size = 0
    if held:
        yield row(merged())
    if spelled.any():
        yield row((np.arange(257, dtype=np.uint64), spelled, np.full(257, -1)))


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of (word, n, affix) as one row of packed 64, 64 and 32 bit columns."""
    for batch in batches:
        word, n, affix = (np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("word", "n", "affix"))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (word, n, affix.astype(np.uint32))], names=["word", "n", "affix"])


def _rare_batches(shared):
    """(group of first bytes, tokens) of rare words (n, affix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        sums = np.zeros(PREFIXES + OTHER, np.int64)
        for batch in batches:
            n, affix = (np.asarray(batch.column(c)) for c in ("n", "affix"))
            sums += np.bincount(vocabulary.firsts(affix.astype(np.uint32)) - TOP, n, len(sums)).astype(np.int64)
        group = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(sums[group])], names=["group", "tokens"])

    return run


# ---- learning --------------------------------------------------------------------------------


def _learn_batches(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        tables = np.zeros((K, 2 << bits), np.uint32)
        waiting: list[list[np.ndarray]] = [[] for _ in range(K)]

        def count(k: int) -> None:
            at = np.concatenate(waiting[k])
            waiting[k].clear()
            if k:  # the first predictor's few contexts lie in the caches in any order
                at.sort()
            np.add.at(tables[k], at.astype(np.int64), np.uint32(1))

        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0), STEP_BYTES):
                for own in tokens_of(data, offsets, vocabulary).symbols:
                    for k, at in enumerate(own.events(bits, counting=True)[2]):
                        if at is not None:
                            waiting[k].append(at)
                            if k == 0 or sum(map(len, waiting[k])) > SORTED_BITS:
                                count(k)
        for k in range(1, K):
            if waiting[k]:
                count(k)
        per_table = (2 << bits) // CHUNK
        for k in range(K):
            for chunk in range(per_table):
                part = tables[k, chunk * CHUNK : (chunk + 1) * CHUNK]
                if part.any():
                    yield _chunk_row(k * per_table + chunk, part)

    return run


def _chunk_row(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counts as planes of equal bytes, which compression folds."""
    planes, top = np.zeros((4, len(counts)), np.uint8), int(counts.max())
    for i in range(4):
        if top >> 8 * i:
            planes[i] = counts >> np.uint32(8 * i)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([planes.tobytes()], pa.binary())], names=["chunk", "counts"])


def _chunk_counts(part: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(part.as_buffer(), np.uint8).reshape(4, CHUNK)
    counts = planes[0].astype(np.uint32)
    for i in (1, 2, 3):
        if planes[i].any():
            counts |= planes[i].astype(np.uint32) << np.uint32(8 * i)
    return counts


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = _chunk_counts(part).astype(np.uint64)
            sums[chunk] = sums[chunk] + counts if chunk in sums else counts
    for chunk, counts in sums.items():
        yield _chunk_row(chunk, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))


def _logits(states: np.ndarray, sign: np.ndarray | None = None) -> np.ndarray:
    """The logits of states, times a sign; in bytes as far as that goes, which is quicker than a look into a table."""
    level = (states >> np.uint8(2)).view(np.int8)
    level -= np.int8(32)
    if sign is not None:
        level *= sign
    out = level.astype(np.float32)
    out /= np.float32(LOGIT_STEPS)
    return out


def _state(logit: np.ndarray, seen: np.ndarray | int) -> np.ndarray:
    return (np.clip(np.rint(logit * LOGIT_STEPS), -31, 31).astype(np.int64) + 32 << 2 | seen).astype(np.uint8)


def states_of(counts: np.ndarray) -> np.ndarray:
    """The states of slots with counts of zeros and ones in turn."""
    zeros, ones = counts[0::2].astype(np.float64), counts[1::2].astype(np.float64)
    return _state(np.log((ones + 0.4) / (zeros + 0.4)), np.searchsorted([0.5, 2.5, 15.5], zeros + ones))


def _state_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = [states_of(_chunk_counts(part)).tobytes() for part in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.binary())], names=["chunk", "states"])


@dataclass
class Model:
    """All that scoring needs: vocabulary, predictors' states, first weights and totals."""

    vocabulary: Vocabulary
    bits: int
    states: np.ndarray
    weights: np.ndarray
    train_tokens: int
    distinct: int
    end_count: int

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(_own_memory(state))

    @property
    def unit(self) -> float:
        """log10 of the base score's denominator."""
        return math.log10(self.train_tokens + 0.1 * (self.distinct + 1))


def _states(model: Model, own: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each bit, the bit, the state that each predictor has for it)."""
    event, bit, slots = own.walk(model.bits)
    states = np.empty((K, len(event)), np.uint8)
    for k, at in enumerate(slots):
        table = model.vocabulary.paths if k == 0 and own.kind == WORD else model.states[k]
        table.take(at, mode="clip", out=states[k])
    return event, bit, states


def _gates(states: np.ndarray) -> np.ndarray:
    """The gate of each bit among those of its kind of symbol."""
    return (states[1] & np.uint8(3)) * np.uint8(4) + (states[2] & np.uint8(3))


def _bits(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(distinct kinds of bits of all tokens, how often each occurs): from the top, kind of symbol, the bit, four states."""
    keys, times = [], []
    for own in tokens.symbols:
        _, bit, states = _states(model, own)
        seen = np.zeros(len(bit), np.uint32)
        for state in states:
            seen <<= np.uint32(8)
            seen |= state
        for b, one in enumerate((~bit, bit)):
            key = seen[one]
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            keys.append(key[first].astype(np.uint64) | U(own.kind << 33 | b << 32))
            times.append(np.diff(first, append=len(key)))
    return np.concatenate(keys), np.concatenate(times)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of bits and how often each occurs from several."""
    key, n = (np.concatenate(x) for x in zip(*found))
    order, first = _runs(key)
    return key[order[first]], np.add.reduceat(n[order], first) if len(n) else n


def _fit_weights(model: Model, texts: list[str | None]) -> None:
    """Where the fit starts: each gate's logistic regression on some held-back rows, by Newton steps."""
    found = _merged([_bits(model, tokens_of(data, offsets, model.vocabulary)) for _, _, data, offsets in text_steps(pa.array(texts, pa.large_string()), STEP_BYTES)])
    for _ in range(FIT_STEPS):
        _newton(model.weights, _slopes(*found, model.weights))


def _slopes(key: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(gate x K x K+1): curvature of each gate's log loss, and beside it the slope, over bits that occur n times."""
    out = np.zeros((GATES, K, K + 1))
    states = np.stack([(key >> U(8 * (K - 1 - k))).astype(np.uint8) for k in range(K)])
    gate = (key >> U(33)).astype(np.uint8) * np.uint8(KIND_GATES) + _gates(states)
    order = np.argsort(gate, kind="stable")
    many = np.bincount(gate, minlength=GATES)
    edge = np.concatenate([[0], np.cumsum(many)])
    bit, n, states = (key >> U(32) & U(1)).astype(np.float64)[order], n[order], states[:, order]
    for g in np.flatnonzero(many):
        rows = slice(edge[g], edge[g + 1])
        own = _logits(states[:, rows]).astype(np.float64)
        p = weights[g] @ own
        np.clip(p, -14, 14, out=p)
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        np.reciprocal(p, out=p)
        out[g, :, :K] = (own * (p * (1 - p) * n[rows])) @ own.T
        out[g, :, K] = own @ ((bit[rows] - p) * n[rows])
    return out


def _newton(weights: np.ndarray, sums: np.ndarray) -> float:
    """One step of each gate that has bits; the largest move."""
    moved = 0.0
    for g in np.flatnonzero(sums.any(axis=(1, 2))):
        step = np.clip(np.linalg.solve(sums[g, :, :K] + FIT_RIDGE * np.eye(K), sums[g, :, K] + FIT_RIDGE * (0.35 - weights[g])), -0.5, 0.5)
        weights[g] += step
        moved = max(moved, float(np.abs(step).max()))
    return moved


def _bit_batches(shared):
    """Bits of texts and how often each occurs, packed: a row holds at most about BITS_FLUSH of them."""

    def row(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in _merged(found)], names=["bits", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0), STEP_BYTES):
                held.append(_bits(model, tokens_of(data, offsets, model.vocabulary)))
                if sum(len(key) for key, _ in held) > BITS_FLUSH:
                    held[:] = [_merged(held)]
                    if len(held[0][0]) > BITS_FLUSH // 2:
                        yield row(held)
                        held.clear()
        if held:
            yield row(held)

    return run


def _slope_batches(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((GATES, K, K + 1))
        for batch in batches:
            for key, n in zip(batch.column(0), batch.column(1)):
                sums += _slopes(np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64), weights)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], names=["at", "part"])

    return run


def _fit_all(model: Model, rows: DataFrame) -> None:
    """Goes on with Newton steps whose sums run over all rows (text), until the weights rest.

    The states do not change meanwhile, so that the rows' bits are counted once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    counted = cut(rows.mapInArrow(freeing(_bit_batches(shared)), "bits binary, n binary"))
    shared.unpersist()
    for _ in range(FIT_STEPS):
        sums = np.zeros(GATES * K * (K + 1))
        for at, part in counted.mapInArrow(freeing(_slope_batches(model.weights.copy())), "at long, part double").groupBy("at").agg(F.sum("part")).collect():
            sums[at] = part
        if _newton(model.weights, sums.reshape(GATES, K, K + 1)) < FIT_MOVE:
            break
    discard(counted)


def score_run(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(log2 probability of each document without its rare words' own names, log2 probability of each rare word's spelling).

    A document's weights are refined block after block. Kinds of symbol have gates of their own,
    so each kind is mixed in a pass of its own.
    """
    n_docs = len(tokens.first) - 1
    many = np.diff(tokens.first)
    owner = np.repeat(np.arange(n_docs), many)
    place = (np.arange(len(owner)) - np.repeat(tokens.first[:-1], many)) // BLOCK
    # twice the block, and one where it is the document's last, from which nothing more is learned
    place += place
    place += place == np.repeat((many - 1) // BLOCK * 2, many)
    place = place.astype(np.uint16 if len(place) == 0 or place.max() < 1 << 16 else np.uint32)
    out, spelled = np.zeros(n_docs), np.zeros(len(tokens.rare))
    rare_number = np.zeros(len(owner), np.int64)
    rare_number[tokens.rare_at] = np.arange(len(tokens.rare))
    for own in tokens.symbols:
        if not len(own.token):
            continue
        block = place[own.token]
        if (block != block[0]).any():
            own = own.ordered(np.argsort(block, kind="stable"))
            block = place[own.token]
        event, bit, states = _states(model, own)
        # events of each block of all documents: first of those that go on, then of those that end with it
        ends = np.concatenate([[0], np.cumsum(own.lengths())])
        edge = ends[np.searchsorted(block, np.arange((int(block[-1]) | 1) + 2))]
        doc, gate = owner[own.token], _gates(states)
        first = model.weights[own.kind * KIND_GATES : (own.kind + 1) * KIND_GATES].astype(np.float32)
        weights = np.tile(first.T, (1, n_docs))
        cell = (doc * KIND_GATES).take(event, mode="clip")
        cell += gate
        if own.kind == BYTE:  # each rare word has a sum of its own, so that its bits stay together
            into = rare_number[own.token].take(event)
        else:
            into = None
            if SHORT_RUN * np.count_nonzero(cell[1:] != cell[:-1]) > len(cell):  # else the gates hardly change
                # in each document's block, bits of one gate are brought together
                border = np.ones(len(doc), bool)
                border[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
                part = (np.cumsum(border) - 1) * KIND_GATES
                key = part.astype(np.uint16 if part[-1] < 1 << 16 else np.uint32).take(event, mode="clip")
                key += gate
                order = np.argsort(key, kind="stable")
                cell, bit, states = cell.take(order, mode="clip"), bit.take(order, mode="clip"), states.take(order, axis=1, mode="clip")
        # for the bit that came: the logit, turned where that is a zero
        x = _logits(states, bit.view(np.int8) * np.int8(2) - np.int8(1))
        _mixed_online(x, cell, into, weights, edge[::2], spelled if own.kind == BYTE else out, edge[1::2])
    return out / math.log(2), spelled / math.log(2)


def _mixed_online(x: np.ndarray | list[np.ndarray], cell: np.ndarray, into: np.ndarray | None, weights: np.ndarray, edge: np.ndarray, out: np.ndarray, onward: np.ndarray | None = None) -> None:
    """Adds the natural log probability of each bit to out[into], or out of its cell's document; x: logits turned so that positive speaks for the bit that came.

    edge: where each block's events begin; onward: where in each those begin from which no weights
    are refined, none but the last block's where it is not given.
    """
    if not len(cell):
        return
    if onward is None:
        onward = np.append(edge[1:-1], edge[-2])
    border = np.ones(len(cell), bool)
    border[1:] = cell[1:] != cell[:-1]
    if into is not None:
        border[1:] |= into[1:] != into[:-1]
    for at in (edge, onward):
        border[at[at < len(cell)]] = True
    # runs of bits of one cell, and one sum
    first = np.flatnonzero(border)
    whole, many = np.empty(len(cell), np.float32), np.diff(first, append=len(cell))
    x, cell, into = np.asarray(x), cell[first], None if into is None else into[first]
    # blocks may be small, so that what need not be done for each is left for all together
    run_edge, run_onward = np.searchsorted(first, edge).tolist(), np.searchsorted(first, onward).tolist()
    for i, (a, c, b) in enumerate(zip(edge[:-1].tolist(), onward.tolist(), edge[1:].tolist())):
        if a == b:
            continue
        runs = slice(run_edge[i], run_edge[i + 1])
        parts = np.repeat(weights.take(cell[runs], axis=1, mode="clip"), many[runs], axis=1)
        parts *= x[:, a:b]
        z = parts[0]
        for k in range(1, K):
            z += parts[k]
        np.maximum(z, -14, out=z)
        np.minimum(z, 14, out=z)
        np.negative(z, out=z)
        odds = np.exp(z, out=z)  # of the bit that did not come
        np.add(odds, 1, out=whole[a:b])
        if a == c:
            continue
        other = np.divide(odds[: c - a], whole[a:c], out=odds[: c - a])
        other *= np.float32(RATE)
        runs = slice(run_edge[i], run_onward[i])
        at, times = cell[runs], many[runs]
        moves = np.add.reduceat(x[:, a:c] * other, first[runs] - a, axis=1)
        low, high = int(at.min()), int(at.max())
        if high - low < 4 * (c - a):  # documents near one another
            at, span = at - low, high - low + 1
            root = np.sqrt(np.maximum(np.bincount(at, times, span), 1))
            for k in range(K):
                weights[k, low : high + 1] += np.bincount(at, moves[k], span) / root
        else:
            value, back = np.unique(at, return_inverse=True)
            root = np.sqrt(np.bincount(back, times))
            for k in range(K):
                weights[k][value] += np.bincount(back, moves[k]) / root
    own = cell >> GATE_BITS if into is None else into
    out -= np.bincount(own, np.add.reduceat(np.log(whole, out=whole), first, dtype=np.float64), len(out))


# ---- the operator ----------------------------------------------------------------------------


def _least_count(counts: DataFrame) -> int:
    """The least count, 2 or more, from which on there are at most VOCABULARY words. Few distinct counts come to the driver."""
    spread = counts.where("n > 1").groupBy(F.least("n", F.lit(VOCABULARY)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator()
    held, least = 0, VOCABULARY + 1
    for n, words in spread:
        if held + words > VOCABULARY:
            break
        held, least = held + words, n
    return least


def learn(docs: DataFrame, remainder: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model, counts of all training words) from the rows whose remainder is not 0.

    Counts cover all training rows. Predictors learn from those with remainders 1 to 8; then the
    first weights are fitted to all rows with remainder 9, which the predictors learn at last. To
    the driver come the most frequent words (at most VOCABULARY rows) and the predictors' states.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), remainder.alias("fold"))
    training = own.where("fold <> 0")
    counted = cut(training.select("text").mapInArrow(freeing(_count_batches), "word long, n long, affix long").groupBy("word", (F.col("affix") < 0).alias("byte")).agg(F.sum("n").alias("n"), F.max("affix").alias("affix")))
    counts = counted.where("not byte").drop("byte")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, end = _least_count(counts), training.count()
    # packed columns, batch by batch: rows would take the driver many times their size
    kept = [tuple(r) for r in counts.where(F.col("n") >= least).mapInArrow(_packed_batches, "word binary, n binary, affix binary").toLocalIterator()]
    vocabulary = Vocabulary(*(np.frombuffer(b"".join(r[i] for r in kept), kind) for i, kind in enumerate((np.uint64, np.int64, np.uint32))))
    del kept
    rare = np.zeros(PREFIXES + OTHER, np.int64)
    few = counts.where(F.col("n") < least).select("n", "affix").mapInArrow(_rare_batches(spark.sparkContext.broadcast(vocabulary)), "group long, tokens long")
    for group, n in few.groupBy("group").agg(F.sum("tokens")).collect():
        rare[group] = n
    once, held = counts.agg(F.count(F.when(F.col("n") == 1, 1)), F.coalesce(F.sum(F.when(F.col("n").between(2, least), F.col("n"))), F.lit(0))).first()
    spelled = np.zeros(257, np.int64)
    for byte, n in counted.where("byte").select("word", "n").collect():
        spelled[byte] = n
    vocabulary.code(rare, once, held, end, spelled)
    shared = spark.sparkContext.broadcast(vocabulary)
    tokens = int(totals[0]) + end
    bits = table_bits(tokens)
    # a task's tables travel whole, so tasks are no more than the tokens pay for
    cores = spark.sparkContext.defaultParallelism
    tasks = max(2 * cores, tokens >> (bits + 2))

    def counted_bits(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
        # the rows held back, which come last, are a ninth
        most = tasks if before is None else max(cores, tasks // 9)
        found = rows.select("text").coalesce(most).mapInArrow(freeing(_learn_batches(shared, bits)), "chunk long, counts binary")
        found = found if before is None else found.unionByName(before)
        return found.repartition("chunk").mapInArrow(_sum_batches, "chunk long, counts binary")

    states = np.full((K, 1 << bits), states_of(np.zeros(2, np.uint32))[0], np.uint8)

    def take(summed: DataFrame) -> None:
        flat = states.reshape(-1)
        for chunk, part in summed.mapInArrow(_state_batches, "chunk long, states binary").toLocalIterator():
            flat[chunk * (CHUNK // 2) : (chunk + 1) * (CHUNK // 2)] = np.frombuffer(part, np.uint8)

    held_back = training.where("fold = 9")
    most = cut(counted_bits(training.where("fold <> 9")))
    take(most)
    model = Model(vocabulary, bits, states, np.full((GATES, K), 0.35), tokens, int(totals[1]) + (end > 0), end)
    sample = held_back.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("text").collect()
    if sample:
        _fit_weights(model, [r[0] for r in sample])
        _fit_all(model, held_back.select("text"))
        take(counted_bits(held_back, most))
    return model, counts


SCHEMA = "row long, doc_id long, fold long, n_bytes long, n_tokens long, n_known long, base double, score double, rare array<struct<word: long, known: double, new: double>>"


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        row = TaskContext.get().partitionId() << 40
        log_end, log_counts = math.log10(model.end_count + 0.1), np.log10(model.vocabulary.counts + 0.1)
        for batch in batches:
            for i, j, data, offsets in text_steps(batch.column(2), STEP_BYTES):
                # the words of training rows are counted and so known, whatever their spelling's share
                held_out = batch.column(1).slice(i, j - i).to_numpy() == 0
                tokens = tokens_of(data, offsets, model.vocabulary, held_out)
                score, spelled = (x * math.log10(2) for x in score_run(model, tokens))
                n = j - i
                known, owner = tokens.rank >= 0, tokens.words.owners()
                spelled[~held_out[owner[tokens.rare]]] = np.nan  # never asked for
                n_tokens = tokens.words.counts() + 1
                n_known = np.bincount(owner[known], minlength=n) + (model.end_count > 0)
                base = log_end + (np.bincount(owner[known], log_counts[tokens.rank[known]], n) if known.any() else np.zeros(n))
                rare = pa.StructArray.from_arrays([pa.array(tokens.words.hashes[tokens.rare].view(np.int64)), pa.array(model.vocabulary.known[tokens.rare_first]), pa.array(spelled)], names=["word", "known", "new"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=n))]).astype(np.int32)
                columns = [np.arange(row, row + n), batch.column(0).slice(i, n), batch.column(1).slice(i, n), np.diff(offsets), n_tokens.astype(np.int64), n_known.astype(np.int64), base, score]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends), rare)], names=["row", "doc_id", "fold", "n_bytes", "n_tokens", "n_known", "base", "score", "rare"])
                row += n

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    Learns from the rows whose crc32(doc_id as text) modulo 10 is not 0 (a null id is held out).
    A token is a word between white space, lower-cased in A-Z, or a text's end; a null or empty
    text is an end alone. base_score is the smoothed unigram's; score the model's log10
    probability of the text's tokens, bits_per_byte what that makes for each byte of the text
    (null without bytes). Repeated rows are scored alike; other columns are ignored. Words that
    the tasks do not hold find their counts in a join, which also tells known from new ones.
    """
    spark = docs.sparkSession
    remainder = crc_mod(F.col(id_col), 10)
    model, counts = learn(docs, remainder, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), remainder.cast("long").alias("fold"), F.col(text_col).alias("text"))
    rows = cut(own.mapInArrow(freeing(_score_batches(spark.sparkContext.broadcast(model))), SCHEMA))
    rare = rows.select("row", F.inline("rare")).join(counts.select("word", "n"), "word", "left")
    named = F.when(F.col("n").isNull(), F.col("new")).otherwise(F.col("known") + F.log10("n"))
    found = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("more_known"), F.count("*").alias("n_rare"), F.sum(named).alias("named"))
    # each rare word is new or known with the share of such among those before it in the document, and of the training rows
    rising = lambda n, start: f"IF({n} > 0, aggregate(sequence(0L, {n} - 1), 0D, (s, i) -> s + log10(i + {start!r}D)), 0D)"
    new = model.vocabulary.new * NEW_WEIGHT
    told = F.expr(f"{rising('n_rare - more_known', new)} + {rising('more_known', NEW_WEIGHT - new)} - {rising('n_rare', NEW_WEIGHT)}")
    out = rows.drop("rare").join(found, "row", "left").withColumn("score", F.col("score") + F.coalesce(F.col("named") + told, F.lit(0.0)))
    return out.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(model.unit)).alias("base_score"),
        "score",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
