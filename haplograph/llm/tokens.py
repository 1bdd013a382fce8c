"""Tokenizing whole texts with a given vocabulary file."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hashes_of, text_buffers

#: Distinct words that a worker notes before the older of two generations of them goes.
KEPT_WORDS = 800_000
#: Marks that may follow a word's letters without changing their ids (no apostrophe: it joins).
MARKS = ",.;:!?%&$#*+=|~^-_/()[]{}<>@"
#: Lower-case words of Latin letters alone.
LETTERS = r"\A[a-zß-öø-ÿ]+\z"
#: A longer word is encoded each time.
KEPT_LENGTH = 48
#: Words encoded in one call, and words of letters that make up one text of such a call.
CALL_WORDS, JOINED_WORDS = 4096, 512
#: Kinds of bytes: in a word; lower and upper ASCII letters; a mark; the lead of a Latin-1 letter; what may follow it, for upper and lower; white space.
OTHER, LOW, UP, MARK, LEAD, FOLLOW_UP, FOLLOW_LOW, SEPARATOR = range(8)
#: What a byte does, from its kind and that of the byte before: starts a word, breaks the form letters-then-marks, is a mark right after a letter, is an upper-case letter's.
BEGINS, BREAKS, TURNS, RISES = 1, 2, 4, 8
#: The separators: a tokenizer that drops white space sees neither.
WHITE = b" \n"


def _kinds() -> bytes:
    kind = bytearray(256)
    kind[97:123], kind[65:91] = [LOW] * 26, [UP] * 26
    for c in MARKS.encode():
        kind[c] = MARK
    kind[0xC3] = LEAD
    for i in range(0x80, 0xC0):
        sign = i in (0x97, 0xB7)  # multiplication and division
        kind[i] = OTHER if sign else FOLLOW_UP if i < 0x9F else FOLLOW_LOW
    for c in WHITE:
        kind[c] = SEPARATOR
    return bytes(kind)


def _roles() -> bytes:
    """Roles by 8 times the kind before plus the kind; a text's first byte comes after white space."""
    role = bytearray(256)
    for before in range(8):
        for kind in range(7):
            follows = kind in (FOLLOW_UP, FOLLOW_LOW)
            letter = kind in (LOW, UP, LEAD) or (follows and before == LEAD)
            flags = BEGINS if before == SEPARATOR else 0
            if kind == MARK:
                flags |= BREAKS if before == SEPARATOR else TURNS if before != MARK else 0
            elif not letter or before == MARK:
                flags |= BREAKS
            if before == LEAD and not follows:
                flags |= BREAKS
            if kind == UP or kind == FOLLOW_UP:
                flags |= RISES
            role[8 * before + kind] = flags
    return bytes(role)


KINDS, ROLES = _kinds(), _roles()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _room(x: np.ndarray, used: int, need: int) -> np.ndarray:
    """x, or a longer copy of what is used of it."""
    return x if need <= len(x) else np.concatenate([x[:used], np.zeros(need, x.dtype)])


class _Noted:
    """Words and their ids: an open-addressing table of the words' numbers by a hash of their bytes, all ids and all bytes in arrays.

    A word is found where its bytes are those noted. One whose hash another word has is not
    found, and is encoded anew.
    """

    def __init__(self, dtype: np.dtype):
        self.starts, self.lens = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, dtype)
        self.hashes, self.text_starts, self.text_lens = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.text = np.zeros(1 << 15, np.uint8)
        self.words = self.used = self.text_used = 0
        self._index(13)

    def add(self, lens: np.ndarray, ids: np.ndarray) -> int:
        """Notes the ids of some words; the number of the first."""
        first, n, used = self.words, self.words + len(lens), self.used + len(ids)
        self.starts, self.lens = _room(self.starts, first, n), _room(self.lens, first, n)
        self.ids = _room(self.ids, self.used, used)
        self.lens[first:n] = lens
        self.starts[first:n] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : used] = ids
        self.words, self.used = n, used
        return first

    def name(self, first: int, hashes: np.ndarray, starts: np.ndarray, lens: np.ndarray, data: np.ndarray) -> None:
        """Notes the bytes data[start : start + len] of the words from number first on."""
        n, used = first + len(hashes), self.text_used + int(lens.sum())
        self.hashes, self.text_starts, self.text_lens = (_room(x, first, n) for x in (self.hashes, self.text_starts, self.text_lens))
        self.text = _room(self.text, self.text_used, used)
        self.hashes[first:n], self.text_lens[first:n] = hashes, lens
        self.text_starts[first:n] = self.text_used + np.cumsum(lens) - lens
        self.text[self.text_used : used] = data[_spans(starts, lens)]
        self.text_used = used
        if 2 * n > len(self._table):
            self._index((2 * n).bit_length() + 1)
            self._enter(0, n)
        else:
            self._enter(first, n)

    def _index(self, bits: int) -> None:
        self._table, self._shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)

    def _enter(self, first: int, end: int) -> None:
        rest = np.arange(first, end, dtype=np.int32)
        slot = (self.hashes[first:end] >> self._shift).astype(np.int64)
        while len(rest):
            free = self._table[slot] < 0
            self._table[slot[free]] = rest[free]
            later = self._table[slot] != rest
            rest, slot = rest[later], (slot[later] + 1) & (len(self._table) - 1)

    def find(self, hashes: np.ndarray, starts: np.ndarray, lens: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The number of each word data[start : start + len], -1 where it is not noted."""
        out = np.full(len(hashes), -1, np.int64)
        rest, slot, own = np.arange(len(hashes)), (hashes >> self._shift).astype(np.int64), hashes
        while len(rest):
            found = self._table.take(slot)
            there = found >= 0
            same = self.hashes.take(found, mode="clip") == own
            same &= there
            out[rest[same]] = found[same]
            there &= ~same
            rest, own, slot = rest[there], own[there], (slot[there] + 1) & (len(self._table) - 1)
        at = np.flatnonzero(out >= 0)
        unlike = self.text_lens[out[at]] != lens[at]
        out[at[unlike]] = -1
        at = at[~unlike]
        unlike = np.flatnonzero(self.text[_spans(self.text_starts[out[at]], lens[at])] != data[_spans(starts[at], lens[at])])
        out[at[np.searchsorted(np.cumsum(lens[at]), unlike, "right")]] = -1
        return out


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _marked(role: np.ndarray, flags: int) -> np.ndarray:
    """The places of a role with any of the flags (places of truth values are found far quicker than those of numbers)."""
    return np.flatnonzero((role & flags) != 0)


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start .. start + len - 1 of each run, one run after another."""
    ends = np.cumsum(lens, dtype=np.int64)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(len(at))
    return at


def _gathered(ids: np.ndarray, lens: np.ndarray, pieces: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all pieces, how many come before each end), from those of the words, word by word, and each piece's word.

    Arrow copies a piece's bytes at once; the words of a run lie closer together than all noted ones.
    """
    bounds = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=bounds[1:])
    bounds *= ids.itemsize
    if not len(pieces) or not bounds[-1]:
        return ids[:0], np.zeros(len(ends), np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
    found = words.take(pieces)
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1]
    return np.frombuffer(data, ids.dtype)[offsets[0] // ids.itemsize : offsets[-1] // ids.itemsize], offsets[ends] // ids.itemsize


class Encoder:
    """ids of texts by a tokenizer that never joins characters across white space.

    Such a tokenizer gives a text the ids of its space-separated words in turn, so each distinct
    word is encoded once and the ids of a run of texts are gathered from those of its distinct
    words. folds says that it also lower-cases and cuts letters from marks: then a word of Latin
    letters, whatever its case, followed by marks or not, has the ids of its letters and those of
    the marks. The ids are those of encode(text, add_special_tokens=False). Words are noted in
    two generations, the older of which goes when the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self._tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self._code = "H" if self.vocabulary <= 1 << 16 else "I"
        self._noted, self._older = _Noted(self.dtype), _Noted(self.dtype)
        probes = ["Ab", "ÀÉ", *(f"{core}{mark}" for mark in [*MARKS, MARKS, "..", "!?", "%%%"] for core in ("Abc", "ÀÉ"))]
        cores = [w.rstrip(MARKS) for w in probes]
        parts = self._ids([x for w, c in zip(probes, cores) for x in (c.lower(), w[len(c) :])])
        self.folds = all(p == a + b for p, a, b in zip(self._ids(probes), parts[::2], parts[1::2]))
        self._letters = self._for_letters(path) if self.folds else None

    def _for_letters(self, path: str):
        """The same model for texts of lower-case words of letters; None where ids or their borders would differ."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_file(path)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(bare.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        self._last = np.zeros(self.vocabulary, bool)
        self._last[[i for token, i in bare.get_vocab().items() if token.endswith(suffix)]] = True
        words = ["a", "the", "straße", "çàéîõüÿñ", "entierement", "qzjxkvw", "a" * 40]
        found = bare.encode(" ".join(words), add_special_tokens=False).ids
        same = found == [i for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False) for i in e.ids]
        return bare if same and int(self._last[found].sum()) == len(words) else None

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        return [x for i in range(0, len(words), CALL_WORDS) for x in self._ids(words[i : i + CALL_WORDS])]

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case words of letters. Many go as one text: a word's last id, and no other, ends a word."""
        if self._letters is None:
            return self._of_words(words)
        out: list[bytes] = []
        texts = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        for part, e in zip(texts, self._letters.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self._last[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(part):
                out += self._of_words(part)
                continue
            raw, a = ids.tobytes(), 0
            for b in ends.tolist():
                out.append(raw[a:b])
                a = b
        return out

    def _learn(self, missing: pa.Array) -> list[bytes]:
        """The ids of the missing words."""
        if self._letters is None:
            return self._of_words(_listed(missing))
        letters = pc.match_substring_regex(missing, LETTERS).to_numpy(zero_copy_only=False)
        found = [b""] * len(missing)
        for own, encoded in ((letters, self._of_letters), (~letters, self._of_words)):
            at = np.flatnonzero(own)
            for i, ids in zip(at.tolist(), encoded(_listed(missing.take(pa.array(at))))):
                found[i] = ids
        return found

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """(the pieces of all texts that are encoded on their own, how many lie before each text's end).

        A piece is a word between white space. Where the tokenizer folds, a word of Latin letters
        with or without marks after them is two pieces, and its letters come in lower case.
        """
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(KINDS), np.uint8)
        role = np.empty(len(kind), np.uint8)
        if len(kind):
            role[0] = SEPARATOR
            role[1:] = kind[:-1]
            role[offsets[:-1][offsets[:-1] < len(kind)]] = SEPARATOR
            role <<= 3
            role |= kind
        role = np.frombuffer(bytearray(role.tobytes().translate(ROLES)), np.uint8)
        starts = _marked(role, BEGINS)
        if self.folds and len(starts):
            broken = np.searchsorted(starts, _marked(role, BREAKS), "right") - 1
            broken = broken[np.diff(broken, prepend=-1) > 0]
            ends = np.append(starts, len(role))[broken + 1]
            role[_spans(starts[broken], ends - starts[broken])] &= BEGINS
            rises = _marked(role, RISES)
            if len(rises):
                text = data.copy()
                text[rises] += 32
                raw = text.tobytes()
            starts = _marked(role, BEGINS | TURNS)
        white = np.zeros(len(kind) + 1, np.int64 if len(kind) >> 31 else np.int32)
        np.cumsum(kind == SEPARATOR, dtype=white.dtype, out=white[1:])
        bounds = np.append(starts - white[starts], len(kind) - int(white[-1])).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw.translate(None, WHITE)))
        return pieces, np.searchsorted(starts, offsets[1:])

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column, the end of each text's ids); null is empty."""
        pieces, text_ends = self._pieces(*text_buffers(column))
        named = pieces.dictionary_encode()
        distinct = named.dictionary
        if self._noted.words > KEPT_WORDS:
            self._older, self._noted = self._noted, _Noted(self.dtype)
        noted = self._noted
        data, bounds = text_buffers(distinct)
        starts, sizes = bounds[:-1], np.diff(bounds)
        hashes = hashes_of(data, starts)
        number = noted.find(hashes, starts, sizes, data)
        missing = np.flatnonzero(number < 0)
        short, long = missing[sizes[missing] <= KEPT_LENGTH], missing[sizes[missing] > KEPT_LENGTH]
        number[short] = self._note(distinct.take(pa.array(short)), hashes[short], starts[short], sizes[short], data)
        mark = noted.words, noted.used
        if len(long):
            number[long] = self._add(self._learn(distinct.take(pa.array(long))))
        lens = noted.lens[number]
        ids = noted.ids[_spans(noted.starts[number], lens)]
        noted.words, noted.used = mark
        return _gathered(ids, lens, named.indices, text_ends)

    def _add(self, found: list[bytes]) -> np.ndarray:
        """The numbers of words whose ids were found."""
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return self._noted.add(lens, np.frombuffer(b"".join(found), self.dtype)) + np.arange(len(found))

    def _note(self, words: pa.Array, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The numbers of words that were not noted, from the older generation or from the tokenizer."""
        noted, older = self._noted, self._older
        old = older.find(hashes, starts, sizes, data)
        again, fresh = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        lens = older.lens[old[again]]
        first = noted.add(lens, older.ids[_spans(older.starts[old[again]], lens.astype(np.int64))])
        self._add(self._learn(words.take(pa.array(fresh))))
        order = np.concatenate([again, fresh])
        noted.name(first, hashes[order], starts[order], sizes[order], data)
        out = np.empty(len(words), np.int64)
        out[order] = first + np.arange(len(order))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as little-endian integers of dtype; null is empty."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[a * width : b * width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder of a file, kept from task to task with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_runs(coder: Encoder, column: pa.Array, most_bytes: int = 8 << 20):
    """(first, last + 1, ids, end of each text's ids) of runs of a column that hold about most_bytes together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends = np.cumsum(sizes)
    i = 0
    while i < len(column):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield i, j, *coder.encode_flat(column.slice(i, j - i))
        i = j
