"""Operators against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from haplograph.llm import decontaminate, order_minhash, packing, rangecoder, sharding, superminhash, token_counts, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def linked(rows, k, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x = len(sets[a] & sets[b])
            if a < b and x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("cluster", [4096, 8])
def test_near_duplicates(docs, rows, k, cluster):
    found = superminhash.near_duplicates(docs, words=k, cluster=cluster).collect()
    want = linked(rows, k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_edges(spark, clashing, empty, rows):
    assert superminhash.near_duplicates(empty).count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(clashing, words=2).collect()} == linked(rows, 2)
    odd = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (2, "a b c d")], "doc_id long, text string")
    found = sorted(superminhash.near_duplicates(odd, words=2).collect(), key=str)
    assert [r.kept for r in found if r.doc_id is None] == [True]
    assert {(r.doc_id, r.component_id) for r in found} == {(None, None), (1, 1), (2, 1), (2, 2)}
    left = superminhash.drop_duplicates(clashing, words=2)
    assert left.columns == clashing.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in linked(rows, 2).items() if i == c}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 100, 100))
    x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
    sig = superminhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 256)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.1
    one = superminhash.signatures(x[:1], np.array([0, 1]), 64)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(64))


def test_encoder_equals_library(rows, plain):
    coder = tokens.Encoder(tokens.default_path())
    texts = [r[1] for r in rows] + ["Ab,cd.", "É.É, İ Σς don't", "%%% a%%% a'%% ﬁ½ 中文,", "Å Å", "q" * 100 + " " + "q" * 100]
    for _ in range(2):
        assert [np.frombuffer(e, coder.dtype).tolist() for e in coder.encode(texts)] == [plain(t) for t in texts]


def test_encoder_keeps_words_of_equal_hashes_apart(rows, plain, monkeypatch):
    """A noted word is known by its bytes; hashes only say where to look, also from one generation of words to the next."""
    whole = tokens.hashes_of
    monkeypatch.setattr(tokens, "hashes_of", lambda data, starts: whole(data, starts) & np.uint64(7 << 61))
    monkeypatch.setattr(tokens, "KEPT_WORDS", 40)
    coder = tokens.Encoder(tokens.default_path())
    texts = [*(r[1] for r in rows[:40]), "ab ba Ab, é e", "q" * 100, None, ""]
    for first in range(0, 2 * len(texts), 3):
        part = (texts + texts)[first : first + 3]
        assert [np.frombuffer(e, coder.dtype).tolist() for e in coder.encode(part)] == [plain(t) for t in part]


def test_ids_are_gathered_by_words():
    """Pieces get their words' ids, in their order, whatever the width of ids and also where words or texts have none."""
    rng = np.random.default_rng(5)
    for kind, n_words, n_pieces in (("<u2", 50, 400), ("<u4", 7, 60), ("<u2", 3, 0), ("<u4", 0, 0)):
        lens = rng.integers(0, 5, n_words)
        ids = rng.integers(0, 60_000, lens.sum()).astype(kind)
        words = np.split(ids, np.cumsum(lens)[:-1]) if n_words else []
        pieces = rng.integers(0, max(n_words, 1), n_pieces)
        ends = np.append(np.sort(rng.integers(0, n_pieces + 1, 9)), n_pieces)
        flat, at = tokens._gathered(ids, lens, pa.array(pieces, pa.int32()), ends)
        assert flat.dtype == ids.dtype and flat.tolist() == [i for p in pieces for i in words[p].tolist()]
        assert at.tolist() == [sum(len(words[p]) for p in pieces[:e]) for e in ends]
    none = tokens._gathered(ids[:0], np.zeros(2, np.int64), pa.array([1, 0], pa.int32()), np.array([1, 2]))
    assert len(none[0]) == 0 and none[1].tolist() == [0, 0]


def test_words_of_letters_are_told_apart(plain):
    """Arrow finds the words of letters; null, marks, digits, other letters and line ends go the other way, with the same ids."""
    coder = tokens.Encoder(tokens.default_path())
    words = ["abc", "straße", "çàé", "a1", "Ab", "÷", "abc\r", "\n", "ÿ", "σς", "x'y", "abcd"]
    found = coder._learn(pa.array(words, pa.large_string()))
    assert [np.frombuffer(x, coder.dtype).tolist() for x in found] == [plain(w) for w in words]


def test_noted_words_are_found_again():
    words = [f"w{i}" for i in range(20_000)] + ["a", "ab", "b"]
    data, starts = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words[:-1])])
    lens, hashes = np.array([len(w) for w in words]), tokens.hashes_of(data, starts)
    noted = tokens._Noted(np.dtype("<u2"))
    assert (noted.find(hashes, starts, lens, data) == -1).all()
    for part in (slice(0, 5), slice(5, 12_000), slice(12_000, 20_000)):
        noted.name(noted.add(np.ones(len(words[part]), np.int64), np.zeros(len(words[part]), np.uint16)), hashes[part], starts[part], lens[part], data)
    assert noted.find(hashes, starts, lens, data).tolist() == [*range(20_000), -1, -1, -1]
    # equal hashes, other bytes
    assert noted.find(hashes[:3], starts[3:6], lens[3:6], data).tolist() == [-1] * 3


def test_packing(docs, rows, plain, empty, clashing):
    want = {i: plain(t) + [1] for i, t, *_ in rows}
    for source in (docs, clashing):
        pieces = packing.pack_documents(source, packing.Limits(tokens=256, segments=8, loss=256)).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
            assert p.doc_tokens == len(want[p.doc_id])
            by_doc[p.doc_id].append((p.start, p.length))
            by_sequence[p.sequence_id].append((p.offset, p.length))
        for i, ids in want.items():
            at = 0
            for start, length in sorted(by_doc[i]):
                assert start == at and length > 0
                at += length
            assert at == len(ids)
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256 and len(parts) <= 8
    assert packing.pack_documents(empty).count() == 0


def test_undivided_examples(spark):
    rows = [(i, 10 + i * 7 % 90, i * 5 % 40) for i in range(300)] + [(1000, 500, 0), (1001, None, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").coalesce(1), packing.Limits(tokens=128, segments=4, loss=64)).collect()
    assert len(out) == len(rows)
    loss = {i: min(l or 0, t or 0) for i, t, l in rows}
    groups = defaultdict(list)
    for r in out:
        groups[r.sequence_id].append(r)
    for g in groups.values():
        if len(g) > 1:
            assert sum(r.length for r in g) <= 128 and len(g) <= 4 and sum(loss[r.example_id] for r in g) <= 64


def test_range_coder_round_trip(docs, rows, plain, empty, clashing):
    want, at = {}, 0
    for i, t, *_ in sorted(rows):
        ids = plain(t) + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for source in (docs, clashing):
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rangecoder.round_trip(source, block_ids=700).collect()} == want
    assert rangecoder.round_trip(empty).count() == 0


def test_range_coder_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700, 60_000):
        for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 49408, np.full(n, 7), np.tile(np.arange(50), n // 50 + 1)[:n]):
            block = rangecoder.write_block([3, None], np.array([n, 0]), ids)
            names, lengths, back = rangecoder.read_block(block)
            assert names == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    assert len(rangecoder.write_block([1], np.array([50_000]), np.tile(np.arange(50), 1000))) < 20_000
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rangecoder.read_block(bytes(broken))


def test_range_coder_turns_grids():
    for shape in ((1, 1), (64, 64), (3, 200), (130, 65)):
        grid = np.arange(shape[0] * shape[1], dtype=np.int32).reshape(shape)
        turned = rangecoder._turned(grid)
        assert (turned == grid.T).all() and turned.flags.c_contiguous


def test_range_coder_search():
    """Sums in chunks are those of whole columns, and a search finds every symbol between its bounds."""
    rng = np.random.default_rng(4)
    for size in (2, 8, 128):
        model = rangecoder.Model(size, 300)
        for _ in range(70):
            model.predict()
            symbol = rng.zipf(1.5, 300) % size
            start, width = (x.astype(np.int64) for x in model.interval(symbol))
            for target in (start, start + width // 2, start + width - 1):
                assert (model.find(target) == symbol).all()
            model.update(symbol)
            if model.step in (33, 65):
                assert (model.total1 == model.count1.sum(axis=0)).all() and model.total1.any()
                share = np.cumsum(model.count1, axis=0).astype(np.float32) * (rangecoder.PART / np.maximum(model.total1, 1)).astype(np.float32)
                assert (model.cum1[1:size] == share[:-1].astype(np.int32)).all() and (model.cum1[size] == rangecoder.PART).all()


def test_range_coder_takes_known_symbols_in_groups():
    """Intervals of several steps at once are those of one step after another, and leave the same model."""
    rng = np.random.default_rng(6)
    one, many = rangecoder.Model(64, 200), rangecoder.Model(64, 200)
    symbols = np.minimum(rng.zipf(1.4, (150, 200)), 63)
    step = 0
    while step < len(symbols):
        end = next(k for k in range(step + 1, step + 8) if k == step + 7 or k == len(symbols) or rangecoder._looks(k))
        start, width = many.intervals(symbols[step:end])
        for k in range(step, end):
            one.predict()
            want = one.interval(symbols[k])
            assert (start[k - step] == want[0]).all() and (width[k - step] == want[1]).all()
            one.update(symbols[k])
        step = end
        assert (one.notes == many.notes).all() and (one.gate == many.gate).all() and (one.last == many.last).all() and (one.before == many.before).all()


def test_range_coder_mixes_orders():
    """Ids that depend on the one before, and on the two before, cost far less than their own frequencies tell."""
    rng = np.random.default_rng(2)
    n, width = 200_000, 64
    ids = np.zeros(n, np.int64)
    noise, other = rng.integers(0, width, n), rng.random(n) < 0.1
    for i in range(2, n):
        ids[i] = noise[i] if other[i] else (3 * ids[i - 1] + ids[i - 2] + 1) % width
    share = np.bincount(ids, minlength=width) / n
    entropy = -(share * np.log2(share)).sum()
    block = rangecoder.write_block([1], np.array([n]), ids + 1000)
    assert (rangecoder.read_block(block)[2] == ids + 1000).all()
    assert 8 * len(block) / n < 0.5 * entropy


def test_null_and_repeated_ids_in_files(spark):
    d = spark.createDataFrame([(5, "a"), (None, "b c"), (5, "a"), (-1, None)], "doc_id long, text string")
    out = rangecoder.round_trip(d).collect()
    assert sorted((r.start, r.doc_id or 0) for r in out)[0][1] == 0 and sum(r.n_tokens for r in out) == 1 + 2 + 2 + 3
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [-1, 5, 5]


def test_token_counts(docs, rows, plain, empty):
    lengths = sorted(len(plain(t)) for _, t, *_ in rows)
    h = token_counts.length_histogram(docs)
    assert h.total_tokens == sum(lengths) and h.total_docs == len(lengths)
    for limit in (0, 1, 7, 100, 10**6):
        assert h.truncated_total(limit) == sum(min(x, limit) for x in lengths)
        assert h.longer(limit) == sum(x > limit for x in lengths)
    for q in (0.01, 0.5, 0.9, 1.0):
        assert h.quantile(q) == lengths[max(1, int(np.ceil(q * len(lengths)))) - 1]
    table = token_counts.token_counts(docs).collect()
    assert [(r.n_tokens, r.n_docs) for r in table] == sorted((x, lengths.count(x)) for x in set(lengths))
    assert token_counts.token_counts(empty).count() == 0


def test_sharding(docs, rows, empty, clashing, spark):
    for source in (docs, clashing):
        out = sharding.shard_documents(source, 7).collect()
        text = {i: t or "" for i, t, *_ in rows}
        where, slots, load = {}, defaultdict(list), defaultdict(int)
        for r in out:
            t = text[r.doc_id].encode()
            assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
            assert where.setdefault(text[r.doc_id], r.shard) == r.shard
            slots[r.shard].append(r.slot)
            load[r.shard] += r.size
        assert len(out) == len(rows) and set(load) <= set(range(7))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        groups = defaultdict(int)
        for t in text.values():
            groups[t] += len(t.encode()) + 8
        assert max(load.values()) <= sum(load.values()) / 7 + max(groups.values())
    assert sharding.shard_documents(empty).count() == 0


def test_hot_atoms_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPLIT_ROWS", 10)
    monkeypatch.setattr(sharding, "SPLITS", 4)
    d = spark.createDataFrame([(i if i % 9 else None, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    out = sharding.shard_documents(d, 5).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == 300 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_minimax_cuts():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(0, 30, rng.integers(1, 9))
        parts = int(rng.integers(1, 5))
        got = sharding.minimax_cuts(sizes, parts)
        assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < parts
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)))) for c in _cuts(len(sizes), parts))
        assert max(sizes[got == p].sum() for p in range(parts)) == best


def _cuts(n, parts):
    from itertools import combinations_with_replacement

    return combinations_with_replacement(range(n + 1), parts - 1)


def contaminated(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for at in range(max(0, len(w) - 13) + 1 if w else 0):
            windows[tuple(w[at : at + 13])].add(i)
    out = {}
    for i, t, *_ in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                own = windows.get(tuple(w[at : at + size]))
                if own:
                    hit |= set(range(at, at + size))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_contamination(spark, rows, docs, clashing, empty, block_bytes):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[3].split()[2:20])), (2, texts[70]), (10, texts[60]), (10, texts[60]), (3, ""), (4, None), (5, "two words"), (6, " ".join(texts[88].split()[50:90])), (7, "Alpha1, beta2!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(rows, items)
    for source in (docs, clashing):
        got = decontaminate.contamination(source, bench, block_bytes=block_bytes).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    kept = decontaminate.remove_contaminated(clashing, bench, block_bytes=block_bytes)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[-1]}
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_fingerprints(spark, docs, rows, clashing, empty):
    text = {i: t or "" for i, t, *_ in rows}
    order = sorted(text, reverse=True)
    for source in (docs, clashing):
        out = {r.doc_id: r for r in order_minhash.edited_fingerprints(source).collect()}
        for k, i in enumerate(order):
            t, nxt = text[i], text[order[(k + 1) % len(order)]]
            n = len(t)
            assert out[i].n_chars == n
            assert out[i].edited_sha256 == hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()
            assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    by_text = defaultdict(set)
    for i, r in out.items():
        by_text[text[i]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert out[62].near_next == 1.0  # its next is an exact copy
    assert order_minhash.edited_fingerprints(empty).count() == 0
    lone = order_minhash.edited_fingerprints(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert lone[0].near_next == 1.0 and lone[0].edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()
    odd = spark.createDataFrame([(None, "n"), (3, "x y"), (3, "x y"), (-5, None), (10**15, "far")], "doc_id long, text string")
    assert order_minhash.edited_fingerprints(odd).count() == 5


def test_fingerprint_bins(spark):
    """The SQL signature against the same steps in Python, and its sense of order and repeats."""
    a = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    b = " ".join(reversed(a.split()))
    rows = [(0, a), (1, b), (2, a + " tail"), (3, "one two three"), (4, "one two three one two three")]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", order_minhash.signature("text").alias("sig"))
    sig = {r.doc_id: r.sig for r in d.collect()}
    for s in sig.values():
        bins = [x >> 58 & 63 for x in s]
        assert len(set(bins)) == len(bins)
    same = lambda x, y: len(set(sig[x]) & set(sig[y]))
    assert same(0, 2) > 0.8 * len(sig[0]) and same(0, 1) < 0.2 * len(sig[0])
    assert len(sig[3]) == 1 and len(sig[4]) > 1


def test_packing_null_and_repeated_ids(spark, plain):
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), (7, "c"), (None, None)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(((-1 if i is None else i), len(plain(t)) + 1) for i, t in rows)
    assert sorted(((-1 if p.doc_id is None else p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n for _, n in want)


def test_token_counts_with_clashing_columns(docs, clashing, plain, rows):
    want = sorted(len(plain(t)) for _, t, *_ in rows)
    for source in (docs, clashing):
        table = token_counts.token_counts(source).collect()
        assert sorted(x for r in table for x in [r.n_tokens] * r.n_docs) == want
