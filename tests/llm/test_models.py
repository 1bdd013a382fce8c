"""Extraction, classification, language-model scores and the pipeline."""

import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haplograph.llm import common, context_mixing, html_extract, toxicity
from haplograph.llm.common import ALNUM, SPACED, Words, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. Accept them all now, please.</div><div class="ad">Buy this fine thing today.</div>
<article><h1>A title &amp; more</h1><p><b>First paragraph, <i>with</i> markup<br>and a break. It is long enough to be read.<p>Second&nbsp;paragraph &lt;here&gt;
  over lines, with an <a href="/x">inline link</a> in it.</p><form><label>Mail</label><input name=m></form><ul><li>A list item of the text.</li></ul>
<aside>Related stories stand here.</aside><section class="comments"><p>Great article, says a reader. I liked every word of it.</p></section></article>
<div id="sidebar"><p>Popular posts of the week, many of them.</p></div><footer>&copy; Site, all rights reserved.</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A title & more\n\nFirst paragraph, with markup and a break. It is long enough to be read.\n\nSecond paragraph <here> over lines, with an inline link in it.\n\nA list item of the text."
    for odd in (None, "", "<", "<p", "<<<>>>", "<!--", "<script>", "</p></div>", "<a href='x", "plain words only", "<p>" * 3000):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("<html><body><nav>a</nav></body></html>") == ""
    plain = "<body><div><p>" + "Some long sentence of real text, well written. " * 5 + "</p><p>" + "Another one of the same kind follows here. " * 5 + "</p></div><div class='menu'><a>x</a> <a>y</a></div></body>"
    assert html_extract.main_text(plain).count("\n\n") == 1 and "x y" not in html_extract.main_text(plain)
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long page.</p>" for i in range(5000)) + "</article>"
    assert html_extract.main_text(long).count("\n\n") == 4999


SECTION = "<body><article><h1>Title here</h1><section %s><p>Some long prose stands here, as it does in articles of this kind. It goes on.</p></section></article></body>"


@pytest.mark.parametrize(("mark", "kept"), [('class="commentary"', 1), ('class="navy-theme"', 1), ('class="sharing-economy"', 1), ('id="related-work"', 1), ('class="comments"', 0), ('class="commentList"', 0), ('id="ad-slot"', 0), ("class=newsletter", 0)])
def test_names_are_whole_words(mark, kept):
    assert html_extract.main_text(SECTION % mark).count("prose") == kept


def test_nothing_else_is_dropped():
    page = SECTION % "" + "<article><p>See <math>x<mi>y</mi></math>, <object>a part</object> and <button>Copy</button> of it, please.</p></article>"
    assert "See xy, a part and Copy of it, please." in html_extract.main_text(page)
    linked, _ = html_extract.blocks_of("<div><a href=x><div>all of this is a link</div></a></div><div>and this is not</div>")
    assert [(b.text, b.linked) for b in linked] == [("all of this is a link", 21), ("and this is not", 0)]
    linked, _ = html_extract.blocks_of("<div><a href=x>left open</div><div>not linked</div>")
    assert [b.linked for b in linked] == [9, 0]


class PlainArticle(HTMLParser):
    """The blocks of article elements by the library's parser, for pages that mark them and nothing within."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_extraction_equals_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        plain = PlainArticle()
        plain.feed(r.html or "")
        assert got[r.page_id] == "\n\n".join(" ".join(b.split()) for b in plain.blocks if b.split())


def test_pages_without_article_are_labelled_by_the_flow(spark, monkeypatch):
    """Where no element marks the article, most blocks are settled by the flow, at the least cost of all labellings."""
    flowing, solve = [0], html_extract._dinic
    monkeypatch.setattr(html_extract, "_dinic", lambda nodes, *rest: flowing.__setitem__(0, flowing[0] + len(nodes)) or solve(nodes, *rest))
    blocks = lost = tried = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        want = html_extract.main_text(r.html).split("\n\n")
        own, parents = html_extract.blocks_of((r.html or "").replace("article>", "div>"))
        scores, edges = [b.score for b in own], html_extract.ties(own, parents)
        side = html_extract.minimum_cut(scores, edges)
        blocks += len(own)
        lost += len(set(want) ^ {b.text for b, k in zip(own, side) if k})
        if len(own) <= 12:
            cost = lambda side: sum(max(0, -s) if k else max(0, s) for s, k in zip(scores, side)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
            assert cost(side) == pytest.approx(min(cost(s) for s in product([False, True], repeat=len(own))))
            tried += 1
    assert tried and flowing[0] > 0.3 * blocks and lost < 0.02 * blocks


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 12))]

        def cost(side):
            return sum(max(0, -s) if k else max(0, s) for s, k in zip(scores, side)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(html_extract.minimum_cut(scores, edges)) == pytest.approx(min(cost(s) for s in product([False, True], repeat=n)))


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x", 5, "a"), (1, "u", PAGE, "x", 5, "a"), (2, None, None, "y", None, "b"), (None, "v", "", None, 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, element string")
    out = html_extract.extract(pages).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert sorted(r.n_chars for r in out)[:2] == [0, 0]
    assert html_extract.extract(pages.limit(0)).count() == 0


def _toxic_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = [rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randint(0, 200)) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), "idiot" if lang == "en" else "dumm" + rng.choice(["kopf", "heit", "er", "es"]))
        rows.append((i, " ".join(text), lang, None, None))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = _toxic_rows(900, 5)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    fold = toxicity.held_out_fold(F.col("doc_id"))
    return rows, dict(labels), d, y, toxicity.fit(d, y, held_out=fold)


def test_toxicity_held_out(toxic):
    rows, labels, d, _, net = toxic
    out = toxicity.score(d, net).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == len(rows) and len(held) > 100
    assert sum((r.score >= 0.3) == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_toxicity_rows(spark, toxic, empty, clashing):
    *_, d, y, net = toxic
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot " * 3000)], "doc_id long, text string")
    scores = {(r.doc_id, r.score) for r in toxicity.score(odd, net).collect()}
    assert len(scores) == 3 and all(0 <= s <= 1 for _, s in scores)
    assert toxicity.score(empty, net).count() == 0
    kept = toxicity.reject_toxic(clashing, net)
    assert kept.columns == clashing.columns and kept.count() > 80
    blank = toxicity.fit(empty, y)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, blank).collect())


def test_toxicity_thresholds_at_true_shares(spark):
    """A balanced sample would reject the doubtful word: four fifths of its rows are clean, but half the sample is toxic."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        kind = "vile" if i < 150 else "doubtful" if i < 900 else "plain"
        text = [f"w{rng.randint(0, 60)}" for _ in range(20)]
        rows.append((i, " ".join([*text[:10], kind, *text[10:]]), rng.choice(["en", "de"])))
        labels.append((i, int(i < 300)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(d, y, rows=300)
    kept = {r.doc_id for r in toxicity.reject_toxic(d, net).collect()}
    assert len(kept & set(range(300, 900))) > 540 and len(kept & set(range(900, 3000))) > 2050
    assert len(kept & set(range(150))) < 15


def test_toxicity_sample_is_whole(spark, monkeypatch):
    """All of 3000 rows of each label train the network or are kept from it for the thresholds."""
    taken = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.append((len(texts), labels.sum())) or plain(texts, labels))
    d = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 2 = 1, concat('vile ', id % 40), concat('fine ', id % 50)) AS text", "'en' AS lang")
    toxicity.fit(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    assert taken == [(6000, 3000)]


def test_words_and_shingles():
    texts = ["Ab  cd\tEF\x0bgh", "", "é É one-two", "x", "a b a b a b"]
    column = pa.array(texts)
    from haplograph.llm.common import text_buffers

    data, offsets = text_buffers(column)
    for mask, pattern in ((SPACED, "[^\x20\x09-\x0d]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = Words(data, offsets, mask)
        want = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        assert w.counts().tolist() == [len(x) for x in want]
        flat = [x for own in want for x in own]
        assert w.lengths().tolist() == [len(x.encode()) for x in flat]
        assert len(set(w.hashes.tolist())) == len(set(flat))
        assert len(set(w.prefixes(1, w.lengths()).tolist())) == len({x.encode()[:1] for x in flat})
    w = Words(data, offsets, SPACED)
    sets, first = shingles(w, 2)
    assert np.diff(first).tolist() == [3, 0, 2, 1, 2]


@pytest.fixture(scope="module")
def lm_rows():
    rng = random.Random(6)
    rows = []
    for i in range(260):
        lang = i % 2
        words = [rng.choice(["der", "die", "und"] if lang else ["the", "of", "and"]) if rng.random() < 0.5 else rng.choice("bcdfg") + rng.choice("äöü" if lang else "aei") + rng.choice("klmn") for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words)))
    return rows + [(260, None), (261, ""), (262, " \n "), (263, "Z" * 3000), (264, " ".join(f"w{k}" for k in range(3000))), (None, "the of"), (3, "the of"), (3, "the of")]


def test_lm_scores(spark, lm_rows, empty):
    d = spark.createDataFrame(lm_rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("row", "fold", "rare", "score", "base", "word", "n")})
    out = context_mixing.score(d).collect()
    assert len(out) == len(lm_rows)
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]
    counts = Counter(w for i, t in lm_rows if fold(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in lm_rows:
        own = tokens(t)
        want[i].append((fold(i) == 0, len(own), sum(w in counts for w in own), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    for r in out:
        assert r.train_tokens == n
        assert any((r.held_out, r.n_tokens, r.n_known) == w[:3] and r.base_score == pytest.approx(w[3], rel=1e-9) for w in want[r.doc_id])
        assert r.score < 0
    held = [r for r in out if r.held_out and r.n_tokens < 100 and r.doc_id]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert context_mixing.score(empty).count() == 0


MASK = (1 << 64) - 1


def plain_mix(h):
    h &= MASK
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def plain_events(model, text):
    """For each token, its symbols as (kind, [(bit, states of the four predictors)]), and for rare words the hash; one by one."""
    v, lm = model.vocabulary, context_mixing
    top = lambda h: plain_mix(h) >> 32
    tokens, past = [], []  # past: (hash, main, ending) of earlier tokens
    for w in [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]:
        raw = b"" if w is None else w.encode()
        h = lm._END if w is None else int(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED).hashes[0])
        rank = -1 if w is None else int(v.ranks(np.array([h], np.uint64))[0])
        if w is None:
            main, ending, code, length, path = v.end, -1, 0, 0, 0
        elif rank >= 0:
            main, ending, code, length, path = (int(x[rank]) for x in (v.main, v.ending, v.word, v.word_length, v.word_path))
        else:
            main, ending, code, length, path = lm.TOP + int(v._first[int.from_bytes(raw[:2].ljust(2, b"\0"), "big")]), lm.ENDINGS, 0, 0, 0
        before = [*reversed(past), (int(lm._START[0]), v.end, -1), (int(lm._START[0]), v.end, -1)]
        (h1, m1, s1), (h2, m2, _) = before[:2]
        kind1 = m1 * 64 + s1 + 1
        both, classes = top(h1 + h2 * 0x94D049BB133111EB), top(kind1 * 512 + m2)
        symbols = []

        def add(kind, contexts, bits, nodes, paths=None):
            bits, states = list(bits), []
            for i, node in enumerate(nodes):
                own = [((c + node) * int(lm.ODD[k]) & 0xFFFFFFFF) >> (32 - model.bits) for k, c in enumerate(contexts)]
                states.append([int(v.paths[paths + i] if paths is not None and k == 0 else model.states[k][own[k]]) for k in range(4)])
            symbols.append((kind, list(zip(bits, states))))

        def huffman(kind, symbol, contexts):
            c = v.codes[kind]
            n = int(c.lengths[symbol])
            add(kind, contexts, map(bool, c.bits[symbol, :n]), map(int, c.nodes[symbol, :n]))

        huffman(lm.MAIN, main, [0, h1 >> 32, both, classes])
        if ending >= 0:
            huffman(lm.ENDING, ending, [(main * 0xBF58476D1CE4E5B9 & MASK) >> 32, top(main + h1), top(main + kind1 * 0x94D049BB133111EB), top(main * 1024 + m1 + 3)])
            group = (main - lm.TOP) * lm.ENDINGS + ending
            bits = [bool(code >> (length - 1 - d) & 1) for d in range(length)]
            nodes = [((1 << d | code >> (length - d)) + (group << 34)) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32 for d in range(length)]
            add(lm.WORD, [0, h1 >> 32, top(kind1 + 5), classes], bits, nodes, path)
        if w is not None and rank < 0:
            for i, byte in enumerate([*raw, 256]):
                b = [raw[i - k] if i >= k else 257 for k in (1, 2, 3, 4)]
                two = ((b[0] + 1) * 512 + b[1]) * 1024 + (main if i < 2 else 0)
                three = two * 512 + b[2]
                huffman(lm.BYTE, byte, [top(two), top(three + 1), top(three * 512 + b[3] + 2), top((two * 512 + m1) * 4 + 3)])
        past.append((h, main, ending) if w is None or rank >= 0 else (h, v.end + 1, -1))
        tokens.append((symbols, h if w is not None and rank < 0 else None, main - lm.TOP))
    return tokens


def plain_score(model, counts, text):
    """log10 probability, bit by bit, with weights of the document's own that change after each block of tokens."""
    lm, total = context_mixing, 0.0
    weights = [list(map(float, w)) for w in model.weights]
    tokens = plain_events(model, text)
    new, known, prior = 0, 0, lm.NEW_WEIGHT
    for start in range(0, len(tokens), lm.BLOCK):
        moves = defaultdict(list)
        for symbols, h, group in tokens[start : start + lm.BLOCK]:
            spelled = 0.0
            for kind, bits in symbols:
                for bit, states in bits:
                    gate = kind * lm.KIND_GATES + (states[1] & 3) * 4 + (states[2] & 3)
                    x = [((s >> 2) - 32) / lm.LOGIT_STEPS * (1 if bit else -1) for s in states]
                    z = min(max(sum(a * b for a, b in zip(x, weights[gate])), -14), 14)
                    p = 1 / (1 + math.exp(-z))
                    moves[gate].append([(1 - p) * lm.RATE * a for a in x])
                    if kind == lm.BYTE:
                        spelled += math.log10(p)
                    else:
                        total += math.log10(p)
            if h is not None:
                n = counts.get(h)
                share = (new + prior * model.vocabulary.new) / (new + known + prior)
                total += math.log10(1 - share) + math.log10(n) + model.vocabulary.known[group] if n else math.log10(share) + spelled
                new, known = new + (not n), known + bool(n)
        for gate, rows in moves.items():
            for k in range(4):
                weights[gate][k] += sum(r[k] for r in rows) / math.sqrt(len(rows))
    return total


def test_lm_score_equals_plain_version(spark, lm_rows):
    d = spark.createDataFrame(lm_rows, "doc_id long, text string").coalesce(2)
    remainder = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10, 0)")
    model, counts = context_mixing.learn(d, remainder)
    by_hash = {r.word & MASK: r.n for r in counts.collect()}
    assert min(by_hash.values()) == 1
    want = {i: plain_score(model, by_hash, t) for i, t in lm_rows if i not in (None, 3)}
    for r in context_mixing.score(d).collect():
        if r.doc_id in want:
            assert r.score == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-3)
            assert r.n_bytes == len((dict(lm_rows)[r.doc_id] or "").encode())
            assert r.bits_per_byte == (pytest.approx(-r.score / math.log10(2) / r.n_bytes) if r.n_bytes else None)


def test_lm_learns_from_every_training_row(spark):
    """Predictors count the symbols of all training rows, remainder 9 included."""
    texts = {i: f"the of q{i}x" for i in range(400)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    model, _ = context_mixing.learn(d, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10"))
    training = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    data = np.frombuffer("".join(training).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, training)])
    want = np.zeros((4, 2 << model.bits), np.int64)
    for own in context_mixing.tokens_of(data, offsets, model.vocabulary).symbols:
        _, bit, slots = own.events(model.bits)
        for k in range(own.kind == context_mixing.WORD, 4):
            np.add.at(want[k], 2 * slots[k] + bit, 1)
    for k in range(4):
        assert (model.states[k] == context_mixing.states_of(want[k])).all()


def test_lm_counts_alike_in_any_portions(monkeypatch):
    """Bits counted in sorted portions of any size give the same tables; an unpickled model's tables have memory of their own."""
    lm = context_mixing
    texts = [f"the cat {i} of w{i % 7} the" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counted, letters = lm._count_batches(iter([batch]))
    word, n, affix = (np.asarray(counted.column(i)) for i in range(3))
    spelled = np.asarray(letters.column(1))
    distinct = {w for t in texts for w in t.split()}
    assert spelled[:256].tolist() == np.bincount(list("".join(distinct).encode()), minlength=256).tolist() and spelled[256] == len(distinct)
    vocabulary = lm.Vocabulary(word.view(np.uint64)[n > 1], n[n > 1], affix[n > 1].astype(np.uint32))
    vocabulary.code(np.zeros(lm.PREFIXES + lm.OTHER, np.int64), 1, 1, 60, spelled)

    class shared:  # noqa: N801
        value = vocabulary

    found = []
    for most in (lm.SORTED_BITS, 50):
        monkeypatch.setattr(lm, "SORTED_BITS", most)
        found.append({r.column(0)[0].as_py(): lm._chunk_counts(r.column(1)[0]).tolist() for r in lm._learn_batches(shared, 16)(iter([batch, batch]))})
    assert found[0] == found[1] and max(map(max, found[0].values())) > 255
    model = lm.Model(vocabulary, 16, np.zeros((lm.K, 1 << 16), np.uint8), np.zeros((lm.GATES, lm.K)), 1, 1, 1)
    again = pickle.loads(pickle.dumps(model))
    assert again.states.flags.owndata and again.vocabulary._table.flags.owndata
    assert (again.vocabulary.hashes == vocabulary.hashes).all() and again.unit == model.unit


def test_lm_counts_travel_as_planes():
    counts = np.zeros(context_mixing.CHUNK, np.uint32)
    for top in (1, 255, 256, 1 << 17, (1 << 32) - 1):
        counts[top % 1000] = top
        assert (context_mixing._chunk_counts(context_mixing._chunk_row(3, counts).column(1)[0]) == counts).all()


def test_lm_last_blocks_refine_nothing():
    """Documents that end with a block, put last in it, are scored as if all documents were refined."""
    lm, docs = context_mixing, 12
    rng = np.random.default_rng(5)
    cells = [np.sort(rng.choice(d, n)) * lm.KIND_GATES + rng.integers(0, lm.KIND_GATES, n) for d, n in ((range(0, docs, 2), 300), (range(1, docs, 2), 200), (range(0, docs, 2), 150))]
    cell = np.concatenate(cells)
    x = [rng.normal(size=len(cell)).astype(np.float32) for _ in range(lm.K)]
    weights = rng.normal(size=(lm.K, docs * lm.KIND_GATES)).astype(np.float32)
    out = np.zeros((2, docs))
    lm._mixed_online(x, cell, None, weights.copy(), np.array([0, 500, 650]), out[0], np.array([300, 500]))
    lm._mixed_online(x, cell, None, weights.copy(), np.array([0, 500, 650]), out[1], np.array([500, 650]))
    assert out.all() and np.allclose(out[0], out[1], rtol=1e-6)


def test_lm_codes_are_prefix_free():
    code = context_mixing.Code.of(1, np.array([5, 1, 1, 0, 40, 3]))
    paths = ["".join("01"[int(b)] for b in code.bits[i, : code.lengths[i]]) for i in range(6)]
    assert all(not a.startswith(b) for a in paths for b in paths if a is not b)
    assert sum(2.0 ** -len(p) for p in paths) == pytest.approx(1.0)
    rng = np.random.default_rng(3)
    weights, groups = np.concatenate([np.minimum(rng.zipf(1.4, 400), 10_000), [1 << 40, 1 << 39, 5]]), np.concatenate([rng.integers(0, 9, 400), [70, 70, 71]])
    word, length, first, states = context_mixing._shannon(weights, groups)
    for g in set(groups.tolist()):
        own = np.flatnonzero(groups == g)
        paths = [format(int(word[i]), "b").zfill(int(length[i])) if length[i] else "" for i in own]
        assert all(not a.startswith(b) for a in paths for b in paths if a is not b)
        total = weights[own].sum()
        assert all(2.0 ** -length[i] <= weights[i] / total * 1.001 for i in own if weights[i] > 1)
        # the states tell a member's share, up to their steps
        for i, path in zip(own, paths):
            logits = [((int(s) >> 2) - 32) / context_mixing.LOGIT_STEPS for s in states[first[i] : first[i] + length[i]]]
            told = sum(math.log(1 / (1 + math.exp(-x if b == "1" else x))) for x, b in zip(logits, path))
            assert told == pytest.approx(math.log(weights[i] / total), abs=0.3 + 0.15 * length[i])


def test_lm_tables_grow_with_the_tokens():
    sizes = [context_mixing.table_bits(n) for n in (0, 10**3, 10**6, 10**9, 10**12)]
    assert sizes[0] == 16 and sizes == sorted(sizes) and sizes[4] - sizes[3] == 5


def test_pipeline(spark, toxic, tmp_path):
    """The stages on a small folder, against the stages' rules applied in Python."""
    rows, labels, *_ = toxic
    rng = random.Random(8)
    clean = [r for r in rows if not labels[r[0]]]
    item = " ".join(f"bench{k}" for k in range(20))
    copies = [(2000 + k, clean[40][1], "en", None, None) for k in range(5)]
    base = [f"long{rng.randint(0, 10**6)}" for _ in range(300)]
    near = [(3000 + k, " ".join([*base[:150], f"edit{k}", *base[151:]]), "en", None, None) for k in range(8)]
    dirty = [(4000 + k, f"some words before it {k} {item} and after", "en", None, None) for k in range(3)]
    everything = [*rows, *copies, *near, *dirty, (5000, None, None, None, None), (5001, "", "de", None, None)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = [{r.doc_id for r in docs.collect()}]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
    toxic_gone = seen[0] - seen[1]
    assert sum(labels.get(i, 0) for i in toxic_gone) > 0.9 * sum(labels.values()) and sum(1 - labels.get(i, 0) for i in toxic_gone) < 10
    assert {i for i in seen[2] if i >= 3000 and i < 4000} == {3000} and not {r[0] for r in copies} & seen[2]
    assert not {r[0] for r in dirty} & seen[3] and {5000, 5001} <= seen[3]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == seen[3]
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in packed)


def test_small_blocks_are_mixed_without_sorting(monkeypatch):
    """Blocks of few neighbouring documents refine their weights by cells in place, as a plain loop does."""
    lm = context_mixing
    rng = np.random.default_rng(8)
    docs, sizes = 40, [700, 60, 30]
    kept = [range(docs), range(5, 9), range(7, 8)]
    cell = np.concatenate([np.sort(rng.choice(list(d), n)) * lm.KIND_GATES + rng.integers(0, lm.KIND_GATES, n) for d, n in zip(kept, sizes)])
    x = [rng.normal(size=len(cell)).astype(np.float32) for _ in range(lm.K)]
    weights = rng.normal(size=(lm.K, docs * lm.KIND_GATES)).astype(np.float32)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    want, w = np.zeros(docs), weights.astype(np.float64)
    for a, b in zip(edge[:-1], edge[1:]):
        moves, times = np.zeros_like(w), np.zeros(w.shape[1])
        for i in range(a, b):
            odds = math.exp(-min(max(sum(float(x[k][i]) * w[k, cell[i]] for k in range(lm.K)), -14), 14))
            want[cell[i] // lm.KIND_GATES] -= math.log(1 + odds)
            times[cell[i]] += 1
            for k in range(lm.K):
                moves[k, cell[i]] += lm.RATE * odds / (1 + odds) * float(x[k][i])
        w += moves / np.sqrt(np.maximum(times, 1))
    monkeypatch.setattr(lm.np, "unique", None)
    out = np.zeros(docs)
    lm._mixed_online(x, cell, None, weights, edge, out)
    assert np.allclose(out, want, rtol=1e-4, atol=1e-4)
    states = np.arange(256, dtype=np.uint8)
    assert np.array_equal(lm._logits(states), ((np.arange(256) >> 2) - 32).astype(np.float32) / np.float32(lm.LOGIT_STEPS))


@pytest.fixture(scope="module")
def lm_model(spark, lm_rows):
    d = spark.createDataFrame(lm_rows, "doc_id long, text string").coalesce(2)
    return context_mixing.learn(d, F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10, 0)"))[0]


def test_lm_spells_only_held_out_rows(lm_model, lm_rows, monkeypatch):
    """Rare words of training rows are known, so that their spelling is not scored; all other figures are those of rows that are spelled."""
    lm = context_mixing

    class shared:  # noqa: N801
        value = lm_model

    class task:  # noqa: N801
        get = staticmethod(lambda: task)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(lm, "TaskContext", task)
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    rows = [*lm_rows, *((i, f"the zq{i}x of " * 40) for i in range(300, 340))]
    found = []
    for folds in ([fold(i) for i, _ in rows], [0] * len(rows)):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(folds), pa.array([t for _, t in rows])], names=["doc_id", "fold", "text"])
        found.append(pa.Table.from_batches(list(lm._score_batches(shared)(iter([batch])))).to_pylist())
    seen = Counter()
    for own, all_spelled in zip(*found):
        assert own["score"] == pytest.approx(all_spelled["score"], rel=1e-9) and own["base"] == all_spelled["base"]
        for a, b in zip(own["rare"], all_spelled["rare"], strict=True):
            assert (a["word"], a["known"]) == (b["word"], b["known"]) and b["new"] < 0
            assert math.isnan(a["new"]) if own["fold"] else a["new"] == pytest.approx(b["new"], rel=1e-6)
            seen[bool(own["fold"])] += 1
    assert seen[True] and seen[False]
    # nor is it put into symbols
    data, offsets = np.frombuffer(b"q1x the q2xyz", np.uint8), np.array([0, 3, 13])
    bytes_of = lambda spell: lm.tokens_of(data, offsets, lm_model.vocabulary, spell).symbols[lm.BYTE]
    assert bytes_of(None).symbol.tolist() == [*b"q1x", 256, *b"q2xyz", 256]
    assert bytes_of(np.array([False, True])).symbol.tolist() == [*b"q2xyz", 256] and set(bytes_of(np.array([False, True])).token.tolist()) == {3}
    assert not len(bytes_of(np.array([False, False])).token)


def test_lm_fit_counts_bits_once(lm_model, lm_rows, monkeypatch):
    """The fit's sums over counted bits are those over all bits one by one, in portions of any size, and each row is read into bits once."""
    lm = context_mixing
    texts = [t for _, t in lm_rows]
    want = np.zeros((lm.GATES, lm.K, lm.K + 1))
    bits = 0
    for text in texts:
        for symbols, _, _ in plain_events(lm_model, text):
            for kind, path in symbols:
                for bit, states in path:
                    gate = kind * lm.KIND_GATES + (states[1] & 3) * 4 + (states[2] & 3)
                    x = np.array([((s >> 2) - 32) / lm.LOGIT_STEPS for s in states])
                    p = 1 / (1 + math.exp(-min(max(x @ lm_model.weights[gate], -14), 14)))
                    want[gate, :, : lm.K] += np.outer(x, x) * p * (1 - p)
                    want[gate, :, lm.K] += x * (bit - p)
                    bits += 1

    class shared:  # noqa: N801
        value = lm_model

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (lm.BITS_FLUSH, 300):
        monkeypatch.setattr(lm, "BITS_FLUSH", most)
        monkeypatch.setattr(lm, "STEP_BYTES", lm.STEP_BYTES if most > 300 else 500)
        rows = list(lm._bit_batches(shared)(iter([batch])))
        assert (len(rows) > 1) == (most == 300)
        times = [np.frombuffer(row.column(1)[0].as_buffer(), np.int64) for row in rows]
        assert sum(int(n.sum()) for n in times) == bits > sum(map(len, times))
        found = np.zeros(want.size)
        for part in lm._slope_batches(lm_model.weights)(iter(rows)):
            found[np.asarray(part.column(0))] += np.asarray(part.column(1))
        assert np.allclose(found.reshape(want.shape), want, rtol=1e-5, atol=1e-6)
    assert not list(lm._bit_batches(shared)(iter([])))


def test_lm_gates_in_any_order(lm_model, lm_rows, monkeypatch):
    """Scores are the same whether the bits of a gate are brought together or stay as they come."""
    lm = context_mixing
    texts = [t or "" for _, t in lm_rows]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    tokens, found, mixed, ordered = lm.tokens_of(data, offsets, lm_model.vocabulary), [], lm._mixed_online, []
    monkeypatch.setattr(lm, "_mixed_online", lambda x, cell, *rest: ordered.append(np.count_nonzero(np.diff(cell)) / len(cell)) or mixed(x, cell, *rest))
    for most in (0, 1 << 20):
        monkeypatch.setattr(lm, "SHORT_RUN", most)
        found.append(lm.score_run(lm_model, tokens))
    assert ordered[0] > ordered[4]
    for a, b in zip(*found):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-5) and a.any()


def test_bytes_by_arithmetic():
    """Lower-casing and marking bytes give what a look into the tables gives."""
    every = np.arange(256, dtype=np.uint8)
    assert common.lowered(every).tolist() == list(bytes(every).lower())
    rng = np.random.default_rng(2)
    for mask in (SPACED, ALNUM, np.ones(256, bool), np.zeros(256, bool), rng.random(256) < 0.5):
        assert (common.marked(every, mask) == mask).all()
    assert not len(common.marked(every[:0], SPACED))
