"""Properties of the operators and the registered queries against DuckDB."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from haplograph import config, registry
from haplograph.functions import cigar, seq
from haplograph.operators import analysis, consensus, evidence, fixpoint, joins, overlap
from haplograph.operators import graph as G
from haplograph.session import cut
from haplograph.sources import tables as T
from haplograph.sources import text as src

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    want, got = duck.sql(registry.SQL[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def test_components_of_long_paths(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    pairs = [(order[i], order[i + 1]) for i in range(199) if i != 99] + [(500, 500), (501, 502), (502, 501)]
    found = {r.node: r.component for r in fixpoint.connected_components(graph(spark, pairs)).collect()}
    want = {**{x: min(order[:100]) for x in order[:100]}, **{x: min(order[100:]) for x in order[100:]}, 501: 501, 502: 501}
    assert found == want
    assert fixpoint.connected_components(graph(spark, [])).count() == 0


def test_matching_equals_sequential(spark):
    rng = random.Random(2)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(120)) if a < b})
    ranked = fixpoint.ranked(spark.createDataFrame(pairs, "v1 long, v2 long"))
    taken, used = set(), set()
    for a, b in pairs:
        if a not in used and b not in used:
            taken.add((a, b))
            used |= {a, b}
    assert {(r.v1, r.v2) for r in fixpoint.greedy_matching(ranked).collect()} == taken


def test_first_choice_equals_sequential(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(40)) if a != b]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = set()
    for x in range(31):
        if not near.get(x, set()) & kept and (x in near or x == 30):
            kept.add(x)
    rows = [(a, b) for a in near for b in near[a]] + [(30, None)]
    assert {r.node for r in fixpoint.first_choice(spark.createDataFrame(rows, "node long, neighbour long")).collect()} == kept


def test_cliques_equal_naive(spark):
    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(60)) if a < b}
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in range(14)}
    found = {tuple(r.members) for r in fixpoint.maximal_cliques(graph(spark, sorted(pairs))).collect()}
    sets = [()]
    for x in range(14):
        sets += [(*s, x) for s in sets if all(x in near[y] for y in s)]
    want = {s for s in sets if len(s) > 1 and not any(all(y in near[x] for y in s) for x in range(14) if x not in s)}
    assert found == want


def test_back_edges_leave_no_cycle(spark):
    rng = random.Random(5)
    pairs = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(70)) if a != b}
    e = graph(spark, sorted(pairs))
    back = {(r.u, r.v) for r in fixpoint.back_edges(G.cyclic_core(e, fixpoint.cut)).collect()}
    rest = pairs - back
    assert back <= pairs
    while True:
        heads = {b for _, b in rest}
        after = {(a, b) for a, b in rest if a in heads}
        if after == rest:
            break
        rest = after
    assert not rest


@pytest.mark.parametrize("seed", range(4))
def test_cyclic_core_equals_peeling(spark, seed):
    rng = random.Random(seed)
    n = [12, 30, 40, 25][seed]
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range([14, 40, 38, 60][seed])) if a != b}
    pairs |= {(100 + i, 101 + i) for i in range(60)} | ({(160, 130)} if seed % 2 else set()) | {(300, 301), (301, 300), (302, 300)}
    core = set(pairs)
    while True:
        heads, tails = {b for _, b in core}, {a for a, _ in core}
        after = {(a, b) for a, b in core if a in heads and b in tails}
        if after == core:
            break
        core = after
    assert {(r.u, r.v) for r in G.cyclic_core(graph(spark, sorted(pairs)), fixpoint.cut).collect()} == core


def test_orientation_conflict(spark):
    rows = [(1, 2, True), (2, 3, False), (5, 6, True), (6, 7, True), (7, 5, False)]
    out = {r.node: (r.component, r.flipped, r.conflict) for r in fixpoint.orientation_labels(spark.createDataFrame(rows, "v1 long, v2 long, same_ori boolean")).collect()}
    assert out[1] == (1, False, False) and out[2] == (1, False, False) and out[3] == (1, True, False)
    assert all(out[x][2] for x in (5, 6, 7))


def test_degeneracy(spark):
    clique = [(a, b) for a in range(5) for b in range(a)]
    assert G.degeneracy(graph(spark, [*clique, (7, 8), (8, 0)]), fixpoint.cut) == 4


def test_scores_are_bounded_and_ignore_n(spark):
    reads = spark.createDataFrame([(0, "ACGTACGT", "IIIIIIII"), (1, "ACGTACGT", "IIIIIIII"), (2, "NNNNNNNN", "!!!!!!!!"), (3, "ACGAACGT", "IIII!III")], "read_id long, seq string, qual string")
    o = spark.createDataFrame([(0, 1, 0, 8), (0, 2, 0, 8), (0, 3, 0, 8)], "id1 long, id2 long, pos long, len long")
    out = {r.id2: r for r in overlap.score_overlaps(o, reads).collect()}
    assert 0.99 < out[1].score <= 1 and out[1].mismatch == 0
    assert out[2].score == 0 and out[2].mismatch == 1
    assert 0 < out[3].score < out[1].score and out[3].mismatch == pytest.approx(1 / 8)


def test_consensus_of_impossible_bases(spark):
    from haplograph.operators import consensus

    cols = spark.createDataFrame([(0, 0, "A", 0), (0, 0, "C", 0), (0, 1, "N", 30), (0, 2, "G", 40), (0, 2, "G", 40)], "group long, pos long, base string, q int")
    out = {r.pos: r.base for r in consensus.consensus_bases(cols).collect()}
    assert out[1] == "N" and out[2] == "G"


def test_revcomp_and_cigar(spark):
    d = spark.createDataFrame([("ACGTN", "3S2M1I4D", 20)], "s string, c string, f int")
    r = d.select(seq.revcomp(F.col("s")).alias("r"), seq.revcomp(seq.revcomp(F.col("s"))).alias("rr"), cigar.tokens(F.col("c")).alias("t"), cigar.flags(F.col("f")).alias("f"), cigar.reference_length(F.col("c")).alias("n")).first()
    assert r.r == "NACGT" and r.rr == "ACGTN" and [tuple(x) for x in r.t] == [(3, "S"), (2, "M"), (1, "I"), (4, "D")] and r.f == [4, 16] and r.n == 9


def test_interval_overlaps_once(spark):
    a = spark.createDataFrame([(i, i * 7, i * 7 + 30) for i in range(20)], "x long, a long, b long")
    b = spark.createDataFrame([(i, i * 11, i * 11 + 25) for i in range(12)], "y long, c long, d long")
    out = [(r.x, r.y) for r in joins.interval_overlaps(a, b, ("a", "b"), ("c", "d"), 10).collect()]
    want = [(i, j) for i in range(20) for j in range(12) if i * 7 <= j * 11 + 25 and j * 11 <= i * 7 + 30]
    assert sorted(out) == sorted(want)


def test_fastq_with_at_in_qualities(spark, tmp_path):
    rng = random.Random(6)
    recs = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(20)), "@" * (i % 3) + "I" * (20 - i % 3)) for i in range(400)]
    (tmp_path / "x.fastq").write_text("".join(f"@{n} more\n{s.lower()}\n+\n{q}\n" for n, s, q in recs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        out = {(r.read_id, r.seq, r.qual) for r in src.read_fastq(spark, f"file://{tmp_path}/x.fastq").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert out == set(recs)


def plain_expected(coverage, length, mean, sd):
    """The table's first two columns, distance by distance and placement by placement."""
    import math

    cdf = lambda x: 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))
    out = []
    for d in range(1, int(mean + 2 * length + 2 * sd) + 1):
        pairs = 0.0
        for x in range(length):
            longest, shortest = d - length + x, d - 2 * length + x + 1
            pairs += cdf(longest) - cdf(shortest)
        out.append((d, math.floor(coverage * max(0, length - d) / length + coverage * pairs / length)))
        if out[-1][1] == 0:
            break
    return out


@pytest.mark.parametrize("numbers", [(20, 100, 300, 30), (100, 250, 200, 50), (50, 150, 100, 40)])
def test_evidence_table(numbers):
    table = evidence.evidence_table(*numbers)
    assert [r[:2] for r in table] == plain_expected(*numbers)
    least = {e: m for _, e, m in table}
    assert all(m == least[e] for _, e, m in table) and min(least.values()) >= 1
    assert [least[e] for e in sorted(least)] == sorted(least.values())


def test_evidence_thresholds():
    assert evidence.min_evidence(0) == 1
    assert evidence.min_evidence(30) == min(m for m in range(1, 31) if sum(math.comb(30, i) * 0.01**i * 0.99 ** (30 - i) for i in range(m, 30)) <= 1e-3)


@pytest.mark.parametrize(
    ("loads", "margin", "gone"),
    [
        ({(1, 3): 9, (1, 4): 1, (2, 3): 2, (2, 4): 7}, 1, {(1, 4), (2, 3)}),
        ({(1, 3): 9, (2, 4): 1, (1, 4): 8, (2, 3): 8}, 1, {(1, 3), (2, 4)}),  # the pair of 8s has more in all
        ({(1, 3): 9, (1, 4): 1}, 1, set()),
        ({(1, 3): 5, (1, 4): 0, (2, 3): 0, (2, 4): 0}, 1, {(1, 4), (2, 3)}),
        ({(1, 3): 5, (1, 4): 0, (2, 3): 0, (2, 4): 4}, 1, {(1, 4), (2, 3)}),
        ({(1, 3): 5, (1, 4): 4, (2, 3): 0, (2, 4): 0}, 4, {(2, 3), (2, 4)}),  # close: both stay, all unsupported go
        ({(1, 3): 9, (1, 4): 4, (2, 3): 0, (2, 4): 0}, 4, {(1, 4), (2, 3)}),
        ({(1, 3): 0, (1, 4): 0, (2, 3): 0, (2, 4): 0}, 1, set()),
        ({(1, 3): 4, (1, 4): 3, (2, 4): 0}, 8, {(2, 4)}),
    ],
)
def test_double_branches(spark, loads, margin, gone):
    rows = [(7, a, b, n) for (a, b), n in loads.items()] + [(8, a, 50, 3) for a in range(5)]
    found = evidence.diploid_removals(spark.createDataFrame(rows, "component long, v1 long, v2 long, support long"), margin)
    assert {(r.v1, r.v2) for r in found.collect()} == gone


def test_scores_at_borders(spark):
    reads = spark.createDataFrame([(1, "ACGT", "IIII"), (2, "ACG", "III"), (3, "NNNN", "IIII"), (4, "AC", "II"), (5, "TTTT", "IIII")], "read_id long, seq string, qual string")
    rows = [(1, 2, 6), (1, 2, 4), (1, 2, 1), (1, 3, 0), (1, 4, 0), (1, 5, 3), (1, 5, 3), (1, 5, 0)]
    out = overlap.score_overlaps(spark.createDataFrame(rows, "id1 long, id2 long, pos long"), reads, min_read_len=3, mismatch=1e-4).collect()
    found = sorted((r.id1, r.id2, r.pos, round(r.score, 3), r.mismatch) for r in out)
    assert [x for x in found if x[1:3] in ((2, 6), (2, 4), (3, 0), (4, 0))] == [(1, 2, 4, 0, 1), (1, 2, 6, 0, 1), (1, 3, 0, 0, 1), (1, 4, 0, 0, 1)]
    assert [x for x in found if x[1:3] == (5, 3)] == [(1, 5, 3, 1.0, 0)] * 2  # a row that repeats comes out twice
    assert [x for x in found if x[1:3] == (5, 0)] == [(1, 5, 0, 0, 1)]  # a column too improbable
    lax = overlap.score_overlaps(spark.createDataFrame([(1, 5, 0)], "id1 long, id2 long, pos long"), reads).first()
    assert lax.mismatch == 0.75 and 0 < lax.score < 0.01


def test_mates_by_position(spark, tmp_path):
    one = [(str(i % 7), "acGTn"[: 1 + i % 5] + "A") for i in range(300)]  # ids repeat, letters keep their case
    two = [(i, s[::-1]) for i, s in one]
    for name, rows in (("1", one), ("2", two), ("3", two[1:] + two[:1]), ("4", two[:-1])):
        (tmp_path / name).write_text("".join(f"@{i} x\n{s}\n+\n{'@' * len(s)}\n" for i, s in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    try:
        at = lambda n: f"file://{tmp_path}/{n}"
        found = sorted((r.read_id, r.seq1, r.seq2) for r in src.read_fastq_pairs(spark, at(1), at(2)).collect())
        assert found == sorted((i, s, t) for (i, s), (_, t) in zip(one, two))
        for other in (3, 4):
            with pytest.raises(Exception, match="same order"):
                src.read_fastq_pairs(spark, at(1), at(other)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_islands_across_bins(spark):
    start = (1 << 16) - 50
    d = spark.createDataFrame([(p, 5) for p in range(start, start + 200)] + [(p, 1) for p in range(10)], "pos long, depth long")
    assert [tuple(r) for r in analysis.islands(d, 2, 100).collect()] == [(start, start + 199, 5)]


def test_config_checks():
    assert config.viral_error_correction(250).min_overlap_len == 150
    with pytest.raises(ValueError):
        config.Config(remove_branches=True)
    with pytest.raises(ValueError):
        config.Config(edge_threshold=2)


def plain_matching(rows):
    used, out = set(), set()
    for a, _, b in sorted((a, r, b) for a, b, r in rows):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


def test_matching_of_long_chains(spark):
    """A chain in increasing order would take a round for each edge; the rest is matched in order."""
    rows = [(i, i + 1, 0) for i in range(300)] + [(1000 + i, 1001 + i, i % 3) for i in range(100)]
    found = fixpoint.greedy_matching(spark.createDataFrame(rows, "v1 long, v2 long, rank long"))
    assert {(r.v1, r.v2) for r in found.collect()} == plain_matching(rows)


def test_first_choice_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(200)]
    both = [*pairs, *((b, a) for a, b in pairs), (999, None)]
    found = {r.node for r in fixpoint.first_choice(spark.createDataFrame(both, "node long, neighbour long")).collect()}
    assert found == {*range(0, 201, 2), 999}


def test_degeneracy_equals_peeling(spark):
    rng = random.Random(11)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(130)) if a < b})
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in range(30)}
    most = 0
    while near:
        x = min(near, key=lambda v: len(near[v]))
        most = max(most, len(near[x]))
        for y in near.pop(x):
            near[y].discard(x)
    assert G.degeneracy(graph(spark, pairs), cut) == most


def test_core_numbers(spark):
    rng = random.Random(12)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(100)) if a < b})
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in {v for p in pairs for v in p}}
    core, k = {}, 0
    while near:
        x = min(near, key=lambda v: len(near[v]))
        k = max(k, len(near[x]))
        core[x] = k
        for y in near.pop(x):
            near[y].discard(x)
    rows = G.degeneracy_order(graph(spark, pairs), cut).collect()
    assert {r.v: r.core for r in rows} == core
    assert [r.v for r in sorted(rows, key=lambda r: r.place)] == sorted(core, key=lambda v: (core[v], v))


def test_back_edges_leave_no_cycle(spark):
    rng = random.Random(13)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(60)) if a != b})
    core = G.cyclic_core(graph(spark, pairs), cut)
    gone = {(r.u, r.v) for r in fixpoint.back_edges(core).collect()}
    assert gone and gone <= set(pairs)
    left = set(pairs) - gone
    while left:
        sources = {a for a, _ in left} - {b for _, b in left}
        assert sources  # a graph without cycles has a source
        left = {(a, b) for a, b in left if a not in sources}


def test_em_abundance_equals_plain_version(spark):
    rng = random.Random(14)
    hits = sorted({(r, t) for r in range(60) for t in rng.sample("abcd", rng.randint(1, 3))})
    length = {"a": 100, "b": 250, "c": 70, "d": 900}
    found = {r.target: r.est_count for r in analysis.em_abundance(spark.createDataFrame(hits, "read long, target string"), spark.createDataFrame(list(length.items()), "target string, length long"), 10).collect()}
    targets = sorted({t for _, t in hits})
    rho = dict.fromkeys(targets, 1.0)
    by_read = {}
    for r, t in hits:
        by_read.setdefault(r, []).append(t)
    for _ in range(10):
        new = dict.fromkeys(targets, 0.0)
        for own in by_read.values():
            total = sum(rho[t] / length[t] for t in own)
            for t in own:
                new[t] += rho[t] / length[t] / total
        rho = {t: x / len(by_read) for t, x in new.items()}
    assert all(found[t] == pytest.approx(rho[t] * len(by_read), rel=1e-6) for t in targets)


def test_places_of_sorted_rows(spark):
    d = spark.range(1000).selectExpr("id * 7919 % 1000 AS x").repartition(7).orderBy("x")
    assert sorted((r.x, r.place) for r in G.dense_rank_of(d, "place", 5).collect()) == [(i, i + 5) for i in range(1000)]


def test_malformed_lines_are_passed_over(spark, tmp_path):
    (tmp_path / "a").write_text("1 2 N 3 4 5 6 7\n1 2 N 3 4 5 6\n\n1 2 I -3 4 5 6 0 9\n")
    assert [tuple(r) for r in T.read_sfo(spark, f"file://{tmp_path}/a").collect()] == [(1, 2, "N", 3, 4, 5, 6, 7)]
    (tmp_path / "m").write_text("% note\n\n3 2\n2 3\n1\n\n9 9\n")
    assert sorted(tuple(r) for r in T.read_metis(spark, f"file://{tmp_path}/m").collect()) == [(0, 1), (0, 2), (1, 0)]
    (tmp_path / "l").write_text("2 1\n1\n\n")
    with pytest.raises(Exception, match="loop"):
        T.read_metis(spark, f"file://{tmp_path}/l").collect()
    assert sorted(tuple(r) for r in T.edges_of_stream(spark, ["3", "2", "0,1", "1,0"], chunk=2).collect()) == [(0, 1), (1, 0)]
    (tmp_path / "i").write_text("7\t>r1\n8\tr2\n")
    ids = T.read_ids(spark, f"file://{tmp_path}/i")
    with pytest.raises(Exception, match="correspondence"):
        T.mapped_ids(spark.createDataFrame([("r3",)], "read_id string"), ids).collect()


def test_stranded_overlaps_equal_brute_force(spark):
    rng = random.Random(15)
    genome = "".join(rng.choice("ACGT") for _ in range(160))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = []
    for i in range(30):
        at, n = rng.randrange(110), rng.choice([30, 40, 50])
        s = list(genome[at : at + n])
        if i % 5 == 0:
            s[n // 2] = rng.choice("ACGT")
        reads.append((i, turn("".join(s)) if rng.random() < 0.5 else "".join(s)))
    reads += [(30, reads[3][1]), (31, turn(reads[4][1]))]
    views = [(2 * i + k, s if k == 0 else turn(s)) for i, s in reads for k in (0, 1)]
    for inclusions in (True, False):
        want = set()
        for x, a in views:
            for y, b in views:
                for pos in range(len(a) - 20 + 1) if x // 2 != y // 2 else ():
                    n = min(len(a) - pos, len(b))
                    mm = sum(p != q for p, q in zip(a[pos:], b))
                    after = pos + len(b) - len(a)
                    if n < 20 or mm > 1 or (not inclusions and (pos == 0 or after <= 0)):
                        continue
                    own = (x, y, pos) if pos or x < y else (y, x, 0)
                    u, v = x ^ 1, y ^ 1
                    other = (v, u, after) if after > 0 else (u, v, -after) if after < 0 else (min(u, v), max(u, v), 0)
                    best = min((own, other), key=lambda t: (t[0] % 2 + t[1] % 2, t[0] % 2, *t))
                    want.add((best[0] // 2, best[1] // 2, "+-"[best[0] % 2], "+-"[best[1] % 2], best[2], n, mm))
        found = [tuple(r) for r in joins.stranded_overlaps(spark.createDataFrame(reads, "read_id long, seq string"), 20, 1, inclusions).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_complement_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "COMPLEMENT_BLOCK", 3)
    rng = random.Random(9)
    ids = rng.sample(range(-50, 10**6), 11)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in (rng.sample(ids, 2) for _ in range(20))})
    vertices = spark.createDataFrame([(v,) for v in [*ids, ids[0], None]], "v long")
    found = G.complement(graph(spark, [*pairs, pairs[0], (7, 8)]), vertices)
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a in ids for b in ids if a < b and (a, b) not in pairs)
    assert G.complement(graph(spark, []), vertices.limit(0)).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (u" not in plan and "LeftAnti" not in plan


def test_complement_shuffles_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "COMPLEMENT_ROWS", 50)
    rng = random.Random(10)
    ids = rng.sample(range(-(10**6), 10**6), 130)
    first = min(ids)
    pairs = [(first, v) for v in ids if v != first and v % 3] + [tuple(sorted(rng.sample(ids, 2))) for _ in range(300)]
    vertices = spark.createDataFrame([(v,) for v in ids], "v long")
    for most in (1 << 15, 20):
        monkeypatch.setattr(G, "COMPLEMENT_BLOCK", most)
        rows = sorted(map(tuple, G.complement(graph(spark, [*pairs, pairs[-1], (5, 4)]), vertices).collect()))
        assert rows == sorted((a, b) for a in ids for b in ids if a < b and (a, b) not in set(pairs))
        # two rows for each two blocks, not one for each vertex and block
        assert G._meetings(graph(spark, []), vertices).count() <= G.COMPLEMENT_CUTS * (G.COMPLEMENT_CUTS + 1)


def test_mates_merge_at_long_overlaps_and_ignore_n(spark):
    rng = random.Random(4)
    dna = "".join(rng.choice("ACGT") for _ in range(150))
    long1, long2 = dna[:100], dna[20:]  # 80 bases, more than a read of the tables has
    n1, n2 = dna[:40], "N" + dna[21:60]  # 20 bases, of which the first is unknown
    rows = [(1, long1, long2), (2, n1, n2), (3, dna[:40], dna[25:45]), (4, dna[:40], dna[26:60]), (5, dna[:40], None), (6, "ACGT", dna[:30]), (7, "A" * 40, "A" * 40)]
    p = spark.createDataFrame([(i, a, "I" * len(a), b, b and "I" * len(b)) for i, a, b in rows] + [(8, long1, "I", long2, "I" * len(long2))], "pair_id long, seq1 string, qual1 string, seq2 string, qual2 string")
    found = {r.pair_id: (r.overlap, r.seq) for r in consensus.mate_merge(p).collect()}
    assert found == {1: (80, dna), 2: (20, dna[:60]), 3: (15, dna[:45]), 7: (15, "A" * 65)}
    assert 1 not in {r.pair_id for r in consensus.mate_merge(p, most=79).collect()}


def test_phased_blocks(spark):
    rng = random.Random(6)
    dna = "".join(rng.choice("ACGT") for _ in range(5000))
    places = sorted(rng.sample(range(5000), 900))
    refs = [(1, 100, dna), (2, 0, "ACGT"), (3, 0, "ACGT"), (4, 0, None)]
    found = [(1, 100 + p, ["a", "c", "g"][: 1 + p % 3]) for p in places]
    odd = [(1, 99, ["x"]), (1, 5100, ["x"]), (2, 0, ["t", None]), (2, 3, ["a", "c"]), (2, 1, []), (2, None, ["x", "x"]), (3, 2, []), (4, 0, ["a"]), (5, 0, ["a"])]
    rng.shuffle(found)
    v = spark.createDataFrame(found + odd, "block long, pos long, alleles array<string>")
    out = analysis.phase_contigs(spark.createDataFrame(refs, "block long, first_pos long, seq string"), v)
    want = {(2, 0): "tCGa", (2, 1): "ACGc"}
    for hap in range(3):
        bases = list(dna)
        for p in places:
            if hap < 1 + p % 3:
                bases[p] = "acg"[hap]
        want[1, hap] = "".join(bases)
    assert {(r.block, r.hap): r.seq for r in out.collect()} == want and out.count() == len(want)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
