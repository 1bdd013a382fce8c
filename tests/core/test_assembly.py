"""Known genomes come back from their reads."""

import random
from dataclasses import replace

import pytest

from haplograph.config import Config
from haplograph.operators import fixpoint, joins
from haplograph.plans import assemble as A


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_contigs_are_the_genome(spark):
    g = genome(200, 1)
    rows = [(i, g[p : p + 60], "I" * 60) for i, p in enumerate(range(0, 141, 20))]
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    state, log = A.assemble(A.first_state(reads, joins.suffix_prefix(reads, 25)), Config(edge_threshold=0.97, min_overlap_len=25, min_clique_size=2, remove_trans=1, remove_tips=False))
    contigs = [r.seq for r in state.reads.collect()]
    assert contigs == [g] and log[-1]["reads"] == 1
    held = state.lineage.collect()
    assert {(r.orig_id, r.idx) for r in held} == {(i, p) for i, p in enumerate(range(0, 141, 20))}


def test_cliques_correct_errors(spark):
    g = genome(80, 2)
    rows = []
    for i in range(6):
        s = g[i : i + 70]
        if i == 2:
            s = s[:30] + ("A" if s[30] != "A" else "C") + s[31:]
        rows.append((i, s, "5" * 70))
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    o = spark.createDataFrame([(a, b, b - a, 70 - (b - a)) for a in range(6) for b in range(a + 1, 6)], "id1 long, id2 long, pos long, len long")
    out = A.iterate(A.first_state(reads, o), Config(edge_threshold=0.8, min_overlap_len=30, min_clique_size=4, cliques=True, error_correction=True, remove_tips=False))
    made = [r.seq for r in out.reads.collect() if len(r.seq) > 60]
    assert len(made) == 1 and made[0] in g


def test_regions(spark):
    a = spark.createDataFrame([(i, i * 5, i * 5 + 59) for i in range(100)], "read_id long, a long, b long")
    out = A.regions(a, 200, 50, 1).collect()
    assert {r.read_id for r in out} == set(range(100)) and all(r.stop - r.start < 250 for r in out)


def test_reads_of_both_strands(spark):
    g = genome(200, 3)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(i, turn(g[p : p + 60]) if i % 3 == 1 else g[p : p + 60], "".join(chr(60 + (i + k) % 10) for k in range(60))) for i, p in enumerate(range(0, 141, 20))]
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    state, flips = A.oriented(reads, joins.stranded_overlaps(reads, 25))
    turned = {r.read_id for r in flips.collect() if r.flipped}
    assert turned in ({i for i, *_ in rows if i % 3 == 1}, {i for i, *_ in rows if i % 3 != 1})
    assert all(r.qual == (rows[r.read_id][2][::-1] if r.read_id in turned else rows[r.read_id][2]) for r in state.reads.collect())
    state, _ = A.assemble(state, Config(edge_threshold=0.97, min_overlap_len=25, min_clique_size=2, remove_trans=1, remove_tips=False))
    assert [r.seq for r in state.reads.collect()] in ([g], [turn(g)])


def test_labels_follow_the_better_edges(spark):
    """A triangle that no labelling satisfies: its weakest edge yields."""
    e = spark.createDataFrame([(1, 2, True, 9.0), (2, 3, False, 8.0), (1, 3, True, 1.0), (5, 4, False, 1.0), (7, 7, False, 1.0)], "v1 long, v2 long, same_ori boolean, score double")
    labels = {r.node: (r.component, r.flipped) for r in fixpoint.spanning_labels(e).collect()}
    assert labels == {1: (1, False), 2: (1, False), 3: (1, True), 4: (4, False), 5: (4, True)}


def test_options(spark):
    g = genome(120, 5)
    reads = spark.createDataFrame([(i, g[p : p + 60], "I" * 60) for i, p in enumerate((0, 20, 40, 60))] + [(4, g[10:50], "I" * 40)], "read_id long, seq string, qual string")
    overlaps = joins.suffix_prefix(reads, 25)
    least = Config(edge_threshold=0.97, min_overlap_len=25, min_clique_size=2, remove_trans=1, remove_tips=False)
    for option in (replace(least, branch_reduction=True), replace(least, diploid=True), replace(least, separate_tips=False)):
        with pytest.raises(NotImplementedError):
            A.iterate(A.first_state(reads, overlaps), option)
    few = A.first_state(reads, overlaps, replace(least, max_reads=2, max_overlaps=1))
    assert {r.read_id for r in few.reads.collect()} == {0, 1} and [tuple(r) for r in few.overlaps.collect()] == [(0, 1, 20, 40)]
    edges = lambda cfg: {tuple(sorted((r.v1, r.v2))) for r in A._edges(A.first_state(reads, overlaps), cfg)[0].collect()}
    assert (0, 4) in edges(least)
    assert (0, 4) not in edges(replace(least, no_inclusion_overlaps=True))
    assert not any(4 in e for e in edges(replace(least, min_read_len=50)))
