"""Set-based rewrites of an overlap graph: edges (v1, v2, ...) in and out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, discard

#: Most vertices of a block of the complement, whose arrays meet one another, and blocks that fewer vertices fall into.
COMPLEMENT_BLOCK, COMPLEMENT_CUTS = 1 << 15, 16
#: Rows of the complement that are put out at once.
COMPLEMENT_ROWS = 1 << 16


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that are not among removed (v1, v2)."""
    return edges.join(removed.select("v1", "v2"), ["v1", "v2"], "left_anti")


def _pairs(edges: DataFrame) -> DataFrame:
    return cut(edges.select("v1", "v2").distinct())


def _transitive_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs u -> v for which some w has u -> w and w -> v.

    A pair looks at u's out-neighbours or at v's in-neighbours, whichever are fewer, so that a
    hub's edges do not meet one another.
    """
    out = pairs.groupBy("v1").agg(F.count("*").alias("n_out"))
    into = pairs.groupBy("v2").agg(F.count("*").alias("n_in"))
    e = pairs.join(out, "v1").join(into, "v2")
    near = pairs.select("v1", F.col("v2").alias("w"))
    ahead = e.where("n_out <= n_in").select("v1", "v2").join(near, "v1").where("w <> v2").join(pairs.select(F.col("v1").alias("w"), "v2"), ["w", "v2"], "left_semi")
    near = pairs.select("v2", F.col("v1").alias("w"))
    behind = e.where("n_out > n_in").select("v1", "v2").join(near, "v2").where("w <> v1").join(pairs.select("v1", F.col("v2").alias("w")), ["v1", "w"], "left_semi")
    return cut(ahead.select("v1", "v2").unionAll(behind.select("v1", "v2")).distinct())


def _transitive_of_order(edges: DataFrame, order: int) -> DataFrame:
    pairs = _pairs(edges)
    for _ in range(order):
        before, pairs = pairs, _transitive_pairs(pairs)
        discard(before)
    return pairs


def transitive_edges(edges: DataFrame) -> DataFrame:
    """Edges u -> v for which some w has u -> w and w -> v."""
    return transitive_of_order(edges, 1)


def transitive_of_order(edges: DataFrame, order: int) -> DataFrame:
    """Edges that stay transitive when the transitive subgraph is taken `order` times."""
    return edges.join(_transitive_of_order(edges, order), ["v1", "v2"], "left_semi") if order else edges


def transitive_reduction(edges: DataFrame, order: int = 1) -> DataFrame:
    return without(edges, _transitive_of_order(edges, order))


def weak_branch_edges(edges: DataFrame) -> DataFrame:
    """Edges no longer than a transitive edge that leaves the same vertex or enters the same one."""
    t = transitive_edges(edges)
    out = edges.join(t.groupBy("v1").agg(F.max("len").alias("most")), "v1").where("len <= most").select("v1", "v2")
    into = edges.join(t.groupBy("v2").agg(F.max("len").alias("most")), "v2").where("len <= most").select("v1", "v2")
    return out.union(into).distinct()


def inclusion_vertices(edges: DataFrame) -> DataFrame:
    """Vertices whose read lies wholly in another: columns v1, v2, pos1, pos3, perc, mismatch."""
    full = edges.where("perc = 100 AND mismatch < 1e-6")
    return full.select(F.when((F.col("pos3") < 0) & (F.col("pos1") == 0), F.col("v1")).when(F.col("pos3") >= 0, F.col("v2")).alias("v")).where("v IS NOT NULL").distinct()


def remove_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that touch none of vertices (v)."""
    return edges.join(vertices.select(F.col("v").alias("v1")), "v1", "left_anti").join(vertices.select(F.col("v").alias("v2")), "v2", "left_anti").select(*edges.columns)


def tips(edges: DataFrame, max_tip_len: int) -> DataFrame:
    """Dead-end vertices beside a branch: columns v1, v2, ext_fwd, ext_back (bases gained either way).

    Of two or more out-neighbours, one without out-edges goes if it adds nothing, or if it adds
    less than max_tip_len and some sibling goes on; likewise against the edges' direction. All
    decisions are made on the graph as it is.
    """
    outdeg = edges.groupBy(F.col("v1").alias("v")).agg(F.count("*").alias("d"))
    indeg = edges.groupBy(F.col("v2").alias("v")).agg(F.count("*").alias("d"))

    def side(near: str, far: str, ext: str, degree: DataFrame) -> DataFrame:
        e = edges.join(degree.withColumnsRenamed({"v": far, "d": "next"}), far, "left").withColumn("alive", F.col("next").isNotNull())
        w = Window.partitionBy(near)
        e = e.withColumns({"n": F.count("*").over(w), "any_alive": F.max("alive").over(w)})
        return e.where((F.col("n") >= 2) & ~F.col("alive") & ((F.col(ext) == 0) | ((F.col(ext) < max_tip_len) & F.col("any_alive")))).select(F.col(far).alias("v"))

    return side("v1", "v2", "ext_fwd", outdeg).union(side("v2", "v1", "ext_back", indeg)).distinct()


def branch_vertices(edges: DataFrame) -> DataFrame:
    """(v, side): vertices with several out-edges or several in-edges."""
    out = edges.groupBy(F.col("v1").alias("v")).agg(F.count("*").alias("d")).where("d > 1").select("v", F.lit("out").alias("side"))
    into = edges.groupBy(F.col("v2").alias("v")).agg(F.count("*").alias("d")).where("d > 1").select("v", F.lit("in").alias("side"))
    return out.union(into)


def branch_free(edges: DataFrame) -> DataFrame:
    """Edges that neither leave an out-branching nor enter an in-branching vertex."""
    b = branch_vertices(edges)
    out = b.where("side = 'out'").select(F.col("v").alias("v1"))
    into = b.where("side = 'in'").select(F.col("v").alias("v2"))
    return edges.join(out, "v1", "left_anti").join(into, "v2", "left_anti").select(*edges.columns)


def remove_branches(edges: DataFrame, components) -> DataFrame:
    """Edges within the components that the branch-free reduced graph leaves; lone vertices stand alone."""
    core = branch_free(transitive_reduction(edges)).select("v1", "v2")
    c = components(core.select(F.col("v1").alias("u"), F.col("v2").alias("v")))
    a, b = c.select(F.col("node").alias("v1"), F.col("component").alias("c1")), c.select(F.col("node").alias("v2"), F.col("component").alias("c2"))
    e = edges.join(a, "v1", "left").join(b, "v2", "left")
    return e.where(F.coalesce("c1", "v1") == F.coalesce("c2", "v2")).select(*edges.columns)


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected pair, once."""
    return edges.select(F.col("v1").alias("u"), F.col("v2").alias("v")).union(edges.select(F.col("v2").alias("u"), F.col("v1").alias("v"))).distinct()


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(u, neighbours): sorted, both directions of undirected pairs (u, v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return both.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("neighbours"))


def _blocks_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of two blocks that are no edge. In: for each two blocks the vertices of the one, those of the other, the edges by u."""
    us = vs = np.zeros(0, np.int64)
    at, own, pair = 0, False, None
    gone: list[np.ndarray] = []

    def put(stop: int) -> Iterator[pa.RecordBatch]:
        """The rows of us[at:stop]; gone holds the places of the edges there, u by u."""
        nonlocal at, gone
        edges = np.unique(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
        many = max(1, COMPLEMENT_ROWS // max(len(vs), 1))
        whole = pa.array(np.tile(vs, min(many, stop - at))) if not own and stop > at else None
        while at < stop:
            end = min(at + many, stop)
            first, last = np.searchsorted(edges, [at * len(vs), end * len(vs)])
            u = np.repeat(us[at:end], len(vs))
            if own or last > first:
                v = np.tile(vs, end - at)
                keep = u < v if own else np.ones(len(v), bool)
                keep[edges[first:last] - at * len(vs)] = False
                u, v = u[keep], pa.array(v[keep])
            else:
                v = whole.slice(0, len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u), v], names=["u", "v"])
            at = end
        gone = [edges[np.searchsorted(edges, at * len(vs)) :]]

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in ("_from", "_to", "_kind")])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            start, to, kind = keys[:, a].tolist()
            if pair != (start, to):
                yield from put(len(us))
                pair, us, vs, at, own, gone = (start, to), us[:0], vs[:0], 0, start == to, []
            if kind < 2:
                block = np.array(batch.column("_all")[a].values)
                us, vs = (block, vs) if kind == 0 else (us, block)
                continue
            u, v = (np.searchsorted(block, batch.column(c).slice(a, b - a).to_numpy()) for c, block in (("u", us), ("v", vs)))
            gone.append(u * len(vs) + v)
            yield from put(int(u[-1]))
    yield from put(len(us))


def _meetings(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """What `_blocks_left` takes in: (_from, _to, _kind, u, v, _all), two rows for each two blocks and one for each edge."""
    place = dense_rank_of(vertices.select(F.col("v").cast("long")).where("v IS NOT NULL").distinct().orderBy("v"), "_place")
    n = place.count()
    size = max(1, min(COMPLEMENT_BLOCK, -(-n // COMPLEMENT_CUTS)))
    last = max(n - 1, 0) // size
    own = place.select("v", F.expr(f"_place div {size}").alias("_block"))
    blocks = own.groupBy("_block").agg(F.array_sort(F.collect_list("v")).alias("_all"))
    row = lambda df, start, to, kind, *rest: df.select(start.alias("_from"), to.alias("_to"), F.lit(kind).alias("_kind"), *rest)
    block, none = F.col("_block"), F.lit(None).cast("long")
    us = row(blocks, block, F.explode(F.sequence(block, F.lit(last).cast("long"))), 0, none.alias("u"), none.alias("v"), "_all")
    vs = row(blocks, F.explode(F.sequence(F.lit(0).cast("long"), block)), block, 1, none.alias("u"), none.alias("v"), "_all")
    e = edges.select(F.col("u").cast("long").alias("_u"), F.col("v").cast("long").alias("_v")).where("_u < _v")
    at = lambda c, name: own.select(F.col("v").alias(c), block.alias(name))
    taken = row(e.join(at("_u", "_from"), "_u").join(at("_v", "_to"), "_v"), F.col("_from"), F.col("_to"), 2, F.col("_u").alias("u"), F.col("_v").alias("v"), F.lit(None).cast("array<bigint>").alias("_all"))
    # dealt by what tasks put out: what they read is too little for Spark to keep them apart
    return us.union(vs).union(taken).repartition((last + 1) * (last + 2) // 2, "_from", "_to")


def complement(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs u < v of vertices (v) that are no edge (u, v), as longs; the result has as many rows as the complement.

    Vertices in order fall into blocks of COMPLEMENT_BLOCK, of fewer where there would be few blocks.
    Each two blocks come together once, as two arrays and the edges between them in order of u; pairs
    come into being where they are put out, so that vertices by blocks and edges are all that is shuffled.
    """
    met = _meetings(edges, vertices).sortWithinPartitions("_from", "_to", "_kind", "u")
    return met.mapInArrow(_blocks_left, "u long, v long")


def dense_rank_of(ordered: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Adds name: the place of each row of a sorted DataFrame, from `first`, without gathering the rows in one task.

    Sorting leaves ranges in order over the partitions, so that a row's place is its place in the
    partition and the sizes of those before; a row for each partition comes together for that.
    """
    own = cut(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("_part").agg(F.min("_at").alias("_least"), F.count("*").alias("_n")).select("_part", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return own.join(base, "_part").withColumn(name, (F.col("_base") + F.col("_at") - F.col("_least") + first).cast("long")).select(*ordered.columns, name)


def adjacency_rank(edges: DataFrame) -> DataFrame:
    """Adds rank: out-edges of a vertex by (non-overlapping length, v2), from 0."""
    w = Window.partitionBy("v1").orderBy("nonoverlap", "v2")
    return edges.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def neighbor_rankings(edges: DataFrame) -> DataFrame:
    """Adds the ranks of out-neighbours by position, score, length and mismatch, ties by id."""
    w = Window.partitionBy("v1")
    number = lambda *order: F.row_number().over(w.orderBy(*order)).cast("long")
    return edges.withColumns({"by_pos": number("pos", "v2"), "by_score": number(F.desc("score"), "v2"), "by_len": number(F.desc("len"), "v2"), "by_mismatch": number("mismatch", "v2")})


def indegrees(edges: DataFrame) -> DataFrame:
    """(v, indegree) of every vertex on an edge."""
    into = edges.select(F.col("v2").alias("v"), F.lit(1).alias("d"))
    return edges.select(F.col("v1").alias("v"), F.lit(0).alias("d")).union(into).groupBy("v").agg(F.sum("d").cast("long").alias("indegree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, undirected edges (u, v) and largest degree."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    d = both.groupBy("u").agg(F.count("*").alias("d"))
    return d.agg(F.count("*").alias("n"), (F.sum("d") / 2).cast("long").alias("m"), F.max("d").alias("max_degree"))


def equivalent_edges(edges: DataFrame, vertices: int) -> DataFrame:
    """Edges and their mirror images between the reverse complements v + vertices: columns v1, v2, pos1, pos3, ori1, ori2."""
    n = F.lit(vertices)
    turned = lambda v, o: F.when(F.col(o), F.col(v)).otherwise(F.col(v) + n)
    mirror = lambda v, o: F.when(F.col(o), F.col(v) + n).otherwise(F.col(v))
    own = edges.select(turned("v1", "ori1").alias("v1"), turned("v2", "ori2").alias("v2"), F.col("pos1").alias("pos"))
    lead = F.col("pos3") < 0
    back = edges.select(F.when(lead, mirror("v2", "ori2")).otherwise(mirror("v1", "ori1")).alias("v1"), F.when(lead, mirror("v1", "ori1")).otherwise(mirror("v2", "ori2")).alias("v2"), F.abs("pos3").alias("pos"))
    return own.union(back).distinct()


def kcore(edges: DataFrame, k: int, cut) -> DataFrame:
    """Undirected edges (u, v) of the k-core: vertices of smaller degree go, round after round."""
    now = cut(edges.select("u", "v").distinct())
    n = now.count()
    while n:
        both = now.select("u").union(now.select(F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") < k).select("u")
        after = cut(now.join(low, "u", "left_anti").join(low.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"))
        m = after.count()
        if m == n:
            break
        discard(now)
        now, n = after, m
    return now


def degeneracy(edges: DataFrame, cut) -> int:
    """The largest k with a non-empty k-core."""
    k, now = 0, edges
    while True:
        now = kcore(now, k + 1, cut)
        if now.isEmpty():
            return k
        k += 1


def degeneracy_order(edges: DataFrame, cut) -> DataFrame:
    """(v, core, place): the vertices of undirected edges (u, v) by core number, then id, from place 0."""
    ends = lambda e: e.select(F.col("u").alias("v")).unionAll(e.select("v")).distinct()
    now, k, found = cut(edges.select("u", "v").distinct()), 1, None
    while not now.isEmpty():
        inner = kcore(now, k + 1, cut)
        peeled = cut(ends(now).join(ends(inner), "v", "left_anti").withColumn("core", F.lit(k)))
        found = peeled if found is None else found.unionAll(peeled)
        now, k = inner, k + 1
    if found is None:
        found = ends(now).withColumn("core", F.lit(0))
    return dense_rank_of(found.orderBy("core", "v"), "place")


def cyclic_core(edges: DataFrame, cut) -> DataFrame:
    """Directed edges (u, v) left when vertices without in-edges or without out-edges are peeled off.

    Peeling a long path end by end would take as many rounds as it has vertices. So each round
    also bypasses vertices with one in- and one out-edge, of which no two are neighbours (those
    with the least hash among such neighbours): u -> x -> v becomes u -> v. A bypassed vertex
    belongs to the core if both its neighbours do, which the bypasses, undone in reverse, tell.
    """
    own = cut(edges.select("u", "v").where("u <> v").distinct())
    now, bypassed, step = own, [], 0
    while not now.isEmpty():
        into = now.groupBy(F.col("v").alias("x")).agg(F.count("*").alias("i"), F.min("u").alias("a"))
        out = now.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("o"), F.min("v").alias("b"))
        both = cut(into.join(out, "x"))  # vertices with edges on either side
        kept = now.join(both.select(F.col("x").alias("u")), "u", "left_semi").join(both.select(F.col("x").alias("v")), "v", "left_semi").select("u", "v")
        chain = both.where("i = 1 AND o = 1 AND a <> x AND b <> x").select("x", "a", "b", F.xxhash64("x", F.lit(step)).alias("h"))
        mates = chain.select(F.col("x").alias("y"), F.col("h").alias("g"))
        first = chain.join(mates.withColumnsRenamed({"y": "a", "g": "ga"}), "a", "left").join(mates.withColumnsRenamed({"y": "b", "g": "gb"}), "b", "left")
        first = cut(first.where("(ga IS NULL OR h < ga) AND (gb IS NULL OR h < gb)").select("x", "a", "b"))
        less = kept.join(first.select(F.col("x").alias("u")), "u", "left_anti").join(first.select(F.col("x").alias("v")), "v", "left_anti").select("u", "v")
        # a bypass whose neighbour has just been peeled goes with it
        ends = both.select("x")
        made = first.join(ends.select(F.col("x").alias("a")), "a", "left_semi").join(ends.select(F.col("x").alias("b")), "b", "left_semi")
        after = cut(less.union(made.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct())
        bypassed.append(first)
        settled = first.isEmpty() and after.count() == now.count()
        now, step = after, step + 1
        if settled:
            break
    inside = cut(now.select(F.col("u").alias("x")).union(now.select("v")).distinct())
    for first in reversed(bypassed):
        more = first.join(inside.select(F.col("x").alias("a")), "a", "left_semi").join(inside.select(F.col("x").alias("b")), "b", "left_semi").select("x")
        inside = cut(inside.union(more).distinct())
    return own.join(inside.select(F.col("x").alias("u")), "u", "left_semi").join(inside.select(F.col("x").alias("v")), "v", "left_semi").select("u", "v")
