"""Fix-points over graphs: components, orientations, feedback edges, matching and cliques.

Loops cut their lineage by writing each round in the shared folder, never by a local checkpoint,
so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, discard


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable, for every node of undirected edges (u, v).

    Large-star and small-star steps in turn tie every node to its least neighbour, until the
    edges stay as they are: about log(n) rounds, also on long paths. Loops and repeated edges
    are allowed, rows with a null are passed over.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        old, now = now, cut(small.distinct())
        discard(old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            named = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return named.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def orientation_labels(edges: DataFrame) -> DataFrame:
    """(node, component, flipped, conflict) for edges (v1, v2, same_ori): labels under which edges agree.

    Components of the doubled graph, in which an edge ties equal sides when its orientations
    agree and opposite sides otherwise, give each node its sign against the least node of its
    component. conflict: both signs of a node meet, so no labelling satisfies all edges.
    """
    side = lambda v, s: F.col(v) * 2 + s
    turn = F.when(F.col("same_ori"), 0).otherwise(1)
    doubled = edges.select(side("v1", F.lit(0)).alias("u"), side("v2", turn).alias("v")).union(edges.select(side("v1", F.lit(1)).alias("u"), side("v2", 1 - turn).alias("v")))
    c = connected_components(doubled)
    plus = c.where("node % 2 = 0").select(F.expr("node div 2").alias("node"), F.col("component").alias("p"))
    minus = c.where("node % 2 = 1").select(F.expr("node div 2").alias("node"), F.col("component").alias("m"))
    both = plus.join(minus, "node")
    return both.select("node", F.expr("least(p, m) div 2").alias("component"), (F.col("p") > F.col("m")).alias("flipped"), (F.col("p") == F.col("m")).alias("conflict"))


def spanning_labels(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component, flipped): labels along a forest of the best edges (v1, v2, same_ori, score).

    Where no labelling satisfies all edges, the better edges decide: in each round every tree
    takes its best edge to another tree, equal scores in order of the ends, and labels follow
    the trees. About log(n) rounds; edges that disagree with the labels are the ones to drop.
    """
    own = cut(edges.select(F.struct("score", (-F.least("v1", "v2")).alias("a"), (-F.greatest("v1", "v2")).alias("b"), "same_ori").alias("e"), "v1", "v2", "same_ori").where("v1 <> v2"))
    nodes = cut(own.select(F.col("v1").alias("node")).unionAll(own.select("v2")).distinct())
    labels = nodes.select("node", F.col("node").alias("component"), F.lit(False).alias("flipped"))
    forest: list[DataFrame] = []
    for _ in range(rounds):
        c = labels.select("node", "component")
        cross = cut(own.join(c.withColumnsRenamed({"node": "v1", "component": "c1"}), "v1").join(c.withColumnsRenamed({"node": "v2", "component": "c2"}), "v2").where("c1 <> c2"))
        if cross.isEmpty():
            return labels
        best = cross.select(F.col("c1").alias("c"), "e").unionAll(cross.select("c2", "e")).groupBy("c").agg(F.max("e").alias("e"))
        forest.append(cut(best.select((-F.col("e.a")).alias("v1"), (-F.col("e.b")).alias("v2"), F.col("e.same_ori").alias("same_ori")).distinct()))
        tree = own.sparkSession.read.schema(forest[0].schema).parquet(*(f._cut_path for f in forest)).distinct()
        found = orientation_labels(tree).select("node", "component", "flipped")
        alone = nodes.join(found, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(False).alias("flipped"))
        labels = cut(found.unionAll(alone))
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


#: Rounds after which a greedy loop gives the rest, if it has at most REST_ROWS rows, to one pass in order.
ROUNDS, REST_ROWS = 12, 1 << 20


def _matched_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    used: set[int] = set()
    out = []
    for a, b in pdf.sort_values(["v1", "rank", "v2"])[["v1", "v2"]].itertuples(index=False):
        if a not in used and b not in used:
            used.update((a, b))
            out.append((a, b))
    return pd.DataFrame(out, columns=["v1", "v2"], dtype=np.int64)


def greedy_matching(edges: DataFrame) -> DataFrame:
    """(v1, v2) of the matching that takes edges in order (v1, rank) whenever both ends are free.

    Each round takes the edges that come first at both their ends, which the sequential pass
    would take too, and drops all edges at the ends of those. Chains of edges in increasing
    order would take a round for each; so after ROUNDS the rest, once it is small, is matched in
    order, each of its components on its own.
    """
    now = cut(edges.select("v1", "v2", "rank"))
    taken, step = [], 0
    while not now.isEmpty():
        step += 1
        if step > ROUNDS and now.count() <= REST_ROWS:
            named = connected_components(now.select(F.col("v1").alias("u"), F.col("v2").alias("v")))
            rest = now.join(named.withColumnRenamed("node", "v1"), "v1")
            taken.append(cut(rest.groupBy("component").applyInPandas(_matched_in_order, "v1 long, v2 long")))
            break
        order = F.struct("v1", "rank", "v2")
        ends = now.select(F.col("v1").alias("x"), order.alias("o")).union(now.select(F.col("v2").alias("x"), order.alias("o")))
        first = ends.groupBy("x").agg(F.min("o").alias("o"))
        a = first.select(F.col("x").alias("v1"), F.col("o").alias("oa"))
        b = first.select(F.col("x").alias("v2"), F.col("o").alias("ob"))
        won = cut(now.join(a, "v1").join(b, "v2").where((F.col("oa") == F.struct("v1", "rank", "v2")) & (F.col("ob") == F.struct("v1", "rank", "v2"))).select("v1", "v2"))
        taken.append(won)
        gone = won.select(F.explode(F.array("v1", "v2")).alias("x")).distinct()
        old, now = now, cut(now.join(gone.withColumnRenamed("x", "v1"), "v1", "left_anti").join(gone.withColumnRenamed("x", "v2"), "v2", "left_anti").select("v1", "v2", "rank"))
        discard(old)
    return _together(taken, edges.select("v1", "v2"))


def _together(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    """The rows of all parts, read in one scan of their folders."""
    paths = [p._cut_path for p in parts]
    return like.sparkSession.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def _cliques_of_root(pdf: pd.DataFrame) -> Iterator[tuple[int, list[int]]]:
    """Maximal cliques that have the root as their first vertex in the order."""
    root = int(pdf["root"].iloc[0])
    near: dict[int, set[int]] = {}
    for a, b in zip(pdf["a"], pdf["b"]):
        near.setdefault(int(a), set()).add(int(b))
        near.setdefault(int(b), set()).add(int(a))
    later = {int(x) for x, l in zip(pdf["a"], pdf["a_later"]) if l} | {int(x) for x, l in zip(pdf["b"], pdf["b_later"]) if l}
    earlier = ({int(x) for x in pdf["a"]} | {int(x) for x in pdf["b"]}) - later - {root}
    later.discard(root)
    stack = [([root], later & near.get(root, set()), earlier & near.get(root, set()))]
    while stack:
        clique, p, x = stack.pop()
        if not p:
            if not x:
                yield root, sorted(clique)
            continue
        pivot = max(p | x, key=lambda v: (len(near[v] & p), -v))
        for v in sorted(p - near[pivot]):
            stack.append(([*clique, v], p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """(members): the maximal cliques of undirected edges (u, v), u < v, of two or more vertices.

    Vertices are ordered by (degree, id). Each root gets the edges among its neighbours and
    itself, which the triangles through it give, and searches alone with pivoting: later
    neighbours extend it, earlier ones only rule cliques out. Work is split by root, and low
    degrees come first, so a hub's search covers its higher neighbours alone.
    """
    e = edges.select("u", "v").distinct()
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    key = F.struct("d", "x")
    own = both.join(degree, "u").select(F.col("u").alias("x"), F.col("v"), "d").select(F.col("x"), "v", key.alias("kx"))
    own = own.join(degree.select(F.col("u").alias("v"), F.struct("d", F.col("u").alias("x")).alias("kv")), "v")
    star = own.select(F.col("x").alias("root"), F.col("x").alias("a"), F.col("v").alias("b"), F.lit(True).alias("a_later"), (F.col("kv") > F.col("kx")).alias("b_later"))
    arm = own.select(F.col("x").alias("root"), F.col("v"), (F.col("kv") > F.col("kx")).alias("later"))
    wedge = arm.select("root", F.col("v").alias("a"), F.col("later").alias("a_later")).join(arm.select("root", F.col("v").alias("b"), F.col("later").alias("b_later")), "root").where("a < b")
    triangle = wedge.join(e.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"])
    rows = star.unionByName(triangle.select("root", "a", "b", "a_later", "b_later"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(m,) for _, m in _cliques_of_root(pdf)], columns=["members"])

    return rows.groupBy("root").applyInPandas(search, "members array<long>")


def verify_cliques(cliques: DataFrame, edges: DataFrame) -> DataFrame:
    """(members, is_clique, is_maximal): pairs within are edges, and no other vertex sees all members."""
    named = cliques.withColumn("id", F.xxhash64("members"))
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    flat = named.select("id", F.size("members").alias("n"), F.explode("members").alias("u"))
    seen = flat.join(both, "u").groupBy("id", "n", "v").agg(F.count("*").alias("k"))
    inside = flat.select("id", F.col("u").alias("v"), F.lit(True).alias("inside"))
    seen = seen.join(inside, ["id", "v"], "left")
    facts = seen.groupBy("id", "n").agg(F.sum(F.when(F.col("inside") & (F.col("k") == F.col("n") - 1), 1).otherwise(0)).alias("full"), F.max(F.when(F.col("inside").isNull() & (F.col("k") == F.col("n")), 1).otherwise(0)).alias("more"))
    return named.join(facts, "id").select("members", (F.col("full") == F.col("n")).alias("is_clique"), (F.col("more") == 0).alias("is_maximal"))


def _feedback(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges to a vertex on the current path, in a search from vertices by (indegree, id)."""
    out: dict[int, list[int]] = {}
    indegree: dict[int, int] = {}
    for u, v in zip(pdf["u"], pdf["v"]):
        out.setdefault(int(u), []).append(int(v))
        out.setdefault(int(v), [])
        indegree[int(v)] = indegree.get(int(v), 0) + 1
        indegree.setdefault(int(u), 0)
    state: dict[int, int] = {}
    back = []
    for start in sorted(out, key=lambda v: (indegree[v], v)):
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(sorted(out[start])))]
        while stack:
            u, rest = stack[-1]
            for v in rest:
                if v not in state:
                    state[v] = 1
                    stack.append((v, iter(sorted(out[v]))))
                    break
                if state[v] == 1:
                    back.append((u, v))
            else:
                state[u] = 2
                stack.pop()
    return pd.DataFrame(back, columns=["u", "v"], dtype=np.int64)


def back_edges(core: DataFrame) -> DataFrame:
    """Edges (u, v) whose removal leaves the cyclic core acyclic, each of its components on its own."""
    c = connected_components(core)
    own = core.join(c.withColumnRenamed("node", "u"), "u")
    return own.groupBy("component").applyInPandas(_feedback, "u long, v long")


def first_choice(pairs: DataFrame) -> DataFrame:
    """The nodes that a pass in order of id keeps when it skips neighbours of kept ones.

    pairs: (node, neighbour), both directions, a null neighbour for a lone node.
    """
    now = cut(pairs.distinct())
    kept, step = [], 0
    while not now.isEmpty():
        step += 1
        if step > ROUNDS and now.count() <= REST_ROWS:
            kept.append(cut(_chosen_in_order(now)))
            break
        least = now.groupBy("node").agg(F.min("neighbour").alias("m"))
        won = cut(least.where("m IS NULL OR node < m").select("node"))
        kept.append(won)
        lost = now.join(won.withColumnRenamed("node", "neighbour"), "neighbour", "left_semi").select("node").distinct()
        gone = won.union(lost)
        left = now.join(gone, "node", "left_anti")
        names = left.select("node").distinct()
        edges = left.join(gone.withColumnRenamed("node", "neighbour"), "neighbour", "left_anti").select("node", "neighbour")
        old, now = now, cut(names.join(edges, "node", "left").select("node", "neighbour").distinct())
        discard(old)
    return _together(kept, pairs.select("node"))


def _chosen_in_order(pairs: DataFrame) -> DataFrame:
    """first_choice of a small rest in one pass, in one task."""
    kind = dict(pairs.dtypes)["node"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["node"], pdf["neighbour"]):
            near.setdefault(a, []).append(b)
        out: set = set()
        for node in sorted(near):
            if not any(b in out for b in near[node] if b != node):
                out.add(node)
        return pd.DataFrame({"node": sorted(out)})

    whole = pairs.select(F.lit(0).alias("all"), "node", F.coalesce("neighbour", "node").alias("neighbour"))  # a lone node, without nulls
    return whole.groupBy("all").applyInPandas(choose, f"node {kind}")


def ranked(edges: DataFrame) -> DataFrame:
    """Adds rank: a vertex's out-edges by v2."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("v1").orderBy("v2")))
