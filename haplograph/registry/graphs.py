"""Graph rewrites, fix-points and evidence at branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import arcs, edges, graph, links, mixed, reads, scored, table, with_tables
from ..operators import evidence, fixpoint
from ..operators import graph as G
from ..session import cut
from . import query
from .scalars import _POS34, _reversed

_HOP = "SELECT 1 FROM {g} a JOIN {g} b ON b.v1 = a.v2 WHERE a.v1 = e.v1 AND b.v2 = e.v2"
_T1 = f"t1 AS (SELECT e.* FROM graph e WHERE EXISTS ({_HOP.format(g='graph')}))"
_RED = f"red AS (SELECT e.* FROM graph e WHERE NOT EXISTS ({_HOP.format(g='graph')}))"


@query(with_tables("graph", _T1, f"SELECT e.v1, e.v2 FROM t1 e WHERE EXISTS ({_HOP.format(g='t1')})"))
def transitive_k2(spark, sf):
    return G.transitive_of_order(graph(spark, sf), 2).select("v1", "v2")


@query(with_tables("graph", _T1, "SELECT DISTINCT g.v1, g.v2 FROM graph g JOIN t1 t ON (t.v1 = g.v1 OR t.v2 = g.v2) AND g.len <= t.len"))
def weak_branch_edges(spark, sf):
    return G.weak_branch_edges(graph(spark, sf))


_INCL = "i AS (SELECT id1 AS v1, id2 AS v2, CASE WHEN id2 % 4 = 0 THEN 100 ELSE perc1 END AS perc, 0.0 AS mismatch, pos1, id2 % 5 - 2 AS pos3 FROM mixed), x AS (SELECT DISTINCT CASE WHEN pos3 < 0 AND pos1 = 0 THEN v1 WHEN pos3 >= 0 THEN v2 END AS v FROM i WHERE perc = 100)"


def _inclusions(spark, sf):
    i = mixed(spark, sf).select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), F.expr("IF(id2 % 4 = 0, 100, perc1)").alias("perc"), F.lit(0.0).alias("mismatch"), "pos1", F.expr("id2 % 5 - 2").alias("pos3"))
    return G.inclusion_vertices(i)


@query(with_tables("mixed", _INCL, "SELECT v FROM x WHERE v IS NOT NULL"))
def inclusion_vertices(spark, sf):
    return _inclusions(spark, sf)


@query(with_tables("mixed graph", _INCL, "SELECT v1, v2 FROM graph g WHERE NOT EXISTS (SELECT 1 FROM x WHERE v = g.v1 OR v = g.v2)"))
def remove_inclusions(spark, sf):
    return G.remove_vertices(graph(spark, sf), _inclusions(spark, sf)).select("v1", "v2")


_TIPS = """e AS (SELECT u AS v1, v AS v2, (u * 3 + v) % 20 AS ef, (u + v * 5) % 20 AS eb FROM arcs WHERE u < v),
    o AS (SELECT e.*, count(*) OVER (PARTITION BY v1) AS n, v2 IN (SELECT v1 FROM e) AS alive FROM e), o2 AS (SELECT *, max(CASE WHEN alive THEN 1 ELSE 0 END) OVER (PARTITION BY v1) AS lively FROM o),
    p AS (SELECT e.*, count(*) OVER (PARTITION BY v2) AS n, v1 IN (SELECT v2 FROM e) AS alive FROM e), p2 AS (SELECT *, max(CASE WHEN alive THEN 1 ELSE 0 END) OVER (PARTITION BY v2) AS lively FROM p)"""


@query(with_tables("arcs", _TIPS, "SELECT v2 AS v FROM o2 WHERE n >= 2 AND NOT alive AND (ef = 0 OR (ef < 12 AND lively = 1)) UNION SELECT v1 FROM p2 WHERE n >= 2 AND NOT alive AND (eb = 0 OR (eb < 12 AND lively = 1))"))
def tips(spark, sf):
    e = arcs(spark, sf).where("u < v")
    return G.tips(e.select(F.col("u").alias("v1"), F.col("v").alias("v2"), F.expr("(u * 3 + v) % 20").alias("ext_fwd"), F.expr("(u + v * 5) % 20").alias("ext_back")), 12)


@query(with_tables("graph", _RED, "SELECT v1 AS v, 'out' AS side FROM red GROUP BY v1 HAVING count(*) > 1 UNION ALL SELECT v2, 'in' FROM red GROUP BY v2 HAVING count(*) > 1"))
def branch_vertices(spark, sf):
    return G.branch_vertices(G.transitive_reduction(graph(spark, sf)))


@query(with_tables("graph", _RED + """, core AS (SELECT * FROM red WHERE v1 NOT IN (SELECT v1 FROM red GROUP BY v1 HAVING count(*) > 1) AND v2 NOT IN (SELECT v2 FROM red GROUP BY v2 HAVING count(*) > 1)),
    s AS (SELECT v1 AS u, v2 AS v FROM core UNION SELECT v2, v1 FROM core), r AS (SELECT u AS node, u AS l FROM s UNION SELECT s.v, r.l FROM r JOIN s ON s.u = r.node), c AS (SELECT node, min(l) AS component FROM r GROUP BY node)""",
    "SELECT g.v1, g.v2 FROM graph g LEFT JOIN c a ON a.node = v1 LEFT JOIN c b ON b.node = v2 WHERE coalesce(a.component, v1) = coalesce(b.component, v2)"))
def remove_branches(spark, sf):
    return G.remove_branches(fixpoint.cut(graph(spark, sf)), fixpoint.connected_components).select("v1", "v2")


@query(with_tables("edges", "red AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges a JOIN edges b ON b.v1 = a.v2 WHERE a.v1 = e.v1 AND b.v2 = e.v2)), s AS (SELECT v1 AS u, v2 AS v FROM red UNION SELECT v2, v1 FROM red), r AS (SELECT u AS node, u AS l FROM s UNION SELECT s.v, r.l FROM r JOIN s ON s.u = r.node)",
    "SELECT node, min(l) AS component FROM r GROUP BY node"))
def connected_components(spark, sf):
    e = fixpoint.cut(edges(spark, sf))
    return fixpoint.connected_components(G.transitive_reduction(e).select(F.col("v1").alias("u"), F.col("v2").alias("v")))


@query(with_tables("graph", "", "SELECT DISTINCT v1, v2, pos FROM graph WHERE v1 % 10 = 3"))
def edge_lookup(spark, sf):
    wanted = graph(spark, sf).select("v1").where("v1 % 10 = 3").distinct()
    return graph(spark, sf).join(wanted, "v1", "left_semi").select("v1", "v2", "pos")


@query(with_tables("graph", "d AS (SELECT v1, v2 FROM graph UNION ALL SELECT v1, v2 FROM graph WHERE (v1 + v2) % 13 = 0)", "SELECT v1, v2, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1"))
def dup_edges(spark, sf):
    g = graph(spark, sf).select("v1", "v2")
    return g.union(g.where("(v1 + v2) % 13 = 0")).groupBy("v1", "v2").agg(F.count("*").alias("n")).where("n > 1")


@query(with_tables("graph", _T1, "SELECT v1, v2, pos, len FROM graph EXCEPT SELECT v1, v2, pos, len FROM t1"))
def edge_removal(spark, sf):
    g = cut(graph(spark, sf))
    return G.without(g, G.transitive_edges(g)).select("v1", "v2", "pos", "len")


# ---- orientation -----------------------------------------------------------------------------

#: Every third read is stored reversed: an edge's orientations agree when both or neither are.
_SIGNS = "so AS (SELECT v1, v2, (v1 % 3 = 0) = (v2 % 3 = 0) AS same FROM graph)"


@query(with_tables("graph", _SIGNS + """, s AS (SELECT v1 AS u, v2 AS v, same FROM so UNION SELECT v2, v1, same FROM so), w AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, w.root FROM w JOIN s ON s.u = w.node), c AS (SELECT node, min(root) AS component FROM w GROUP BY node)""",
    "SELECT node, component, (node % 3 = 0) <> (component % 3 = 0) AS flipped, false AS conflict FROM c"))
def orientation_labels(spark, sf):
    e = graph(spark, sf).select("v1", "v2", F.expr("(v1 % 3 = 0) = (v2 % 3 = 0)").alias("same_ori"))
    return fixpoint.orientation_labels(e)


@query(with_tables("links", """s AS (SELECT u, v, (u + v) % 2 AS d FROM links WHERE (u + v) % 5 <> 0 UNION ALL SELECT v, u, (u + v) % 2 FROM links WHERE (u + v) % 5 <> 0 UNION ALL SELECT u, v, 1 - (u + v) % 2 FROM links WHERE (u + v) % 5 = 0 UNION ALL SELECT v, u, 1 - (u + v) % 2 FROM links WHERE (u + v) % 5 = 0),
    w AS (SELECT u AS node, u AS root, 0 AS p FROM s UNION SELECT s.v, w.root, (w.p + s.d) % 2 FROM w JOIN s ON s.u = w.node)""",
    "SELECT node, count(DISTINCT p) > 1 AS conflict FROM w WHERE root = node GROUP BY node"))
def orientation_conflicts(spark, sf):
    e = links(spark, sf).select(F.col("u").alias("v1"), F.col("v").alias("v2"), F.expr("IF((u + v) % 5 = 0, (u + v) % 2 = 1, (u + v) % 2 = 0)").alias("same_ori"))
    return fixpoint.orientation_labels(e).select("node", "conflict")


@query(with_tables("mixed", _POS34 + """, e AS (SELECT id1 AS v1, id2 AS v2, pos1, pos3, ori1 = '+' AS o1, ori2 = '+' AS o2 FROM rev)""",
    """SELECT CASE WHEN o1 THEN v1 ELSE v1 + 100000 END AS v1, CASE WHEN o2 THEN v2 ELSE v2 + 100000 END AS v2, CAST(pos1 AS BIGINT) AS pos FROM e
    UNION SELECT CASE WHEN pos3 < 0 THEN CASE WHEN o2 THEN v2 + 100000 ELSE v2 END ELSE CASE WHEN o1 THEN v1 + 100000 ELSE v1 END END, CASE WHEN pos3 < 0 THEN CASE WHEN o1 THEN v1 + 100000 ELSE v1 END ELSE CASE WHEN o2 THEN v2 + 100000 ELSE v2 END END, CAST(abs(pos3) AS BIGINT) FROM e"""))  # fmt: skip
def equivalent_edges(spark, sf):
    e = _reversed(spark, sf).select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), "pos1", "pos3", (F.col("ori1") == "+").alias("ori1"), (F.col("ori2") == "+").alias("ori2"))
    return G.equivalent_edges(e, 100000).withColumn("pos", F.col("pos").cast("long"))


# ---- orders and counts -----------------------------------------------------------------------


@query(with_tables("graph", "", "SELECT v1, v2, CAST(row_number() OVER (PARTITION BY v1 ORDER BY 120 - 2 * len, v2) - 1 AS BIGINT) AS rank FROM graph"))
def adjacency_rank(spark, sf):
    return G.adjacency_rank(graph(spark, sf).withColumn("nonoverlap", 120 - 2 * F.col("len"))).select("v1", "v2", "rank")


@query(with_tables("graph", "d AS (SELECT v1 AS v, 0 AS d FROM graph UNION ALL SELECT v2, 1 FROM graph)", "SELECT v, CAST(sum(d) AS BIGINT) AS indegree FROM d GROUP BY v ORDER BY indegree, v"))
def indegree_order(spark, sf):
    return G.indegrees(graph(spark, sf)).orderBy("indegree", "v")


@query(with_tables("scored", "", """SELECT id1 AS v1, id2 AS v2, row_number() OVER (PARTITION BY id1 ORDER BY pos, id2) AS by_pos, row_number() OVER (PARTITION BY id1 ORDER BY round(score, 6) DESC, id2) AS by_score,
    row_number() OVER (PARTITION BY id1 ORDER BY len DESC, id2) AS by_len, row_number() OVER (PARTITION BY id1 ORDER BY round(mismatch, 6), id2) AS by_mismatch FROM scored"""))  # fmt: skip
def neighbor_rankings(spark, sf):
    s = scored(spark, sf).select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), "pos", "len", F.round("score", 6).alias("score"), F.round("mismatch", 6).alias("mismatch"))
    return G.neighbor_rankings(s).select("v1", "v2", "by_pos", "by_score", "by_len", "by_mismatch")


@query(with_tables("graph", "", "SELECT v1 AS u, v2 AS v FROM graph UNION SELECT v2, v1 FROM graph"))
def symmetrize_edges(spark, sf):
    return G.symmetrized(graph(spark, sf))


@query(with_tables("links", "s AS (SELECT u, v FROM links UNION SELECT v, u FROM links)", "SELECT u, string_agg(v, ' ' ORDER BY v) AS neighbours FROM s GROUP BY u"))
def adjacency_lists(spark, sf):
    return G.adjacency_lists(links(spark, sf)).select("u", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(with_tables("links", "n AS (SELECT u AS x FROM links UNION SELECT v FROM links)", "SELECT a.x AS u, b.x AS v FROM n a JOIN n b ON a.x < b.x WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.u = a.x AND l.v = b.x)"))
def graph_complement(spark, sf):
    e = links(spark, sf)
    return G.complement(e, e.select(F.col("u").alias("v")).union(e.select("v")).distinct())


@query(with_tables("links", "s AS (SELECT u, v FROM links UNION SELECT v, u FROM links), d AS (SELECT u, count(*) AS d FROM s GROUP BY u)", "SELECT count(*) AS n, CAST(sum(d) / 2 AS BIGINT) AS m, max(d) AS max_degree FROM d"))
def graph_stats(spark, sf):
    return G.graph_stats(links(spark, sf))


def _peel(rounds: int, k: int) -> str:
    """CTEs that drop vertices of degree under k, round after round."""
    out, last = [], "links"
    for i in range(rounds):
        out.append(f"x{i} AS (SELECT x FROM (SELECT u AS x FROM {last} UNION ALL SELECT v FROM {last}) GROUP BY x HAVING count(*) >= {k}), c{i} AS (SELECT u, v FROM {last} WHERE u IN (SELECT x FROM x{i}) AND v IN (SELECT x FROM x{i}))")
        last = f"c{i}"
    return ", ".join(out)


@query(with_tables("links", _peel(12, 3), "SELECT u, v FROM c11"))
def kcore(spark, sf):
    return G.kcore(links(spark, sf), 3, fixpoint.cut)


@query()
def degeneracy(spark, sf):
    return spark.createDataFrame([(G.degeneracy(links(spark, sf), fixpoint.cut),)], "degeneracy int")


@query(with_tables("arcs", "r AS (SELECT u AS a, v AS b FROM arcs UNION SELECT r.a, arcs.v FROM r JOIN arcs ON arcs.u = r.b), cyc AS (SELECT a FROM r WHERE a = b)",
    "SELECT u, v FROM arcs WHERE (u IN (SELECT a FROM cyc) OR EXISTS (SELECT 1 FROM r WHERE r.b = arcs.u AND r.a IN (SELECT a FROM cyc))) AND (v IN (SELECT a FROM cyc) OR EXISTS (SELECT 1 FROM r WHERE r.a = arcs.v AND r.b IN (SELECT a FROM cyc)))"))
def cyclic_core(spark, sf):
    return G.cyclic_core(arcs(spark, sf), fixpoint.cut)


@query()
def back_edges(spark, sf):
    return fixpoint.back_edges(G.cyclic_core(arcs(spark, sf), fixpoint.cut))


_GROW = """s AS (SELECT u, v FROM links UNION SELECT v, u FROM links), grow AS (SELECT [u, v] AS m FROM links UNION ALL
    SELECT list_append(g.m, s.v) FROM grow g JOIN s ON s.u = g.m[len(g.m)] AND s.v > g.m[len(g.m)] WHERE (SELECT count(*) FROM s t WHERE t.v = s.v AND list_contains(g.m, t.u)) = len(g.m))"""
_MAXIMAL = "SELECT m FROM grow g WHERE NOT EXISTS (SELECT 1 FROM s t WHERE list_contains(g.m, t.u) GROUP BY t.v HAVING count(*) = len(g.m))"


@query(with_tables("links", _GROW + f", mx AS ({_MAXIMAL})", "SELECT array_to_string(m, ' ') AS members FROM mx"))
def maximal_cliques(spark, sf):
    return fixpoint.maximal_cliques(fixpoint.cut(links(spark, sf))).select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


@query(with_tables("links", _GROW + f", mx AS ({_MAXIMAL})", "SELECT array_to_string(m, ' ') AS members, true AS is_clique, true AS is_maximal FROM mx"))
def verify_cliques(spark, sf):
    e = fixpoint.cut(links(spark, sf))
    v = fixpoint.verify_cliques(fixpoint.cut(fixpoint.maximal_cliques(e)), e)
    return v.select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "is_clique", "is_maximal")


@query(with_tables("links", _GROW, "SELECT CAST(max(len(m)) AS BIGINT) AS strains FROM grow"))
def strain_count(spark, sf):
    """The lower bound on strains: the largest clique of a conflict graph."""
    return fixpoint.maximal_cliques(fixpoint.cut(links(spark, sf))).agg(F.max(F.size("members")).cast("long").alias("strains"))


@query()
def clique_exclusive(spark, sf):
    """Cliques in order of their members that share no vertex with an earlier kept one."""
    c = fixpoint.cut(fixpoint.maximal_cliques(fixpoint.cut(links(spark, sf))).where(F.size("members") >= 3).withColumn("key", F.array_join(F.transform("members", lambda x: F.lpad(x.cast("string"), 9, "0")), "")))
    flat = c.select("key", F.explode("members").alias("x"))
    near = flat.join(flat.withColumnRenamed("key", "other"), "x").where("key <> other").select(F.col("key").alias("node"), F.col("other").alias("neighbour"))
    lone = c.select(F.col("key").alias("node"), F.lit(None).cast("string").alias("neighbour")).join(near.select("node").distinct(), "node", "left_anti")
    kept = fixpoint.first_choice(near.union(lone))
    return c.join(kept.withColumnRenamed("node", "key"), "key", "left_semi").select("members")


@query()
def greedy_matching(spark, sf):
    e = G.adjacency_rank(G.transitive_reduction(fixpoint.cut(graph(spark, sf))).withColumn("nonoverlap", 120 - 2 * F.col("len")))
    return fixpoint.greedy_matching(e)


# ---- branch evidence -------------------------------------------------------------------------

_BR = _RED + """, bo AS (SELECT v1 FROM red GROUP BY v1 HAVING count(*) > 1), bi AS (SELECT v2 FROM red GROUP BY v2 HAVING count(*) > 1),
    br AS (SELECT v1 AS branch, 'out' AS side, v1, v2 FROM red WHERE v1 IN (SELECT v1 FROM bo) UNION ALL SELECT v2, 'in', v1, v2 FROM red WHERE v2 IN (SELECT v2 FROM bi))"""


def _branches(spark, sf):
    return evidence.branches(fixpoint.cut(G.transitive_reduction(graph(spark, sf))))


@query(with_tables("graph", _BR + """, k AS (SELECT *, branch * 2 + CASE WHEN side = 'in' THEN 1 ELSE 0 END AS key FROM br), l AS (SELECT a.key AS u, b.key AS v FROM k a JOIN k b ON a.v1 = b.v1 AND a.v2 = b.v2 AND a.side = 'out' AND b.side = 'in'),
    s AS (SELECT u, v FROM l UNION SELECT v, u FROM l UNION SELECT key, key FROM k), w AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, w.root FROM w JOIN s ON s.u = w.node), c AS (SELECT node, min(root) AS component FROM w GROUP BY node)""",
    "SELECT DISTINCT branch, side, component FROM k JOIN c ON c.node = key"))
def branch_components(spark, sf):
    return evidence.branch_components(_branches(spark, sf), fixpoint.connected_components)


_NB = """, nb AS (SELECT branch, g.v2, g.pos, r.seq FROM br JOIN graph g ON g.v1 = branch AND g.v2 = br.v2 JOIN reads r ON r.read_id = g.v2 WHERE side = 'out')"""
_DF = _NB + """, df AS (SELECT DISTINCT branch, p AS place FROM (SELECT x.branch, x.pos AS px, x.seq AS sx, y.pos AS py, y.seq AS sy, unnest(range(greatest(x.pos, y.pos), least(x.pos, y.pos) + 60)) AS p FROM nb x JOIN nb y ON x.branch = y.branch AND x.v2 < y.v2)
    WHERE substr(sx, p - px + 1, 1) <> substr(sy, p - py + 1, 1))"""


def _diffs(spark, sf):
    b = fixpoint.cut(_branches(spark, sf).where("side = 'out'"))
    return b, evidence.branch_diffs(b, reads(spark, sf), graph(spark, sf))


@query(with_tables("graph", _BR + _DF, "SELECT branch, place FROM df"))
def branch_diffs(spark, sf):
    return _diffs(spark, sf)[1].withColumnRenamed("at", "place")


@query(with_tables("graph", _BR + _DF, "SELECT branch, round(0.5 * (min(place) + max(place)), 6) AS distance FROM df GROUP BY branch"))
def variation_distance(spark, sf):
    return _diffs(spark, sf)[1].groupBy("branch").agg(F.round((F.min("at") + F.max("at")) * 0.5, 6).alias("distance"))


_EV = _DF + """, cand AS (SELECT nb.branch, nb.v2, nb.pos, nb.seq, r.read_id, r.start - b.start AS pr, r.seq AS sr FROM nb JOIN reads b ON b.read_id = nb.branch JOIN reads r ON r.start BETWEEN b.start AND b.start + 40),
    hits AS (SELECT cand.branch, v2, read_id, min(CASE WHEN substr(seq, place - pos + 1, 1) = substr(sr, place - pr + 1, 1) THEN 1 ELSE 0 END) AS ok FROM cand JOIN df ON df.branch = cand.branch WHERE place >= pr AND place < pr + 60 AND place >= pos AND place < pos + 60 GROUP BY 1, 2, 3),
    ev AS (SELECT branch, v2, read_id FROM hits WHERE ok = 1)"""


def _evidence(spark, sf):
    from ..operators import joins

    b, diffs = _diffs(spark, sf)
    r = reads(spark, sf)
    nb = b.select("branch", "v2").join(graph(spark, sf).select(F.col("v1").alias("branch"), "v2", "pos"), ["branch", "v2"]).join(r.select(F.col("read_id").alias("v2"), "seq"), "v2")
    placed = b.select("branch").distinct().join(r.select(F.col("read_id").alias("branch"), F.col("start").alias("s0")), "branch")
    near = joins.binned_range_join(placed, r.select("read_id", F.col("start").alias("s1"), F.col("seq").alias("seq_r")), F.col("s0"), F.col("s0") + 40, F.col("s1"), 41)
    cand = nb.select("branch", "v2").join(near.select("branch", "read_id", (F.col("s1") - F.col("s0")).alias("pos_r"), "seq_r"), "branch")
    return evidence.supported(diffs, nb, cand)


@query(with_tables("graph", _BR + _EV, "SELECT branch, v2, read_id FROM ev"))
def branch_evidence(spark, sf):
    return _evidence(spark, sf)


@query(with_tables("graph", _BR + _EV, "SELECT branch, v2, count(*) AS n FROM ev GROUP BY 1, 2"))
def read_evidence(spark, sf):
    return _evidence(spark, sf).groupBy("branch", "v2").agg(F.count("*").alias("n"))


@query(with_tables("graph", _BR + _EV, "SELECT read_id FROM ev WHERE branch % 2 = 0 INTERSECT SELECT read_id FROM ev WHERE branch % 2 = 1"))
def evidence_intersect(spark, sf):
    """Reads that are evidence at branches of either kind."""
    e = fixpoint.cut(_evidence(spark, sf))
    return e.where("branch % 2 = 0").select("read_id").intersect(e.where("branch % 2 = 1").select("read_id"))


_UNIQ = """, one AS (SELECT branch, read_id FROM ev GROUP BY 1, 2 HAVING count(DISTINCT v2) = 1), named AS (SELECT DISTINCT branch, v2 FROM ev),
    sup AS (SELECT n.branch AS component, n.branch AS v1, n.v2, count(DISTINCT o.read_id) AS support FROM named n LEFT JOIN ev e ON e.branch = n.branch AND e.v2 = n.v2 LEFT JOIN one o ON o.branch = e.branch AND o.read_id = e.read_id GROUP BY ALL)"""


def _support(spark, sf):
    return evidence.unique_evidence(_evidence(spark, sf).select(F.col("branch").alias("component"), F.col("branch").alias("v1"), "v2", "read_id"))


@query(with_tables("graph", _BR + _EV + _UNIQ, "SELECT component, v1, v2, support FROM sup"))
def unique_evidence(spark, sf):
    return _support(spark, sf)


def _distances(spark, sf):
    return _diffs(spark, sf)[1].groupBy(F.col("branch").alias("component")).agg(F.round((F.min("at") + F.max("at")) * 0.5 + 0.0000001).cast("long").alias("dist"))


def _thresholds(spark):
    return spark.range(50).select(F.col("id").alias("dist"), F.expr("1 + id div 20").alias("min_ev"))


_THR = ", thr AS (SELECT d AS dist, CAST(1 + d // 20 AS BIGINT) AS min_ev FROM (SELECT unnest(range(0, 50)) AS d)), dst AS (SELECT branch AS component, CAST(round(0.5 * (min(place) + max(place)) + 0.0000001) AS BIGINT) AS dist FROM df GROUP BY branch)"


@query(with_tables("graph", _BR + _DF + _THR, "SELECT component, dist, coalesce(min_ev, -1) AS min_ev FROM dst LEFT JOIN thr USING (dist)"))
def threshold_lookup(spark, sf):
    return _distances(spark, sf).join(F.broadcast(_thresholds(spark)), "dist", "left").select("component", "dist", F.coalesce("min_ev", F.lit(-1).cast("long")).alias("min_ev"))


@query(with_tables("graph", _BR + _EV + _UNIQ + _THR, "SELECT component, v1, v2, CASE WHEN min_ev IS NULL THEN 'skip' WHEN support < min_ev THEN 'remove' ELSE 'keep' END AS verdict FROM sup JOIN dst USING (component) LEFT JOIN thr USING (dist)"))
def branch_resolve(spark, sf):
    return evidence.resolve(_support(spark, sf), _distances(spark, sf), F.broadcast(_thresholds(spark)))


_DOUBLE = """e AS (SELECT l_partkey AS u, 100000000 + l_orderkey AS v, count(*) AS n FROM (SELECT l_partkey % 400 AS l_partkey, l_orderkey % 400 AS l_orderkey FROM lineitem) GROUP BY ALL),
    s AS (SELECT (u // 2) * 1000 + (v // 2) % 1000 AS component, u AS v1, v AS v2, (n * 5 + u + 3 * v) % 7 * 2 AS support FROM e),
    b AS (SELECT component, arg_max(v1, support * 1000000000000 - v1 * 1000 - v2 % 1000) AS b1, arg_max(v2, support * 1000000000000 - v1 * 1000 - v2 % 1000) AS b2, max(support) AS most FROM s GROUP BY 1 HAVING count(*) IN (3, 4) AND count(DISTINCT v1) = 2 AND count(DISTINCT v2) = 2 AND max(support) > 0),
    r AS (SELECT s.*, most, (v1 = b1) <> (v2 = b2) AS rival FROM s JOIN b USING (component)),
    l AS (SELECT component, count(*) FILTER (support > 0) AS supported, coalesce(sum(support) FILTER (rival), 0) AS rivals, coalesce(sum(support) FILTER (NOT rival), 0) AS own FROM r GROUP BY 1)"""


@query("WITH " + _DOUBLE + """ SELECT component, v1, v2 FROM r JOIN l USING (component)
    WHERE CASE WHEN supported = 2 AND rivals > 0 AND most - rivals <= 4 THEN support = 0 WHEN supported > 2 AND rivals > own THEN NOT rival ELSE rival END""")  # fmt: skip
def diploid_branch(spark, sf):
    """Verdicts on double branches, with a margin for two supported edges that share an end."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 400).alias("u"), (100000000 + F.col("l_orderkey") % 400).alias("v"))
    e = rows.groupBy("u", "v").agg(F.count("*").alias("n"))
    s = e.select(F.expr("u div 2 * 1000 + (v div 2) % 1000").alias("component"), F.col("u").alias("v1"), F.col("v").alias("v2"), F.expr("(n * 5 + u + 3 * v) % 7 * 2").alias("support"))
    return evidence.diploid_removals(s, min_evidence=8)
