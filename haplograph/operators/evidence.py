"""Read evidence at branches of the graph."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def branches(edges: DataFrame) -> DataFrame:
    """(branch, side, v1, v2): edges at vertices with several out-edges or several in-edges."""
    out = edges.groupBy("v1").agg(F.count("*").alias("n")).where("n > 1").select("v1")
    into = edges.groupBy("v2").agg(F.count("*").alias("n")).where("n > 1").select("v2")
    a = edges.join(out, "v1", "left_semi").select(F.col("v1").alias("branch"), F.lit("out").alias("side"), "v1", "v2")
    b = edges.join(into, "v2", "left_semi").select(F.col("v2").alias("branch"), F.lit("in").alias("side"), "v1", "v2")
    return a.union(b)


def branch_components(rows: DataFrame, components) -> DataFrame:
    """(branch, side, component): out- and in-branches that share an edge belong together. The component is its least 2 * vertex + (1 for in)."""
    key = F.col("branch") * 2 + F.when(F.col("side") == "in", 1).otherwise(0)
    named = rows.withColumn("key", key)
    a = named.where("side = 'out'").select("v1", "v2", F.col("key").alias("u"))
    b = named.where("side = 'in'").select("v1", "v2", F.col("key").alias("v"))
    c = components(a.join(b, ["v1", "v2"]).select("u", "v"))
    return named.select("branch", "side", "key").distinct().join(c.withColumnRenamed("node", "key"), "key", "left").select("branch", "side", F.coalesce("component", "key").alias("component"))


def branch_diffs(rows: DataFrame, reads: DataFrame, pos: DataFrame, most: int = 100) -> DataFrame:
    """(branch, at): places, in the branch vertex's frame, at which two out-neighbours differ.

    rows (branch, v2), pos (v1, v2, pos), reads (read_id, seq). At most `most` for each pair.
    """
    n = rows.select("branch", "v2").join(pos.select(F.col("v1").alias("branch"), "v2", "pos"), ["branch", "v2"]).join(reads.select(F.col("read_id").alias("v2"), "seq"), "v2")
    a = n.select("branch", F.col("v2").alias("x"), F.col("pos").alias("px"), F.col("seq").alias("sx"))
    b = n.select("branch", F.col("v2").alias("y"), F.col("pos").alias("py"), F.col("seq").alias("sy"))
    both = a.join(b, "branch").where("x < y")
    low, high = F.greatest("px", "py"), F.least(F.col("px") + F.length("sx"), F.col("py") + F.length("sy"))
    places = "slice(filter(sequence(lo, hi - 1), p -> substring(sx, CAST(p - px + 1 AS INT), 1) <> substring(sy, CAST(p - py + 1 AS INT), 1)), 1, %d)" % most
    both = both.withColumns({"lo": low, "hi": high}).where("lo < hi")
    return both.select("branch", F.explode(F.expr(places)).alias("at")).distinct()


def supported(diffs: DataFrame, neighbours: DataFrame, candidates: DataFrame) -> DataFrame:
    """(branch, v2, read_id): reads that agree with a neighbour at every covered difference, and cover one.

    diffs (branch, at); neighbours (branch, v2, pos, seq); candidates (branch, v2, read_id, pos_r, seq_r), all in the branch's frame.
    """
    j = candidates.join(neighbours, ["branch", "v2"]).join(diffs, "branch")
    j = j.where("at >= pos_r AND at < pos_r + length(seq_r) AND at >= pos AND at < pos + length(seq)")
    same = F.expr("substring(seq, CAST(at - pos + 1 AS INT), 1) = substring(seq_r, CAST(at - pos_r + 1 AS INT), 1)")
    return j.groupBy("branch", "v2", "read_id").agg(F.min(same).alias("ok")).where("ok").select("branch", "v2", "read_id")


def common_reads(edges: DataFrame, subreads: DataFrame, pairs_from: int, pair_count: int) -> DataFrame:
    """(v1, v2, fragment): fragments that two ends of an edge share; a second mate folds to its first."""
    orig = F.when(F.col("orig_id") >= pairs_from + pair_count, F.col("orig_id") - pair_count).otherwise(F.col("orig_id"))
    s = subreads.select("read_id", orig.alias("fragment")).distinct()
    a = edges.select("v1", "v2").join(s.withColumnRenamed("read_id", "v1"), "v1")
    return a.join(s.withColumnRenamed("read_id", "v2"), ["v2", "fragment"]).select("v1", "v2", "fragment")


def unique_evidence(rows: DataFrame) -> DataFrame:
    """(component, v1, v2, support): evidence (component, v1, v2, read_id) that names one edge of its component alone."""
    once = rows.groupBy("component", "read_id").agg(F.count_distinct("v1", "v2").alias("n")).where("n = 1").select("component", "read_id")
    named = rows.select("component", "v1", "v2").distinct()
    counted = rows.join(once, ["component", "read_id"], "left_semi").groupBy("component", "v1", "v2").agg(F.count_distinct("read_id").alias("support"))
    return named.join(counted, ["component", "v1", "v2"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def best_supported(support: DataFrame) -> DataFrame:
    """(component, v1, v2, support): the edge of most support in each component, the least by its ends among equals."""
    best = F.max(F.struct("support", (-F.col("v1")).alias("a"), (-F.col("v2")).alias("b"))).alias("best")
    return support.groupBy("component").agg(best).select("component", (-F.col("best.a")).alias("v1"), (-F.col("best.b")).alias("v2"), "best.support")


def resolve(support: DataFrame, distance: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(component, v1, v2, verdict): keep, remove (support below the threshold of the distance) or skip (no threshold).

    support (component, v1, v2, support); distance (component, dist); thresholds (dist, min_ev): a small table.
    """
    s = support.join(distance, "component").join(thresholds, "dist", "left")
    return s.select("component", "v1", "v2", F.when(F.col("min_ev").isNull(), "skip").when(F.col("support") < F.col("min_ev"), "remove").otherwise("keep").alias("verdict"))


def diploid_removals(support: DataFrame, min_evidence: int = 1) -> DataFrame:
    """(component, v1, v2): edges to remove of double branches, two in- and two out-vertices with three or four edges.

    support (component, v1, v2, support), one row for each edge. The best supported edge (the
    least by ends among equals) and the edge that shares neither end with it are one pair, the
    other two are its rivals. With three or more supported edges the pair of the larger total
    stays. With two that share an end both stay and all unsupported edges go, unless their
    supports differ by more than half of min_evidence. Otherwise the rivals go. Components
    without support, and others than double branches, lose nothing here.
    """
    shape = support.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("v1").alias("n1"), F.count_distinct("v2").alias("n2"), F.max(F.struct("support", (-F.col("v1")).alias("b1"), (-F.col("v2")).alias("b2"))).alias("best"))
    shape = shape.where("n IN (3, 4) AND n1 = 2 AND n2 = 2 AND best.support > 0").select("component", (-F.col("best.b1")).alias("b1"), (-F.col("best.b2")).alias("b2"), F.col("best.support").alias("most"))
    e = support.select("component", "v1", "v2", "support").join(shape, "component").withColumn("rival", (F.col("v1") == F.col("b1")) != (F.col("v2") == F.col("b2")))
    loads = e.groupBy("component").agg(F.sum(F.when(F.col("support") > 0, 1).otherwise(0)).alias("supported"), F.sum(F.when(F.col("rival"), F.col("support")).otherwise(0)).alias("rivals"), F.sum(F.when(F.col("rival"), 0).otherwise(F.col("support"))).alias("own"))
    e = e.join(loads, "component")
    close = (F.col("supported") == 2) & (F.col("rivals") > 0) & (F.col("most") - F.col("rivals") <= 0.5 * min_evidence)
    gone = F.when(close, F.col("support") == 0).when((F.col("supported") > 2) & (F.col("rivals") > F.col("own")), ~F.col("rival")).otherwise(F.col("rival"))
    return e.where(gone).select("component", "v1", "v2")


def min_evidence(count: int, error: float = 0.01, tail: float = 1e-3, least: int = 1) -> int:
    """The least m, from `least` on, for which m of `count` reads err with probability at most `tail` (the term of all `count` left out)."""
    m = least
    while sum(math.comb(count, i) * error**i * (1 - error) ** (count - i) for i in range(m, count)) > tail:
        m += 1
    return m


def evidence_table(coverage: float, read_len: int, mean: float, sd: float) -> list[tuple[int, int, int]]:
    """(dist, expected, minimum) for distances from 1, the last one being the first at which no evidence is expected.

    A read spans a distance with probability (L - d) / L; a pair adds the chance that its inner
    segment, normal around mean, has one of the lengths that put d between its mates. Distances
    end beyond the mean fragment and two deviations. Minimums never fall with more evidence.
    """
    cdf = functools.cache(lambda x: 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2)))))
    rows: list[tuple[int, int]] = []
    d = 1
    while d == 1 or d <= mean + 2 * read_len + 2 * sd:
        spans = sum(cdf(d - read_len + x) - cdf(d - 2 * read_len + x + 1) for x in range(read_len))
        rows.append((d, math.floor(coverage * max(0, read_len - d) / read_len + coverage * spans / read_len)))
        if rows[-1][1] == 0:
            break
        d += 1
    least: dict[int, int] = {}
    m = 1
    for expected in sorted({e for _, e in rows}):
        m = least[expected] = min_evidence(expected, least=m)
    return [(d, e, least[e]) for d, e in rows]
