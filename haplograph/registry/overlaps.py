"""Overlap routing, joins, dialects and induction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import edges, graph, lineage, mates, mixed, plain_overlaps, reads, sam, scored, table, with_tables
from ..functions import cigar
from ..operators import evidence, induce, joins, overlap
from ..operators import graph as G
from ..session import cut
from ..sources import text as src
from . import query
from .scalars import _POS34, _reversed

_ROUTED = """r AS (SELECT *, CASE WHEN NOT (CASE WHEN type1 = 's' AND type2 = 's' THEN len1 >= 40 ELSE len1 >= 20 AND len2 >= 20 END) THEN 'nonedge'
    WHEN (CASE WHEN perc2 > 0 THEN (perc1 + perc2) // 2 ELSE perc1 END) < 70 THEN 'drop' ELSE 'score' END AS route FROM mixed)"""


@query(with_tables("mixed", _ROUTED, "SELECT id1, id2, route FROM r"))
def overlap_route(spark, sf):
    return overlap.route(mixed(spark, sf), 40, 70).select("id1", "id2", "route")


#: Faults that some of the mixed overlaps get, by the ids' sum.
_FAULTS = {
    "pos1": "CASE (id1 + id2) % 17 WHEN 1 THEN -1 - pos1 ELSE pos1 END",
    "perc1": "CASE (id1 + id2) % 17 WHEN 2 THEN 101 WHEN 3 THEN -1 ELSE perc1 END",
    "perc2": "CASE (id1 + id2) % 17 WHEN 4 THEN 120 ELSE perc2 END",
    "ori1": "CASE (id1 + id2) % 17 WHEN 5 THEN '*' ELSE ori1 END",
    "type2": "CASE (id1 + id2) % 17 WHEN 6 THEN 'x' ELSE type2 END",
    "ord": "CASE (id1 + id2) % 17 WHEN 7 THEN '-' WHEN 8 THEN '1' WHEN 9 THEN '3' ELSE ord END",
}
_FAULTY = "faulty AS (SELECT * REPLACE (" + ", ".join(f"{sql} AS {c}" for c, sql in _FAULTS.items()) + ") FROM mixed)"


@query(with_tables("mixed", _FAULTY, """SELECT id1, id2, pos1, perc1, perc2, ori1, type1, type2, ord, id1 >= 0 AND id2 >= 0 AND pos1 >= 0 AND pos2 >= 0 AND perc1 BETWEEN 0 AND 100 AND perc2 BETWEEN 0 AND 100
    AND ori1 IN ('+', '-') AND ori2 IN ('+', '-') AND type1 IN ('s', 'p') AND type2 IN ('s', 'p') AND CASE WHEN type1 = 'p' AND type2 = 'p' THEN ord IN ('1', '2') ELSE ord = '-' END AS valid FROM faulty"""))  # fmt: skip
def overlap_validate(spark, sf):
    rows = mixed(spark, sf).withColumns({c: F.expr(sql) for c, sql in _FAULTS.items()})
    return src.validate_overlaps(rows).select("id1", "id2", "pos1", "perc1", "perc2", "ori1", "type1", "type2", "ord", "valid")


_EDGY = """rd AS (SELECT read_id, substr(CASE WHEN read_id % 4 = 0 THEN substr(seq, 1, 54) || 'NNNNNN' ELSE seq END, 1, CASE WHEN read_id % 9 = 0 THEN 40 ELSE 60 END) AS seq FROM reads),
    o3 AS (SELECT id1, id2, CASE WHEN id2 % 5 = 0 THEN pos * 3 ELSE pos END AS pos, a.seq AS a, b.seq AS b FROM ovl JOIN rd a ON a.read_id = id1 JOIN rd b ON b.read_id = id2),
    c3 AS (SELECT id1, id2, substr(a, pos + k + 1, 1) AS x, substr(b, k + 1, 1) AS y, pow(10, -(20 + (id1 * 7 + pos + k) % 20) / 10.0) AS p, pow(10, -(20 + (id2 * 7 + k) % 20) / 10.0) AS q
           FROM (SELECT *, unnest(range(greatest(0, least(len(a) - pos, len(b))))) AS k FROM o3 WHERE len(a) >= 50 AND len(b) >= 50)),
    v3 AS (SELECT id1, id2, CASE WHEN x = y THEN (1 - p) * (1 - q) + p * q / 3 ELSE p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9 END AS pr, CASE WHEN x = y THEN 0.0 ELSE 1.0 END AS d FROM c3 WHERE x <> 'N' AND y <> 'N'),
    g3 AS (SELECT id1, id2, exp(avg(ln(pr))) AS s, avg(d) AS m FROM v3 GROUP BY ALL HAVING min(pr) >= 0.0002)"""


@query(with_tables("overlaps", _EDGY, "SELECT o.id1, o.id2, o.pos, round(CAST(coalesce(s, 0) AS DOUBLE), 6) AS score, round(CAST(coalesce(m, 1) AS DOUBLE), 6) AS mismatch FROM o3 o LEFT JOIN g3 USING (id1, id2)"))
def overlap_score_bounds(spark, sf):
    """Overlaps that begin beyond the first read, short reads, unknown bases and columns too improbable to accept."""
    r = reads(spark, sf).select("read_id", F.expr("IF(read_id % 4 = 0, concat(substring(seq, 1, 54), 'NNNNNN'), seq)").alias("seq"), "qual", F.expr("IF(read_id % 9 = 0, 40, 60)").alias("n"))
    r = r.select("read_id", F.expr("substring(seq, 1, n)").alias("seq"), F.expr("substring(qual, 1, n)").alias("qual"))
    o = plain_overlaps(spark, sf).select("id1", "id2", F.expr("IF(id2 % 5 = 0, pos * 3, pos)").alias("pos"))
    return overlap.score_overlaps(o, r, min_read_len=50, mismatch=2e-4).select("id1", "id2", "pos", F.round("score", 6).alias("score"), F.round("mismatch", 6).alias("mismatch"))


@query(with_tables("scored", "", "SELECT id1, id2, CASE WHEN score > 0.97 OR mismatch <= 0 THEN 'edge' WHEN score > 0.9 THEN 'nonedge' ELSE 'drop' END AS class FROM scored"))
def edge_classify(spark, sf):
    return overlap.classify(scored(spark, sf), 0.97, 0.9, 0.0).select("id1", "id2", "class")


@query(with_tables("overlaps", "", "SELECT id1, id2, pos, len FROM ovl"))
def range_overlap_join(spark, sf):
    return plain_overlaps(spark, sf)


@query(with_tables("overlaps", "", "SELECT id1, id2, substr(a.seq, pos + 1, 8) AS head1, substr(b.seq, 1, 8) AS head2 FROM ovl JOIN reads a ON a.read_id = id1 JOIN reads b ON b.read_id = id2"))
def overlap_read_join(spark, sf):
    r = reads(spark, sf).select("read_id", "seq")
    o = plain_overlaps(spark, sf).join(r.withColumnsRenamed({"read_id": "id1", "seq": "a"}), "id1").join(r.withColumnsRenamed({"read_id": "id2", "seq": "b"}), "id2")
    return o.select("id1", "id2", F.expr("substring(a, CAST(pos + 1 AS INT), 8)").alias("head1"), F.expr("substring(b, 1, 8)").alias("head2"))


@query(with_tables("reads", """k AS (SELECT read_id AS id1, seq AS a, p, substr(seq, p + 1, 40) AS kmer FROM (SELECT *, unnest(range(0, 21)) AS p FROM reads))""",
    """SELECT id1, read_id AS id2, CAST(p AS BIGINT) AS pos, CAST(least(60 - p, 60) AS BIGINT) AS len FROM k JOIN reads ON substr(seq, 1, 40) = kmer
    WHERE id1 <> read_id AND substr(a, p + 1) = substr(seq, 1, 60 - p) AND (p > 0 OR id1 < read_id)"""))  # fmt: skip
def suffix_prefix_exact(spark, sf):
    return joins.suffix_prefix(reads(spark, sf), 40)


@query(with_tables("reads", """c AS (SELECT DISTINCT x.read_id AS id1, y.read_id AS id2, x.st - y.off AS pos
        FROM (SELECT read_id, st, substr(seq, st + 1, 15) AS kmer FROM (SELECT *, unnest(range(0, 46)) AS st FROM reads)) x
        JOIN (SELECT read_id, off, substr(seq, off + 1, 15) AS kmer FROM (SELECT *, unnest([0, 15, 30]) AS off FROM reads)) y USING (kmer) WHERE x.read_id <> y.read_id AND x.st >= y.off),
    m AS (SELECT id1, id2, pos, 60 - pos AS len, len([i FOR i IN range(1, 61) IF i <= 60 - pos AND substr(a.seq, CAST(pos + i AS INT), 1) <> substr(b.seq, CAST(i AS INT), 1)]) AS mm
        FROM c JOIN reads a ON a.read_id = id1 JOIN reads b ON b.read_id = id2 WHERE 60 - pos >= 45)""",
    "SELECT id1, id2, CAST(pos AS BIGINT) AS pos, CAST(len AS BIGINT) AS len, CAST(mm AS BIGINT) AS mm FROM m WHERE mm <= 2 AND (pos > 0 OR id1 < id2)"))
def suffix_prefix_approx(spark, sf):
    return joins.suffix_prefix_approx(reads(spark, sf), 45, 2)


@query(with_tables("overlaps", """d AS (SELECT id1, id2, len([i FOR i IN range(1, 61) IF i <= len AND substr(a.seq, CAST(pos + i AS INT), 1) <> substr(b.seq, CAST(i AS INT), 1)]) AS mm
    FROM ovl JOIN reads a ON a.read_id = id1 JOIN reads b ON b.read_id = id2)""", "SELECT DISTINCT least(id1, id2) AS u, greatest(id1, id2) AS v FROM d WHERE mm > 0"))  # fmt: skip
def conflict_graph(spark, sf):
    return conflicts(spark, sf)


def conflicts(spark, sf):
    """(u, v): overlapping reads that differ within their overlap."""
    r = reads(spark, sf).select("read_id", "seq")
    o = plain_overlaps(spark, sf).join(r.withColumnsRenamed({"read_id": "id1", "seq": "a"}), "id1").join(r.withColumnsRenamed({"read_id": "id2", "seq": "b"}), "id2")
    differ = F.expr("substring(a, CAST(pos + 1 AS INT), CAST(len AS INT)) <> substring(b, 1, CAST(len AS INT))")
    return o.where(differ).select(F.least("id1", "id2").alias("u"), F.greatest("id1", "id2").alias("v")).distinct()


@query(with_tables("overlaps", """p AS (SELECT id1 // 2 AS a, id2 // 2 AS b, id1 % 2 AS m1, id2 % 2 AS m2, pos, len FROM ovl WHERE id1 // 2 <> id2 // 2)""",
    """SELECT x.a AS id1, x.b AS id2, x.pos AS pos1, y.pos AS pos2, x.len AS len1, y.len AS len2, '1' AS ord FROM p x JOIN p y ON y.a = x.a AND y.b = x.b WHERE x.m1 = 0 AND x.m2 = 0 AND y.m1 = 1 AND y.m2 = 1
    UNION ALL SELECT x.a, x.b, x.pos, y.pos, x.len, y.len, '2' FROM p x JOIN p y ON y.a = x.b AND y.b = x.a WHERE x.m1 = 0 AND x.m2 = 0 AND y.m1 = 1 AND y.m2 = 1"""))  # fmt: skip
def pair_overlaps(spark, sf):
    p = plain_overlaps(spark, sf).select(F.expr("id1 div 2").alias("a"), F.expr("id2 div 2").alias("b"), (F.col("id1") % 2).alias("m1"), (F.col("id2") % 2).alias("m2"), "pos", "len").where("a <> b")
    x = p.where("m1 = 0 AND m2 = 0").select(F.col("a").alias("id1"), F.col("b").alias("id2"), F.col("pos").alias("pos1"), F.col("len").alias("len1"))
    y = p.where("m1 = 1 AND m2 = 1")
    same = y.select(F.col("a").alias("id1"), F.col("b").alias("id2"), F.col("pos").alias("pos2"), F.col("len").alias("len2"), F.lit("1").alias("ord"))
    turned = y.select(F.col("b").alias("id1"), F.col("a").alias("id2"), F.col("pos").alias("pos2"), F.col("len").alias("len2"), F.lit("2").alias("ord"))
    return x.join(same.union(turned), ["id1", "id2"])


@query(with_tables("graph", "", "SELECT e.v1, e.v2, e.pos FROM graph e WHERE EXISTS (SELECT 1 FROM graph a JOIN graph b ON b.v1 = a.v2 WHERE a.v1 = e.v1 AND b.v2 = e.v2)"))
def transitive_edges(spark, sf):
    return G.transitive_edges(graph(spark, sf)).select("v1", "v2", "pos")


@query(with_tables("edges", "", "SELECT e.v1, e.v2, e.pos, round(e.score, 6) AS score FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges a JOIN edges b ON b.v1 = a.v2 WHERE a.v1 = e.v1 AND b.v2 = e.v2)"))
def transitive_reduction(spark, sf):
    e = cut(edges(spark, sf))
    return G.transitive_reduction(e).select("v1", "v2", "pos", F.round("score", 6).alias("score"))


@query(with_tables("mixed", _POS34 + """, e AS (SELECT CASE WHEN pos1 = 0 AND id1 > id2 THEN id2 ELSE id1 END AS v1, CASE WHEN pos1 = 0 AND id1 > id2 THEN id1 ELSE id2 END AS v2,
        CASE WHEN pos1 = 0 AND id1 > id2 THEN ori2 ELSE ori1 END = '+' AS ori1, CASE WHEN pos1 = 0 AND id1 > id2 THEN ori1 ELSE ori2 END = '+' AS ori2, CAST(perc1 AS DOUBLE) / 100 AS score, len1 AS len, CAST(perc2 AS DOUBLE) / 1000 AS mismatch, pos1, pos2 FROM rev
        UNION ALL SELECT id1, id2, true, false, CAST(perc1 AS DOUBLE) / 100, len1, CAST(perc2 AS DOUBLE) / 2000, pos1, pos2 + 1 FROM rev WHERE id1 % 2 = 0 AND pos1 > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY least(v1, v2), greatest(v1, v2), ori1 = ori2 ORDER BY score DESC, len DESC, mismatch, v1, ori1 DESC, ori2 DESC, pos1, pos2) AS r FROM e)""",
    "SELECT v1, v2, ori1, ori2, round(score, 6) AS score, CAST(pos1 AS BIGINT) AS pos1, CAST(pos2 AS BIGINT) AS pos2 FROM k WHERE r = 1"))
def edge_dedup(spark, sf):
    m = _reversed(spark, sf)
    own = m.select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), (F.col("ori1") == "+").alias("ori1"), (F.col("ori2") == "+").alias("ori2"), (F.col("perc1") / 100).alias("score"), F.col("len1").alias("len"), (F.col("perc2") / 1000).alias("mismatch"), "pos1", "pos2")
    more = m.where("id1 % 2 = 0 AND pos1 > 0").select(F.col("id1"), F.col("id2"), F.lit(True), F.lit(False), F.col("perc1") / 100, F.col("len1"), F.col("perc2") / 2000, "pos1", F.col("pos2") + 1)
    return overlap.dedup_edges(own.union(more)).select("v1", "v2", "ori1", "ori2", F.round("score", 6).alias("score"), F.col("pos1").cast("long").alias("pos1"), F.col("pos2").cast("long").alias("pos2"))


@query(with_tables("mixed", "", """SELECT coalesce(type1 || type2, 'all') AS types, CAST(sum(CASE WHEN ori1 || ori2 = '++' THEN 1 ELSE 0 END) AS BIGINT) AS pp, CAST(sum(CASE WHEN ori1 || ori2 = '+-' THEN 1 ELSE 0 END) AS BIGINT) AS pm,
    CAST(sum(CASE WHEN ori1 || ori2 = '-+' THEN 1 ELSE 0 END) AS BIGINT) AS mp, CAST(sum(CASE WHEN ori1 || ori2 = '--' THEN 1 ELSE 0 END) AS BIGINT) AS mm, count(*) AS total FROM mixed GROUP BY ROLLUP (type1 || type2)"""))  # fmt: skip
def overlap_crosstab(spark, sf):
    return overlap.crosstab(mixed(spark, sf))


# ---- dialects --------------------------------------------------------------------------------

_SFO = "sfo AS (SELECT id1 AS id_a, id2 AS id_b, CASE WHEN id2 % 7 = 0 THEN 'I' ELSE 'N' END AS ori, CASE WHEN id1 % 2 = 0 THEN pos ELSE -pos END AS oha, CASE WHEN id1 % 2 = 0 THEN pos ELSE -pos END + id2 % 3 AS ohb, len AS ola, len AS olb FROM ovl)"


def _sfo(spark, sf):
    sign = "IF(id1 % 2 = 0, pos, -pos)"
    return plain_overlaps(spark, sf).select(F.col("id1").alias("id_a"), F.col("id2").alias("id_b"), F.expr("IF(id2 % 7 = 0, 'I', 'N')").alias("ori"), F.expr(sign).alias("oha"), F.expr(f"{sign} + id2 % 3").alias("ohb"), F.col("len").alias("ola"), F.col("len").alias("olb"))


@query(with_tables("overlaps", _SFO + """, l AS (SELECT *, ola + CASE WHEN oha >= 0 THEN oha ELSE 0 END + greatest(-ohb, 0) AS la, olb + greatest(-oha, 0) + greatest(ohb, 0) AS lb FROM sfo)""",
    """SELECT CASE WHEN oha >= 0 THEN id_a ELSE id_b END AS id1, CASE WHEN oha >= 0 THEN id_b ELSE id_a END AS id2, abs(oha) AS pos1, CASE WHEN oha >= 0 OR ori = 'N' THEN '+' ELSE '-' END AS ori1,
    CASE WHEN oha < 0 OR ori = 'N' THEN '+' ELSE '-' END AS ori2, CAST(least(round(100.0 * least(ola, olb) / least(la, lb)), 100) AS BIGINT) AS perc1, least(ola, olb) AS len1 FROM l"""))  # fmt: skip
def sfo_to_overlaps(spark, sf):
    return overlap.sfo_to_overlaps(_sfo(spark, sf))


_FOLDED = """f AS (SELECT CASE WHEN id_a >= 150 THEN id_a - 50 ELSE id_a END AS a, CASE WHEN id_b >= 150 THEN id_b - 50 ELSE id_b END AS b, ori, oha, ohb, ola, olb FROM sfo)"""


@query(with_tables("overlaps", _SFO + ", " + _FOLDED, """SELECT least(a, b) AS id_a, greatest(a, b) AS id_b, ori, CASE WHEN a > b AND ori = 'N' THEN -oha WHEN a > b THEN ohb ELSE oha END AS oha,
    CASE WHEN a > b AND ori = 'N' THEN -ohb WHEN a > b THEN oha ELSE ohb END AS ohb, ola, olb FROM f"""))  # fmt: skip
def sfo_normalize(spark, sf):
    return overlap.sfo_normalize(_sfo(spark, sf), 100, 50)


@query(with_tables("overlaps", _SFO, "SELECT DISTINCT id_a % 50 AS id_a, id_b % 50 AS id_b, oha, ohb FROM sfo ORDER BY 1, 2, 3, 4"))
def sfo_sort_uniq(spark, sf):
    return _sfo(spark, sf).select((F.col("id_a") % 50).alias("id_a"), (F.col("id_b") % 50).alias("id_b"), "oha", "ohb").distinct().orderBy("id_a", "id_b", "oha", "ohb")


_BLAST = """blast AS (SELECT CAST(id1 AS VARCHAR) AS qseqid, CAST(id2 AS VARCHAR) AS sseqid, len AS length, id1 % 4 AS mismatch, pos + 1 AS qstart, CAST(60 AS BIGINT) AS qend,
    CASE WHEN id2 % 7 = 0 THEN 60 ELSE 1 END AS sstart, CASE WHEN id2 % 7 = 0 THEN 61 - len ELSE len END AS send, CAST(60 AS BIGINT) AS qlen, CAST(60 AS BIGINT) AS slen FROM ovl)"""


def _blast(spark, sf):
    o = plain_overlaps(spark, sf)
    return o.select(F.col("id1").cast("string").alias("qseqid"), F.col("id2").cast("string").alias("sseqid"), F.col("len").alias("length"), F.expr("id1 % 4").alias("mismatch"), F.expr("pos + 1").alias("qstart"), F.lit(60).cast("long").alias("qend"), F.expr("IF(id2 % 7 = 0, 60L, 1L)").alias("sstart"), F.expr("IF(id2 % 7 = 0, 61 - len, len)").alias("send"), F.lit(60).cast("long").alias("qlen"), F.lit(60).cast("long").alias("slen"))


_TURN = """SELECT CASE WHEN qseqid > sseqid THEN sseqid ELSE qseqid END AS id_a, CASE WHEN qseqid > sseqid THEN qseqid ELSE sseqid END AS id_b, ori,
    CAST(CASE WHEN qseqid > sseqid AND ori = 'N' THEN -oha WHEN qseqid > sseqid THEN ohb ELSE oha END AS BIGINT) AS oha, CAST(CASE WHEN qseqid > sseqid AND ori = 'N' THEN -ohb WHEN qseqid > sseqid THEN oha ELSE ohb END AS BIGINT) AS ohb,
    CAST(ola AS BIGINT) AS ola, CAST(ola AS BIGINT) AS olb, CAST(k AS BIGINT) AS k FROM t"""  # fmt: skip


@query(with_tables("overlaps", _BLAST + """, t AS (SELECT *, CASE WHEN sstart <= send THEN 'N' ELSE 'I' END AS ori, CASE WHEN sstart <= send THEN qstart - sstart ELSE qstart - (slen - sstart + 1) END AS oha,
    CASE WHEN sstart <= send THEN slen - sstart - (qlen - qstart) ELSE sstart - (qlen - qstart + 1) END AS ohb, length AS ola, mismatch AS k FROM blast WHERE qseqid <> sseqid AND length >= 40)""", _TURN))  # fmt: skip
def blast_to_sfo(spark, sf):
    return overlap.blast_to_sfo(_blast(spark, sf), 40)


@query(with_tables("overlaps", _BLAST + """, t AS (SELECT *, CASE WHEN sstart <= send THEN '+' ELSE '-' END AS strand, qstart - CASE WHEN sstart <= send THEN sstart ELSE slen - sstart + 1 END AS lag FROM blast WHERE length >= 40)""",
    """SELECT CASE WHEN lag >= 0 THEN qseqid ELSE sseqid END AS id1, CASE WHEN lag >= 0 THEN sseqid ELSE qseqid END AS id2, CAST(abs(lag) AS BIGINT) AS pos1, CASE WHEN lag >= 0 THEN '+' ELSE strand END AS ori1, CASE WHEN lag >= 0 THEN strand ELSE '+' END AS ori2,
    CAST(least(round(100 * greatest(CAST(length AS DOUBLE) / qlen, CAST(length AS DOUBLE) / slen)), 100) AS BIGINT) AS perc1, length AS len1 FROM t"""))  # fmt: skip
def blast_to_overlaps(spark, sf):
    return overlap.blast_to_overlaps(_blast(spark, sf), 40)


_PAF = """paf AS (SELECT CAST(id1 AS VARCHAR) AS qseqid, CAST(id2 AS VARCHAR) AS sseqid, CAST(60 AS BIGINT) AS qlen, pos AS qstart, CASE WHEN id2 % 7 = 0 THEN '-' ELSE '+' END AS qori, CAST(60 AS BIGINT) AS slen,
    CASE WHEN id2 % 7 = 0 THEN 60 - len ELSE 0 END AS sstart, CASE WHEN id2 % 7 = 0 THEN 60 ELSE len END AS send, len AS length, len - (id1 + id2) % 5 AS matches FROM ovl)"""


@query(with_tables("overlaps", _PAF + """, h AS (SELECT *, CASE WHEN qori = '+' THEN 'N' ELSE 'I' END AS ori, CASE WHEN qori = '+' THEN qstart - sstart ELSE qstart - (slen - send) END AS oha,
    CASE WHEN qori = '+' THEN slen - sstart - (qlen - qstart) ELSE send - (qlen - qstart) END AS ohb, length - matches AS k FROM paf WHERE length >= 40 AND CAST(matches AS DOUBLE) / length >= 0.95),
    t AS (SELECT *, CASE WHEN oha >= 0 THEN least(qlen - oha, slen) ELSE least(slen + oha, qlen) END AS ola FROM h)""", _TURN))  # fmt: skip
def paf_to_sfo(spark, sf):
    return overlap.paf_to_sfo(_paf(spark, sf), 40, 0.95)


def _paf(spark, sf):
    o = plain_overlaps(spark, sf)
    return o.select(F.col("id1").cast("string").alias("qseqid"), F.col("id2").cast("string").alias("sseqid"), F.lit(60).cast("long").alias("qlen"), F.col("pos").alias("qstart"), F.expr("IF(id2 % 7 = 0, '-', '+')").alias("qori"), F.lit(60).cast("long").alias("slen"), F.expr("IF(id2 % 7 = 0, 60 - len, 0L)").alias("sstart"), F.expr("IF(id2 % 7 = 0, 60L, len)").alias("send"), F.col("len").alias("length"), F.expr("len - (id1 + id2) % 5").alias("matches"))


@query(with_tables("overlaps", _PAF, "SELECT qseqid, sseqid, matches FROM paf WHERE length >= 40 AND CAST(matches AS DOUBLE) / length >= 0.95"))
def alignment_filter(spark, sf):
    return _paf(spark, sf).where((F.col("length") >= 40) & (F.col("matches") / F.col("length") >= 0.95)).select("qseqid", "sseqid", "matches")


@query(with_tables("mixed", """o AS (SELECT CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, pos1, ori1, ori2, len1 FROM mixed WHERE len1 >= 40),
    t AS (SELECT *, id1 > id2 AS turn, CASE WHEN id1 > id2 THEN -pos1 ELSE pos1 END AS oha, CASE WHEN len1 = 60 THEN pos1 + len1 - 60 ELSE 60 - len1 END * CASE WHEN id1 > id2 THEN -1 ELSE 1 END AS ohb, CASE WHEN id1 > id2 THEN ori2 ELSE ori1 END AS f FROM o)""",
    """SELECT CASE WHEN turn THEN id2 ELSE id1 END AS id_a, CASE WHEN turn THEN id1 ELSE id2 END AS id_b, CASE WHEN ori1 <> ori2 THEN 'I' ELSE 'N' END AS ori, CAST(CASE WHEN f = '-' THEN -ohb ELSE oha END AS BIGINT) AS oha,
    CAST(CASE WHEN f = '-' THEN -oha ELSE ohb END AS BIGINT) AS ohb, CAST(len1 AS BIGINT) AS ola, CAST(len1 AS BIGINT) AS olb FROM t"""))  # fmt: skip
def overlaps_to_sfo(spark, sf):
    o = mixed(spark, sf).select(F.col("id1").cast("string").alias("id1"), F.col("id2").cast("string").alias("id2"), F.col("pos1").cast("long").alias("pos1"), "ori1", "ori2", F.col("len1").cast("long").alias("len1"))
    lengths = reads(spark, sf).select(F.col("read_id").cast("string").alias("read_id"), F.length("seq").cast("long").alias("length"))
    return overlap.overlaps_to_sfo(o, lengths, 40)


# ---- induction -------------------------------------------------------------------------------

#: Superreads of the fixtures: four consecutive reads by start order share one of length 100.
_BRIDGE = "bridge AS (SELECT read_id AS node, CASE WHEN read_id % 5 = 4 THEN 1000000 + read_id ELSE read_id // 5 END AS sr, CASE WHEN read_id % 5 = 4 THEN 0 ELSE read_id % 5 * 9 END AS off FROM reads)"
_PLACED = """, d AS (SELECT *, CASE WHEN delta < 0 THEN b ELSE a END AS id1, CASE WHEN delta < 0 THEN a ELSE b END AS id2, abs(delta) AS pos, least(CASE WHEN delta < 0 THEN lb ELSE la END - abs(delta), la, lb) AS len FROM j)"""
_PLACED_OUT = "SELECT id1, id2, pos, len, CAST(floor(100 * greatest(CAST(len AS DOUBLE) / la, CAST(len AS DOUBLE) / lb)) AS BIGINT) AS perc FROM d WHERE len > 0"


def _bridge(spark, sf):
    lone = "read_id % 5 = 4"
    return reads(spark, sf).select(F.col("read_id").alias("node"), F.expr(f"IF({lone}, 1000000 + read_id, read_id div 5)").alias("sr"), F.expr(f"IF({lone}, 0L, read_id % 5 * 9)").alias("off"))


def _sr_lengths(spark, sf):
    return _bridge(spark, sf).select("sr", F.expr("IF(sr >= 1000000, 60L, 100L)").alias("length")).distinct()


_LEN = "CASE WHEN {0} >= 1000000 THEN 60 ELSE 100 END"


@query(with_tables("graph", _BRIDGE + f""", e AS (SELECT v1, v2, p.sr AS a, q.sr AS b, p.off + pos - q.off AS delta, row_number() OVER (PARTITION BY least(p.sr, q.sr), greatest(p.sr, q.sr) ORDER BY v1, v2, p.sr, q.sr) AS r
    FROM graph JOIN bridge p ON p.node = v1 JOIN bridge q ON q.node = v2 WHERE p.sr <> q.sr), j AS (SELECT *, {_LEN.format('a')} AS la, {_LEN.format('b')} AS lb FROM e WHERE r = 1)""" + _PLACED, _PLACED_OUT))  # fmt: skip
def induce_overlaps_edges(spark, sf):
    return induce.from_edges(graph(spark, sf), _bridge(spark, sf), _sr_lengths(spark, sf))


@query(with_tables("lineage", """p AS (SELECT x.read_id AS a, y.read_id AS b, arg_min(x.idx - y.idx, x.orig_id) AS delta FROM lineage x JOIN lineage y ON x.orig_id = y.orig_id AND x.read_id < y.read_id GROUP BY 1, 2),
    j AS (SELECT *, 130 + a % 20 AS la, 130 + b % 20 AS lb FROM p)""" + _PLACED, _PLACED_OUT))  # fmt: skip
def induce_overlaps_shared(spark, sf):
    lengths = lineage(spark, sf).select("read_id").distinct().withColumn("length", F.expr("130 + read_id % 20"))
    return induce.from_shared(lineage(spark, sf), lengths)


@query(with_tables("graph", "x AS (SELECT DISTINCT v2 AS v FROM graph WHERE v2 % 9 = 0), m AS (SELECT a.v1, b.v2, min(a.pos) AS pos FROM graph a JOIN graph b ON b.v1 = a.v2 WHERE a.v2 IN (SELECT v FROM x) AND a.v1 <> b.v2 GROUP BY 1, 2)",
    "SELECT v1, v2, pos FROM m WHERE NOT EXISTS (SELECT 1 FROM graph g WHERE g.v1 = m.v1 AND g.v2 = m.v2)"))
def inclusion_induced_edges(spark, sf):
    g = graph(spark, sf)
    return induce.around_inclusions(g, g.where("v2 % 9 = 0").select(F.col("v2").alias("v")).distinct())


@query(with_tables("graph", "", "SELECT id1, id2, pos FROM ovl o WHERE NOT EXISTS (SELECT 1 FROM graph g WHERE (g.v1 = o.id1 AND g.v2 = o.id2) OR (g.v1 = o.id2 AND g.v2 = o.id1))"))
def nonedge_antijoin(spark, sf):
    return induce.left_out(plain_overlaps(spark, sf), graph(spark, sf)).select("id1", "id2", "pos")


@query(with_tables("lineage", "pairs AS (SELECT DISTINCT p_partkey AS v1, p_partkey + 1 AS v2 FROM part), f AS (SELECT DISTINCT read_id, CASE WHEN orig_id >= 1200 THEN orig_id - 600 ELSE orig_id END AS fragment FROM lineage)",
    "SELECT v1, v2, a.fragment FROM pairs JOIN f a ON a.read_id = v1 JOIN f b ON b.read_id = v2 AND b.fragment = a.fragment"))
def branch_common_reads(spark, sf):
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("v1"), (F.col("p_partkey") + 1).alias("v2")).distinct()
    return evidence.common_reads(pairs, lineage(spark, sf), 600, 600)


@query(with_tables("sam", "", "SELECT qname, CAST(pos - CASE WHEN cigar = '5S55M' THEN 5 ELSE 0 END AS BIGINT) AS pos, seq FROM sam WHERE flag & 4 = 0"))
def sam_clip_adjust(spark, sf):
    s = sam(spark, sf).where(F.col("flag").bitwiseAND(F.lit(4)) == 0)
    pos, adjusted = cigar.clip_adjusted(F.col("pos"), F.col("cigar"), F.col("seq"))
    return s.select("qname", pos.cast("long").alias("pos"), adjusted.alias("seq"))


@query(with_tables("sam", "", "SELECT qname, CASE WHEN cigar = '5S55M' THEN substr(seq, 6) ELSE seq END AS seq FROM sam WHERE flag & 4 = 0 AND flag & 256 = 0"))
def sam_primary(spark, sf):
    s = sam(spark, sf).where(F.col("flag").bitwiseAND(F.lit(260)) == 0)
    first = F.element_at(cigar.tokens(F.col("cigar")), 1)
    return s.select("qname", F.when(first["op"] == "S", F.substr(F.col("seq"), first["n"] + 1)).otherwise(F.col("seq")).alias("seq"))


@query(with_tables("sam", "", """SELECT a.qname // 2 AS pair_id, CASE WHEN a.flag & 16 = 16 THEN b.pos ELSE a.pos END AS pos1, CASE WHEN a.flag & 16 = 16 THEN a.pos ELSE b.pos END AS pos2, a.flag & 16 = 16 AS reverse
    FROM sam a JOIN sam b ON b.qname = a.qname + 1 WHERE a.qname % 2 = 0 AND a.flag & 4 = 0 AND b.flag & 4 = 0 AND a.flag & 16 = b.flag & 16 AND CASE WHEN a.flag & 16 = 16 THEN b.pos <= a.pos ELSE a.pos <= b.pos END"""))  # fmt: skip
def sam_pair(spark, sf):
    s = sam(spark, sf).where("flag & 4 = 0").select(F.expr("qname div 2").alias("pair_id"), (F.col("qname") % 2).alias("mate"), "pos", F.expr("flag & 16 = 16").alias("reverse"))
    a, b = s.where("mate = 0").select("pair_id", "reverse", F.col("pos").alias("pa")), s.where("mate = 1").select("pair_id", "reverse", F.col("pos").alias("pb"))
    j = a.join(b, ["pair_id", "reverse"]).where("IF(reverse, pb <= pa, pa <= pb)")
    return j.select("pair_id", F.expr("IF(reverse, pb, pa)").alias("pos1"), F.expr("IF(reverse, pa, pb)").alias("pos2"), "reverse")


@query(with_tables("mates", "m AS (SELECT pair_id, seq1 AS a, qual1 AS qa, substr(seq1, 31) || substr(seq2, 1, 30) AS b, substr(qual1, 31) || substr(qual2, 1, 30) AS qb FROM mates)",
    """SELECT pair_id, CAST(min(o) AS BIGINT) AS overlap, min_by(a || substr(b, o + 1), o) AS seq FROM (
    SELECT pair_id, o, a, b, exp(avg(ln(CASE WHEN x = y THEN (1 - p) * (1 - q) + p * q / 3 ELSE p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9 END))) AS score FROM (
        SELECT pair_id, o, a, b, substr(a, 60 - o + k + 1, 1) AS x, substr(b, k + 1, 1) AS y, pow(10, -(ascii(substr(qa, 60 - o + k + 1, 1)) - 33) / 10.0) AS p, pow(10, -(ascii(substr(qb, k + 1, 1)) - 33) / 10.0) AS q
        FROM (SELECT *, unnest(range(o)) AS k FROM (SELECT *, unnest(range(15, 60)) AS o FROM m))) GROUP BY ALL) WHERE score > 0.97 GROUP BY pair_id"""))  # fmt: skip
def mate_merge(spark, sf):
    from ..operators import consensus

    m = mates(spark, sf).select("pair_id", "seq1", "qual1", F.expr("concat(substring(seq1, 31), substring(seq2, 1, 30))").alias("seq2"), F.expr("concat(substring(qual1, 31), substring(qual2, 1, 30))").alias("qual2"))
    return consensus.mate_merge(m, threshold=0.97).select("pair_id", F.col("overlap").cast("long"), "seq")
