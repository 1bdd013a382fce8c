"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import mates, mixed, plain_overlaps, reads, sam, scored, variants, with_tables
from ..functions import cigar, edge, seq
from ..operators import evidence, overlap
from ..sources import text as src
from . import query


@query(with_tables("reads", "", "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads"))
def revcomp(spark, sf):
    return reads(spark, sf).select("read_id", seq.revcomp(F.col("seq")).alias("rc"))


@query(with_tables("mates", "", """SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN reverse(translate(seq2, 'ACGT', 'TGCA')) ELSE seq1 END AS s1,
    CASE WHEN pair_id % 3 = 0 THEN reverse(translate(seq1, 'ACGT', 'TGCA')) ELSE seq2 END AS s2,
    CASE WHEN pair_id % 3 = 0 THEN reverse(translate(seq1, 'ACGT', 'TGCA')) ELSE seq1 END AS s0 FROM mates"""))  # fmt: skip
def oriented_seq(spark, sf):
    m = mates(spark, sf)
    fwd = F.col("pair_id") % 3 != 0
    pick = lambda mate, paired: seq.oriented(fwd, mate, F.col("seq1"), F.col("seq1"), F.col("seq2"), F.lit(paired))
    return m.select("pair_id", pick(1, True).alias("s1"), pick(2, True).alias("s2"), pick(1, False).alias("s0"))


@query(with_tables("reads", "", "SELECT read_id, k, round(pow(10, -(ascii(substr(qual, k + 1, 1)) - 33) / 10.0), 9) AS p FROM (SELECT *, unnest(range(0, 60, 7)) AS k FROM reads)"))
def phred_prob(spark, sf):
    r = reads(spark, sf).select("read_id", "qual", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"), F.lit(7).cast("long"))).alias("k"))
    return r.select("read_id", "k", F.round(seq.error_probability(seq.phred(F.col("qual"), F.col("k").cast("int"))), 9).alias("p"))


@query(with_tables("mates", "", """SELECT pair_id, k, round(ln(CASE WHEN x = y THEN (1 - p) * (1 - q) + p * q / 3 ELSE p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9 END), 6) AS loglik
    FROM (SELECT pair_id, k, substr(seq1, k + 1, 1) AS x, substr(seq2, k + 1, 1) AS y, pow(10, -(ascii(substr(qual1, k + 1, 1)) - 33) / 10.0) AS p, pow(10, -(ascii(substr(qual2, k + 1, 1)) - 33) / 10.0) AS q
    FROM (SELECT *, unnest(range(60)) AS k FROM mates))"""))  # fmt: skip
def base_pair_loglik(spark, sf):
    m = mates(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    at = F.col("k").cast("int")
    base = lambda c: F.substr(F.col(c), at + 1, F.lit(1))
    prob = lambda c: seq.error_probability(seq.phred(F.col(c), at))
    return m.select("pair_id", "k", F.round(F.log(seq.pair_probability(base("seq1"), base("seq2"), prob("qual1"), prob("qual2"))), 6).alias("loglik"))


@query(with_tables("scored", "", "SELECT id1, id2, pos, round(score, 6) AS score, round(mismatch, 6) AS mismatch FROM scored"))
def overlap_score(spark, sf):
    return scored(spark, sf).select("id1", "id2", "pos", F.round("score", 6).alias("score"), F.round("mismatch", 6).alias("mismatch"))


@query(with_tables("scored", "two AS (SELECT a.id1, a.id2, b.id2 AS nxt, a.score AS s1, b.score AS s2, a.mismatch AS m1, b.mismatch AS m2 FROM scored a JOIN scored b ON b.id1 = a.id2)",
    "SELECT id1, id2, nxt, round(CASE WHEN s1 > 0.97 AND s2 > 0.97 THEN (s1 + s2) / 2 ELSE least(s1, s2) END, 6) AS score, round(greatest(m1, m2), 6) AS mismatch FROM two"))
def paired_score(spark, sf):
    s = scored(spark, sf)
    a, b = s.select("id1", "id2", F.col("score").alias("s1"), F.col("mismatch").alias("m1")), s.select(F.col("id1").alias("id2"), F.col("id2").alias("nxt"), F.col("score").alias("s2"), F.col("mismatch").alias("m2"))
    two = a.join(b, "id2")
    score, mm = overlap.combine_paired(F.col("s1"), F.col("s2"), F.col("m1"), F.col("m2"), 0.97)
    return two.select("id1", "id2", "nxt", F.round(score, 6).alias("score"), F.round(mm, 6).alias("mismatch"))


#: Mate lengths of the paired fixtures: read 1 has 40 + 30, read 2 has 35 + 45; singles have 60.
_LENGTHS = {"a0": 60, "a1": 40, "a2": 30, "b0": 60, "b1": 35, "b2": 45}
_POS34 = """rev AS (SELECT *, CASE WHEN type1 = 's' AND type2 = 's' THEN 60 - pos1 - 60 WHEN type1 = 's' THEN 60 - pos2 - 45 WHEN type2 = 's' THEN 30 + pos2 - 60 WHEN ord = '1' THEN 30 - pos2 - 45 ELSE 30 + pos2 - 45 END AS pos3,
    CASE WHEN type1 = 's' AND type2 = 's' THEN 0 WHEN type1 = 's' THEN 60 - pos1 - 35 WHEN type2 = 's' THEN 60 + pos1 - 40 ELSE 40 - pos1 - 35 END AS pos4 FROM mixed)"""


def _reversed(spark, sf):
    m = mixed(spark, sf)
    pos3, pos4 = edge.reverse_positions(F.col("type1"), F.col("type2"), F.col("ord"), F.col("pos1"), F.col("pos2"), {k: F.lit(v) for k, v in _LENGTHS.items()})
    return m.withColumns({"pos3": pos3, "pos4": pos4})


@query(with_tables("mixed", _POS34, "SELECT id1, id2, CAST(pos3 AS BIGINT) AS pos3, CAST(pos4 AS BIGINT) AS pos4 FROM rev"))
def reverse_positions(spark, sf):
    return _reversed(spark, sf).select("id1", "id2", F.col("pos3").cast("long"), F.col("pos4").cast("long"))


@query(with_tables("mixed", _POS34 + """, e AS (SELECT id1 AS v1, id2 AS v2, pos1, pos2, pos3, pos4, ori1 = '+' AS ori1, ori2 = '+' AS ori2, ord, pos3 < 0 OR (pos3 = 0 AND id1 > id2) AS sw FROM rev)""",
    """SELECT CASE WHEN sw THEN v2 ELSE v1 END AS v1, CASE WHEN sw THEN v1 ELSE v2 END AS v2, CAST(abs(pos3) AS BIGINT) AS pos1, CAST(abs(pos4) AS BIGINT) AS pos2, CAST(pos1 AS BIGINT) AS pos3, CAST(pos2 AS BIGINT) AS pos4,
    CASE WHEN sw THEN NOT ori2 ELSE NOT ori1 END AS ori1, CASE WHEN sw THEN NOT ori1 ELSE NOT ori2 END AS ori2,
    CASE WHEN sw THEN CASE WHEN pos4 < 0 THEN '1' WHEN ord <> '-' THEN '2' ELSE '-' END ELSE CASE WHEN pos4 < 0 THEN '2' WHEN ord <> '-' THEN '1' ELSE '-' END END AS ord FROM e"""))  # fmt: skip
def edge_flip(spark, sf):
    e = _reversed(spark, sf).select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), "pos1", "pos2", "pos3", "pos4", (F.col("ori1") == "+").alias("ori1"), (F.col("ori2") == "+").alias("ori2"), "ord")
    return edge.flipped(e).withColumns({c: F.col(c).cast("long") for c in ("pos1", "pos2", "pos3", "pos4")})


@query(with_tables("overlaps", "", "SELECT id1, id2, CAST(120 - 2 * len AS BIGINT) AS n FROM ovl"))
def nonoverlap_len(spark, sf):
    return plain_overlaps(spark, sf).select("id1", "id2", edge.nonoverlap_length(F.lit(60), F.lit(60), F.col("len")).alias("n"))


@query(with_tables("mixed", """o AS (SELECT *, CASE WHEN ori2 = '+' THEN 35 ELSE 45 END AS f, CASE WHEN ori2 = '+' THEN 45 ELSE 35 END AS s, CASE WHEN type2 = 's' THEN 60 ELSE 80 END AS t FROM mixed)""",
    """SELECT id1, id2, CAST(CASE WHEN (type1 = 'p' AND type2 = 'p' AND ord = '1') OR (type1 = 's' AND type2 = 's') THEN greatest(t - len1 - len2, 0)
    WHEN type1 = 'p' AND type2 = 'p' THEN greatest(f - len1, 0) + greatest(s - pos2 - len2, 0) WHEN type1 = 's' THEN greatest(f - len1, s - len2, 0) ELSE greatest(t - pos2 - len2, 0) END AS BIGINT) AS fwd,
    CAST(CASE WHEN type1 = 'p' AND type2 = 'p' AND ord = '1' THEN pos1 ELSE pos1 + pos2 END AS BIGINT) AS back FROM o"""))  # fmt: skip
def ext_len(spark, sf):
    m = mixed(spark, sf)
    fwd = F.col("ori2") == "+"
    args = [F.col(c) for c in ("type1", "type2", "ord", "pos1", "pos2", "len1", "len2")]
    more = [F.when(fwd, 35).otherwise(45), F.when(fwd, 45).otherwise(35), F.when(F.col("type2") == "s", 60).otherwise(80)]
    return m.select("id1", "id2", edge.extension(True, *args, *more).cast("long").alias("fwd"), edge.extension(False, *args, *more).cast("long").alias("back"))


_WITH_N = "n AS (SELECT read_id, repeat('N', CAST(read_id % 6 AS INT)) || substr(seq, 7, 48) || repeat('N', CAST(read_id % 4 AS INT)) AS s FROM reads)"


def _with_n(spark, sf):
    return reads(spark, sf).select("read_id", F.expr("concat(repeat('N', CAST(read_id % 6 AS INT)), substring(seq, 7, 48), repeat('N', CAST(read_id % 4 AS INT)))").alias("s"))


@query(with_tables("reads", _WITH_N, "SELECT read_id, s FROM n WHERE length(s) - length(replace(s, 'N', '')) < CAST(0.05 AS DOUBLE) * length(s)"))
def n_rate_filter(spark, sf):
    return _with_n(spark, sf).where(seq.n_rate_ok(F.col("s")))


@query(with_tables("reads", _WITH_N, "SELECT read_id, CAST(length(s) - length(ltrim(s, 'N')) AS BIGINT) AS lead, CAST(length(s) - length(rtrim(s, 'N')) AS BIGINT) AS trail FROM n"))
def trim_n_counts(spark, sf):
    lead, trail = seq.end_ns(F.col("s"))
    return _with_n(spark, sf).select("read_id", lead.cast("long").alias("lead"), trail.cast("long").alias("trail"))


@query(with_tables("sam", "", "SELECT qname, array_to_string([p FOR p IN [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048] IF flag & p <> 0], ',') AS bits FROM sam"))
def sam_flags(spark, sf):
    return sam(spark, sf).select("qname", F.array_join(cigar.flags(F.col("flag").cast("int")).cast("array<string>"), ",").alias("bits"))


@query(with_tables("sam", "", r"SELECT qname, array_to_string(regexp_extract_all(cigar, '\d+[A-Z=]'), ' ') AS tokens, CAST(len(regexp_extract_all(cigar, '\d+[A-Z=]')) AS BIGINT) AS n FROM sam"))
def cigar_tokens(spark, sf):
    t = cigar.tokens(F.col("cigar"))
    return sam(spark, sf).select("qname", F.array_join(F.transform(t, lambda x: F.concat(x["n"].cast("string"), x["op"])), " ").alias("tokens"), F.size(t).cast("long").alias("n"))


_CIGARS = ("60M", "20M3I37M", "12M4D40M", "5S20M2I33M", "6M1D6M6D48M", "2M9I20M")


def _cigar_sql(key: str) -> str:
    return f"CASE {key} % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CIGARS)) + " END"


@query(with_tables("overlaps", f"""al AS (SELECT id1, id2, 3 * pos AS apart, {_cigar_sql('id1')} AS front, {_cigar_sql('(id1 + id2)')} AS back FROM ovl),
    tk AS (SELECT cigar, i, CAST(regexp_extract(t[i], '[0-9]+') AS BIGINT) AS n, right(t[i], 1) AS op FROM (SELECT cigar, regexp_extract_all(cigar, '[0-9]+[A-Z]') AS t, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[A-Z]')) + 1)) AS i FROM (SELECT unnest({list(_CIGARS)}) AS cigar))),
    tp AS (SELECT *, coalesce(sum(CASE WHEN op = 'I' THEN 0 ELSE n END) OVER (PARTITION BY cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tk),
    rl AS (SELECT cigar, sum(CASE WHEN op = 'I' THEN 0 ELSE n END) AS rl FROM tk GROUP BY 1),
    fw AS (SELECT id1, id2, apart, back, sum(CASE WHEN op <> 'D' THEN least(n, apart + rl - p) ELSE 0 END) AS fs, sum(CASE WHEN op <> 'I' THEN least(n, apart + rl - p) ELSE 0 END) AS fr
           FROM al JOIN rl ON rl.cigar = back JOIN tp ON tp.cigar = front AND p < apart + rl GROUP BY ALL),
    bw AS (SELECT id1, id2, apart, fs, fr, coalesce(sum(CASE WHEN op <> 'D' THEN least(n, fr - apart - p) ELSE 0 END), 0) AS bs FROM fw LEFT JOIN tp ON tp.cigar = back AND p < fr - apart GROUP BY ALL),
    plc AS (SELECT id1, id2, apart, fr, apart - ((fr - fs) - (fr - apart - bs)) AS place FROM bw)""",
    "SELECT id1, id2, CAST(CASE WHEN fr <= apart OR place < 0 THEN -1 ELSE place END AS BIGINT) AS place FROM plc"))
def cigar_overlap(spark, sf):
    """Alignments with insertions, deletions and clips, some of which lie too far apart."""
    o = plain_overlaps(spark, sf).select("id1", "id2", F.expr("3 * pos").alias("apart"), F.expr(_cigar_sql("id1")).alias("front"), F.expr(_cigar_sql("(id1 + id2)")).alias("back"))
    return o.select("id1", "id2", cigar.overlap_position(F.lit(0), F.col("apart"), F.col("front"), F.col("back")).alias("place"))


@query(with_tables("overlaps", "", """SELECT id1, id2, CAST(floor(100 * greatest(len / 60.0, len / 80.0) + 1e-9) AS BIGINT) AS fno, CAST(least(round(100.0 * len / 60), 100) AS BIGINT) AS sfo,
    CAST(least(round(100 * greatest(CAST(len AS DOUBLE) / 60, CAST(len AS DOUBLE) / 80)), 100) AS BIGINT) AS blast FROM ovl"""))  # fmt: skip
def overlap_perc(spark, sf):
    o = plain_overlaps(spark, sf)
    return o.select("id1", "id2", *(edge.overlap_percent(k, F.col("len"), F.lit(60), F.lit(80)).cast("long").alias(k) for k in ("fno", "sfo", "blast")))


@query(with_tables("mates", "", "SELECT pair_id, array_to_string([i FOR i IN range(1, 61) IF substr(seq1, i, 1) <> substr(seq2, i, 1)], ',') AS places FROM mates"))
def diff_positions(spark, sf):
    return mates(spark, sf).select("pair_id", F.array_join(seq.differences(F.col("seq1"), F.col("seq2")).cast("array<string>"), ",").alias("places"))


@query("""WITH RECURSIVE c AS (SELECT unnest(range(1, 61)) AS n), f AS (SELECT unnest(range(0, 61)) AS k), t AS (SELECT n, k, CAST(1 AS DOUBLE) * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(0.01, k) * pow(0.99, n - k) AS p FROM c JOIN f ON k < n),
    s AS (SELECT n, m, (SELECT coalesce(sum(p), 0) FROM t WHERE t.n = x.n AND t.k >= x.m) AS tail FROM (SELECT n, unnest(range(0, n + 2)) AS m FROM c) x)
    SELECT n, CAST(min(m) AS BIGINT) AS least FROM s WHERE tail <= 0.001 AND m >= 1 GROUP BY n""")  # fmt: skip
def min_evidence(spark, sf):
    return spark.createDataFrame([(n, evidence.min_evidence(n)) for n in range(1, 61)], "n long, least long")


#: Coverage, read length, mean and deviation of the inner segment: the terms differ between neighbouring distances.
_EV = (100, 250, 200, 50)


def _normal_sql(x: str) -> str:
    """The normal distribution function by the error function's series of positive terms."""
    z = f"(abs({x} - {_EV[2]}) / ({_EV[3]} * sqrt(2)))"
    terms = f"list_sum([exp(-{z} * {z} + 2 * n * ln(2) + (2 * n + 1) * ln({z}) - lgamma(2 * n + 2) + lgamma(n + 1)) FOR n IN range(0, 160)])"
    return f"0.5 * (1 + sign({x} - {_EV[2]}) * CASE WHEN {z} > 6 THEN 1 WHEN {z} = 0 THEN 0 ELSE 2 / sqrt(pi()) * {terms} END)"


_EXPECTED = f"""WITH k AS (SELECT CAST(unnest(range(-{2 * _EV[1]}, {_EV[2] + 3 * _EV[1] + 2 * _EV[3]})) AS DOUBLE) AS x), cdf AS (SELECT x, {_normal_sql('x')} AS f FROM k),
    ds AS (SELECT unnest(range(1, {_EV[2] + 2 * _EV[1] + 2 * _EV[3] + 1})) AS d), xs AS (SELECT unnest(range(0, {_EV[1]})) AS x),
    ex AS (SELECT d, CAST(floor({_EV[0]} * greatest(0, {_EV[1]} - d) / {_EV[1]}.0 + {_EV[0]} * sum(hi.f - lo.f) / {_EV[1]}) AS BIGINT) AS e
           FROM ds, xs JOIN cdf lo ON lo.x = d - {2 * _EV[1]} + xs.x + 1 JOIN cdf hi ON hi.x = d - {_EV[1]} + xs.x GROUP BY d),
    rows AS (SELECT * FROM ex WHERE d <= (SELECT coalesce(min(d), 1000000) FROM ex WHERE e = 0))"""


@query(_EXPECTED + "SELECT d AS dist, e AS expected FROM rows")
def expected_evidence(spark, sf):
    return spark.createDataFrame([(d, e) for d, e, _ in evidence.evidence_table(*_EV)], "dist long, expected long")


@query(_EXPECTED + """, es AS (SELECT DISTINCT e FROM rows), ms AS (SELECT e, unnest(range(1, e + 2)) AS m FROM es),
    t AS (SELECT e, k, exp(lgamma(e + 1) - lgamma(k + 1) - lgamma(e - k + 1)) * pow(0.01, k) * pow(0.99, e - k) AS p FROM (SELECT e, unnest(range(0, e)) AS k FROM es)),
    tl AS (SELECT ms.e, m, coalesce(sum(p), 0) AS tail FROM ms LEFT JOIN t ON t.e = ms.e AND k >= m GROUP BY ALL),
    own AS (SELECT e, min(m) AS m FROM tl WHERE tail <= 0.001 GROUP BY e), up AS (SELECT e, max(m) OVER (ORDER BY e) AS m FROM own)
    SELECT d AS dist, rows.e AS exp_ev, CAST(m AS BIGINT) AS min_ev FROM rows JOIN up ON up.e = rows.e""")  # fmt: skip
def evidence_table(spark, sf):
    return spark.createDataFrame(evidence.evidence_table(*_EV), "dist long, exp_ev long, min_ev long")


_GT = "g AS (SELECT pos, block, string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')] AS gt FROM variants)"


def _genotypes(spark, sf):
    return variants(spark, sf).select("pos", "block", src.genotype(F.col("format"), F.col("sample")).alias("gt"))


@query(with_tables("variants", _GT, "SELECT pos, gt FROM g"))
def vcf_gt(spark, sf):
    return _genotypes(spark, sf).select("pos", "gt")


@query(with_tables("variants", _GT, r"SELECT pos, gt FROM g WHERE len(list_distinct(regexp_split_to_array(gt, '[|/]'))) > 1"))
def vcf_het_filter(spark, sf):
    return _genotypes(spark, sf).where(F.size(F.array_distinct(src.alleles(F.col("gt")))) > 1).select("pos", "gt")


@query(with_tables("reads", "", """SELECT read_id, array_to_string([CASE WHEN CAST('0x' || substr(md5(read_id || ':' || i || ':5'), 1, 3) AS INT) < 409 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END FOR i IN range(1, 61)], '') AS seq FROM reads"""))
def mutate_substitutions(spark, sf):
    return reads(spark, sf).select("read_id", seq.mutated(F.col("seq"), F.col("read_id"), 0.1, 5).alias("seq"))
