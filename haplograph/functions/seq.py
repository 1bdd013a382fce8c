"""Sequences and qualities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; N and unknown letters stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reversed_quality(qual: Column) -> Column:
    """The qualities of the reverse complement."""
    return F.reverse(qual)


def phred(qual: Column, at: Column) -> Column:
    """Quality score at a 0-based place of a Phred+33 string."""
    return F.ascii(F.substr(qual, at + 1, F.lit(1))) - 33


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def pair_probability(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Probability that two bases with error probabilities p and q come from one base; null where either is N."""
    same = (1 - p) * (1 - q) + p * q / 3
    differ = p * (1 - q) / 3 + q * (1 - p) / 3 + 2 * p * q / 9
    return F.when((x == "N") | (y == "N"), F.lit(None).cast("double")).when(x == y, same).otherwise(differ)


def oriented(forward: Column, mate: int, seq: Column, seq1: Column, seq2: Column, paired: Column) -> Column:
    """The sequence that a read shows in an orientation: of a reversed pair, the other mate's reverse complement."""
    first, other = (seq1, seq2) if mate == 1 else (seq2, seq1)
    return F.when(~paired, F.when(forward, seq).otherwise(revcomp(seq))).when(forward, first).otherwise(revcomp(other))


def n_rate_ok(seq: Column, most: float = 0.05) -> Column:
    """Fewer than a share of N (strictly)."""
    return (F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))) < F.lit(most) * F.length(seq)


def end_ns(seq: Column) -> tuple[Column, Column]:
    """Numbers of leading and trailing N."""
    return F.length(F.regexp_extract(seq, "^N*", 0)), F.length(F.regexp_extract(seq, "N*$", 0))


def differences(a: Column, b: Column, most: int = 100) -> Column:
    """The first 1-based places at which two sequences differ, over the shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    found = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.slice(found, 1, most)


def mutated(seq: Column, key: Column, rate: float, seed: int = 0) -> Column:
    """Substitutions at a rate, decided by a hash of key, place and seed, so that every run agrees."""
    top = int(rate * 4096)

    def base(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed))).cast("binary"))
        hit = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int") < top
        own = F.substr(seq, i, F.lit(1))
        return F.when(hit, F.translate(own, "ACGT", "CGTA")).otherwise(own)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), base), "")
