"""Frequencies, segmentation, phasing and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def quick_frequencies(subreads: DataFrame, lengths: DataFrame, k: int, min_len: int) -> DataFrame:
    """(read_id, frequency): each original's weight is split over the contigs that hold it; shares are per base and sum to 1.

    subreads (read_id, orig_id), lengths (read_id, length).
    """
    kept = subreads.join(lengths.where(F.col("length") >= min_len), "read_id")
    shares = kept.groupBy("orig_id").agg(F.count("*").alias("holders"))
    w = kept.join(shares, "orig_id").groupBy("read_id", "length").agg(F.sum(1 / F.col("holders")).alias("weight"))
    w = w.withColumn("raw", F.col("weight") / (F.col("length") - k + 1))
    total = w.agg(F.sum("raw").alias("total"))
    return w.crossJoin(F.broadcast(total)).select("read_id", (F.col("raw") / F.col("total")).alias("frequency"))


def tpm_frequencies(abundance: DataFrame, min_len: int) -> DataFrame:
    """(target_id, frequency): shares of tpm among targets longer than min_len."""
    kept = abundance.where(F.col("length") > min_len)
    total = kept.agg(F.sum("tpm").alias("total"))
    return kept.crossJoin(F.broadcast(total)).select("target_id", (F.col("tpm") / F.col("total")).alias("frequency"))


def em_abundance(hits: DataFrame, lengths: DataFrame, rounds: int = 20) -> DataFrame:
    """(target, est_count): expectation-maximisation over compatible (read, target) pairs, shares per effective length."""
    h = cut(hits.join(lengths, "target").select("read", "target", "length"))
    reads = h.select("read").distinct().count()
    rho = cut(h.select("target").distinct().withColumn("rho", F.lit(1.0)))
    for step in range(rounds):
        w = h.join(rho, "target").withColumn("w", F.col("rho") / F.col("length"))
        z = w.groupBy("read").agg(F.sum("w").alias("z"))
        rho = w.join(z, "read").groupBy("target").agg((F.sum(F.col("w") / F.col("z")) / max(reads, 1)).alias("rho"))
        rho = cut(rho) if step % 5 == 4 else rho
    return rho.select("target", (F.col("rho") * reads).alias("est_count"))


def islands(depth: DataFrame, min_depth: int, min_len: int) -> DataFrame:
    """(start, stop, max_depth) of runs of consecutive positions, deeper than min_depth somewhere and longer than min_len.

    depth (pos, depth). Runs are found in bins of positions and joined at bin borders, so no
    window spans the whole chromosome.
    """
    width = 1 << 16
    d = depth.withColumn("bin", F.floor(F.col("pos") / width))
    inner = Window.partitionBy("bin").orderBy("pos")
    runs = d.withColumn("g", F.col("pos") - F.row_number().over(inner)).groupBy("bin", "g").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.max("depth").alias("max_depth"))
    line = Window.orderBy("start")
    new = F.when(F.col("start") == F.lag("stop").over(line) + 1, 0).otherwise(1)
    runs = runs.withColumn("new", new).withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("max_depth").alias("max_depth"))
    return out.where((F.col("max_depth") > min_depth) & (F.col("stop") - F.col("start") > min_len)).drop("island")


def tiles(regions: DataFrame, size: int, overlap: int) -> DataFrame:
    """(start, stop): tiles of `size` positions over each region (start, stop), each reaching `overlap` into the next."""
    first = F.explode(F.sequence(F.col("start"), F.col("stop"), F.lit(size).cast("long")))
    return regions.select("stop", first.alias("from")).select(F.col("from").alias("start"), F.least(F.col("stop"), F.col("from") + size + overlap - 1).alias("stop"))


def phase_set_blocks(variants: DataFrame) -> DataFrame:
    """(block, first_pos, last_pos, n): runs of variants (pos, ps) with one phase set."""
    w = Window.orderBy("pos")
    change = F.when(F.lag("ps").over(w) == F.col("ps"), 0).otherwise(1)
    v = variants.withColumn("change", change).withColumn("block", F.sum("change").over(w))
    return v.groupBy("block").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def phase_contigs(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """(block, hap, seq): each block's stretch of the reference with a haplotype's alleles.

    reference (block, first_pos, seq), each block once; variants (block, pos, alleles: array of one base
    for each haplotype). Null or missing alleles leave the reference's base, and places outside the
    stretch change nothing. A block's variants meet in one row; a sequence is put together from its
    alleles and the pieces of reference between them, never from a row for each base.
    """
    v = variants.where(F.size("alleles") > 0).groupBy("block").agg(F.max(F.size("alleles")).alias("haps"), F.collect_list(F.struct("pos", "alleles")).alias("found"))
    r = reference.where("seq IS NOT NULL").select("block", "first_pos", F.split("seq", "").alias("bases"), F.length("seq").alias("n"))
    # sequences that a query derives are larger than Spark reckons from its files, so neither side is ever broadcast
    r = r.join(v.hint("merge"), "block")
    r = r.withColumn("hap", F.explode(F.sequence(F.lit(0), F.col("haps") - 1)))
    inside = F.filter("found", lambda x: (x["pos"] >= F.col("first_pos")) & (x["pos"] < F.col("first_pos") + F.col("n")))
    at = lambda x: (x["pos"] - F.col("first_pos")).cast("int")
    put = F.transform(inside, lambda x: F.struct(at(x).alias("k"), F.coalesce(F.get(x["alleles"], F.col("hap")), F.get("bases", at(x))).alias("b")))
    r = r.withColumn("put", F.array_sort(put))
    piece = lambda start, stop: F.array_join(F.slice("bases", start + 1, F.greatest(stop - start, F.lit(0))), "")
    following = lambda i: F.coalesce(F.get("put", i)["k"], F.col("n"))
    rest = F.transform("put", lambda x, i: F.concat(x["b"], piece(x["k"] + 1, following(i + 1))))
    return r.select("block", "hap", F.concat(piece(F.lit(0), following(F.lit(0))), F.array_join(rest, "")).alias("seq"))


def best_alignments(alignments: DataFrame) -> DataFrame:
    """The alignment with fewest errors of each contig (contig, target, errors), ties by target."""
    w = Window.partitionBy("contig").orderBy("errors", "target")
    return alignments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snp_quality(calls: DataFrame) -> DataFrame:
    """One row: recall and precision over positions with (truth, call), null where absent."""
    true, found = F.col("truth").isNotNull(), F.col("call").isNotNull()
    hit = true & found & (F.col("truth") == F.col("call"))
    c = calls.agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.sum(F.when(true, 1).otherwise(0)).alias("truths"), F.sum(F.when(found, 1).otherwise(0)).alias("calls"))
    return c.select("hits", "truths", "calls", (F.col("hits") / F.greatest("truths", F.lit(1))).alias("recall"), (F.col("hits") / F.greatest("calls", F.lit(1))).alias("precision"))


def _trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    token = re.compile(r"(\d+)([MIDNSHP=X])")
    for pdf in frames:
        out = []
        for name, pos, cigar, seq, ref in zip(pdf["contig"], pdf["pos"], pdf["cigar"], pdf["seq"], pdf["ref"]):
            r, s, errors = int(pos), 0, []
            for n, op in token.findall(cigar):
                n = int(n)
                if op in "M=X":
                    for k in range(n):
                        if r + k < len(ref) and s + k < len(seq) and ref[r + k] != "N" and seq[s + k] != ref[r + k]:
                            errors.append(r + k)
                    r, s = r + n, s + n
                elif op == "I":
                    errors += [r] * n
                    s += n
                elif op in "DN":
                    errors += list(range(r, r + n))
                    r += n
                elif op == "S":
                    s += n
            out.append((name, errors))
        yield pd.DataFrame(out, columns=["contig", "errors"])


def alignment_errors(alignments: DataFrame) -> DataFrame:
    """(contig, errors): 0-based reference places of mismatches and indels; columns contig, pos, cigar, seq, ref."""
    return alignments.select("contig", "pos", "cigar", "seq", "ref").mapInPandas(_trace, "contig long, errors array<long>")


def iteration_stats(vertices: DataFrame, edges: DataFrame, overlaps: DataFrame, iteration: int) -> DataFrame:
    """One row of counts for an iteration's log."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(vertices, "vertices").crossJoin(one(edges, "edges")).crossJoin(one(overlaps, "overlaps")).withColumn("iteration", F.lit(iteration))
