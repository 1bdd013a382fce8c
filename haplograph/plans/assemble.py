"""Assembly iterations, their convergence loop, stages and regions."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import seq as S
from ..operators import analysis, consensus, fixpoint, induce, joins, overlap
from ..operators import graph as G
from ..session import cut


#: Options that an iteration does not have.
NOT_BUILT = ("optimize", "separate_tips", "diploid", "relax_pe_edges", "branch_reduction", "careful_diploid")


@dataclass(frozen=True)
class State:
    """What one iteration hands to the next.

    reads (read_id, seq, qual); overlaps (id1, id2, pos, len); lineage (read_id, orig_id, idx, len).
    """

    reads: DataFrame
    overlaps: DataFrame
    lineage: DataFrame
    edges: int = 0
    merged: int = 0


def first_state(reads: DataFrame, overlaps: DataFrame, cfg: Config | None = None) -> State:
    """Every read is its own only original. A configuration's limits keep the reads, and overlaps, of the least ids."""
    if cfg is not None and cfg.max_reads < Config.max_reads:
        reads = cut(reads.orderBy("read_id").limit(cfg.max_reads))
        kept = reads.select("read_id")
        overlaps = overlaps.join(kept.withColumnRenamed("read_id", "id1"), "id1", "left_semi").join(kept.withColumnRenamed("read_id", "id2"), "id2", "left_semi")
    if cfg is not None and cfg.max_overlaps < Config.max_overlaps:
        overlaps = overlaps.orderBy("id1", "id2", "pos").limit(cfg.max_overlaps)
    own = reads.select("read_id", F.col("read_id").alias("orig_id"), F.lit(0).cast("long").alias("idx"), F.length("seq").cast("long").alias("len"))
    return State(cut(reads.select("read_id", "seq", "qual")), cut(overlaps.select("id1", "id2", "pos", "len")), cut(own))


def oriented(reads: DataFrame, overlaps: DataFrame) -> tuple[State, DataFrame]:
    """(first state with all reads on one strand, (read_id, flipped)).

    overlaps (id1, id2, ori1, ori2, pos, len), as joins.stranded_overlaps() gives them. Reads are
    turned as the labels of their component say, overlaps that disagree with the labels go, and
    those seen from the other strand are turned round.
    """
    o = cut(overlaps.select("id1", "id2", "ori1", "ori2", "pos", "len"))
    labels = fixpoint.spanning_labels(o.select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), (F.col("ori1") == F.col("ori2")).alias("same_ori"), F.col("len").alias("score")))
    flips = cut(reads.select("read_id").join(labels.select(F.col("node").alias("read_id"), "flipped"), "read_id", "left").select("read_id", F.coalesce("flipped", F.lit(False)).alias("flipped")))
    turned = reads.join(flips, "read_id").select("read_id", F.when(F.col("flipped"), S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(F.col("flipped"), S.reversed_quality(F.col("qual"))).otherwise(F.col("qual")).alias("qual"))
    side = flips.join(reads.select("read_id", F.length("seq").cast("long").alias("n")), "read_id")
    o = o.join(side.withColumnsRenamed({"read_id": "id1", "flipped": "f1", "n": "n1"}), "id1").join(side.withColumnsRenamed({"read_id": "id2", "flipped": "f2", "n": "n2"}), "id2")
    back1, back2 = (F.col("ori1") == "-") != F.col("f1"), (F.col("ori2") == "-") != F.col("f2")
    o = o.where(back1 == back2).withColumns({"back": back1, "beyond": F.col("pos") + F.col("n2") - F.col("n1")})
    swap = F.col("back") & ((F.col("beyond") > 0) | ((F.col("beyond") == 0) & (F.col("id2") < F.col("id1"))))
    one = o.select(F.when(swap, F.col("id2")).otherwise(F.col("id1")).alias("id1"), F.when(swap, F.col("id1")).otherwise(F.col("id2")).alias("id2"), F.when(F.col("back"), F.abs("beyond")).otherwise(F.col("pos")).cast("long").alias("pos"), F.col("len").cast("long").alias("len"))
    return first_state(turned, one), flips


def _edges(state: State, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(edges, nonedges) of the overlaps that pass length and share, scored and classified, the best of each pair."""
    lengths = state.reads.select("read_id", F.length("seq").alias("n"))
    o = state.overlaps.join(lengths.withColumnsRenamed({"read_id": "id1", "n": "n1"}), "id1").join(lengths.withColumnsRenamed({"read_id": "id2", "n": "n2"}), "id2")
    perc = F.expr("CAST(100 * len div least(n1, n2) AS INT)")
    if cfg.no_inclusion_overlaps:
        o = o.where("pos > 0 AND pos + n2 > n1")
    o = o.withColumns({"perc1": perc, "perc2": F.lit(0), "len1": F.col("len"), "len2": F.lit(0), "type1": F.lit("s"), "type2": F.lit("s")})
    routed = overlap.route(o, cfg.min_overlap_len, cfg.min_overlap_perc).where("route = 'score'")
    scored = overlap.classify(overlap.score_overlaps(routed.select("id1", "id2", "pos", "len", "perc1"), state.reads, cfg.min_read_len), cfg.edge_threshold, cfg.ov_threshold, cfg.merge_contigs)
    one = scored.where("class <> 'drop'").select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), F.col("pos").alias("pos1"), F.lit(0).alias("pos2"), F.lit(True).alias("ori1"), F.lit(True).alias("ori2"), "len", "score", "mismatch", F.col("perc1").alias("perc"), "class")
    best = cut(overlap.dedup_edges(one).withColumnRenamed("pos1", "pos").drop("pos2", "ori1", "ori2"))
    return best.where("class = 'edge'").drop("class"), best.where("class = 'nonedge'").drop("class")


def _reduced(edges: DataFrame, reads: DataFrame, cfg: Config) -> DataFrame:
    """The graph after inclusions, transitive edges, tips, branches and cycles."""
    e = edges
    lengths = reads.select("read_id", F.length("seq").alias("n"))
    placed = e.join(lengths.withColumnsRenamed({"read_id": "v1", "n": "n1"}), "v1").join(lengths.withColumnsRenamed({"read_id": "v2", "n": "n2"}), "v2")
    if cfg.ignore_inclusions:
        inside = placed.withColumns({"pos1": F.col("pos"), "pos3": F.col("n1") - F.col("pos") - F.col("n2")})
        e = G.remove_vertices(e, cut(G.inclusion_vertices(inside)))
    if cfg.remove_trans:
        e = cut(G.transitive_reduction(e, cfg.remove_trans))
    if cfg.remove_tips:
        ext = e.join(lengths.withColumnsRenamed({"read_id": "v2", "n": "n2"}), "v2").select("v1", "v2", F.greatest(F.col("n2") - F.col("len"), F.lit(0)).alias("ext_fwd"), F.col("pos").alias("ext_back"))
        e = cut(G.remove_vertices(e, G.tips(ext, cfg.max_tip_len)))
    if cfg.remove_branches:
        e = cut(G.remove_branches(e, fixpoint.connected_components))
    core = G.cyclic_core(e.select(F.col("v1").alias("u"), F.col("v2").alias("v")), cut)
    if not core.isEmpty():
        e = cut(G.without(e, fixpoint.back_edges(core).withColumnsRenamed({"u": "v1", "v": "v2"})))
    return e


def _cliques(edges: DataFrame, least: int) -> DataFrame:
    """(group, read_id, offset): cliques in order that share no read with an earlier one, placed by their least read."""
    pairs = edges.select(F.least("v1", "v2").alias("u"), F.greatest("v1", "v2").alias("v")).distinct()
    c = cut(fixpoint.maximal_cliques(pairs).where(F.size("members") >= least).withColumn("group", F.array_join(F.transform("members", lambda x: F.lpad(x.cast("string"), 19, "0")), "")))
    flat = c.select("group", F.explode("members").alias("read_id"))
    near = flat.join(flat.withColumnRenamed("group", "other"), "read_id").where("group <> other").select(F.col("group").alias("node"), F.col("other").alias("neighbour"))
    lone = c.select(F.col("group").alias("node"), F.lit(None).cast("string").alias("neighbour")).join(near.select("node").distinct(), "node", "left_anti")
    kept = fixpoint.first_choice(near.unionByName(lone)).select(F.col("node").alias("group"))
    base = c.join(kept, "group", "left_semi").select(F.col("members")[0].alias("base"), F.explode("members").alias("read_id"))
    offset = edges.select(F.col("v1").alias("base"), F.col("v2").alias("read_id"), F.col("pos").alias("offset")).unionByName(edges.select(F.col("v2").alias("base"), F.col("v1").alias("read_id"), (-F.col("pos")).alias("offset")))
    out = base.join(offset, ["base", "read_id"], "left").select(F.col("base").alias("group"), "read_id", F.when(F.col("base") == F.col("read_id"), 0).otherwise(F.col("offset")).cast("long").alias("offset"))
    return out


def _pairs(edges: DataFrame) -> DataFrame:
    """(group, read_id, offset): reads merged along a greedy matching."""
    rank = G.adjacency_rank(edges.withColumn("nonoverlap", -F.col("len")))
    m = fixpoint.greedy_matching(rank).join(edges.select("v1", "v2", "pos"), ["v1", "v2"])
    first = m.select(F.col("v1").alias("group"), F.col("v1").alias("read_id"), F.lit(0).cast("long").alias("offset"))
    return first.unionByName(m.select(F.col("v1").alias("group"), F.col("v2").alias("read_id"), F.col("pos").cast("long").alias("offset")))


def iterate(state: State, cfg: Config) -> State:
    """One iteration: overlaps to edges, the reduced graph, groups, consensus, lineage and induced overlaps.

    Works on single reads of one strand (see oriented()). Options for pairs, and for branches
    decided by read evidence, are refused: the operators in evidence.py are not part of it.
    """
    refused = [f.name for f in fields(Config) if f.name in NOT_BUILT and getattr(cfg, f.name) != f.default]
    if refused:
        raise NotImplementedError(f"an iteration has no such option: {', '.join(refused)}")
    edges, nonedges = _edges(state, cfg)
    n_edges = edges.count()
    if not n_edges:
        return replace(state, edges=0, merged=0)
    e = _reduced(edges, state.reads, cfg)
    groups = cut(_cliques(e, cfg.min_clique_size) if cfg.cliques else _pairs(e))
    members = consensus.layout(groups.join(state.reads, "read_id").withColumn("length", F.length("seq").cast("long")))
    members = cut(consensus.downsample(members, 50) if cfg.cliques else members)
    bases = cut(consensus.consensus_bases(consensus.columns(members), cfg.min_qual))
    made = cut(consensus.consensus_sequences(bases, cfg.min_clique_size if cfg.error_correction else 1).where("length > 0"))
    phred = bases.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "phred"))).alias("q"))
    qual = F.array_join(F.transform("q", lambda x: F.char(x["phred"] + 33)), "")
    singles = made.join(phred, "group").select(F.col("group").alias("old"), "seq", F.expr("1").alias("kind"), qual.alias("all_qual"))
    singles = singles.select("old", "seq", F.expr("substring(all_qual, 1, length(seq))").alias("qual"), "kind")
    used = groups.join(made.select("group"), "group", "left_semi")
    alone = state.reads.join(used.select("read_id").distinct(), "read_id", "left_anti").where(F.length("seq") >= cfg.keep_singletons)
    everyone = singles.unionByName(alone.select(F.col("read_id").alias("old"), "seq", "qual", F.lit(2).alias("kind")))
    named = cut(consensus.assign_new_ids(everyone.withColumns({"read_id": F.col("old"), "kind": F.expr("IF(kind = 1, 's', 't')")})))
    reads = cut(named.select(F.col("new_id").alias("read_id"), "seq", "qual"))
    new_of = named.select(F.col("old"), F.col("kind"), F.col("new_id"))
    grouped = members.join(made.select("group"), "group", "left_semi").select("group", "read_id", "at")
    single_ids = new_of.where("kind = 's'").select(F.col("old").alias("group"), "new_id")
    lineage = consensus.superread_lineage(grouped, state.lineage).join(single_ids, "group").select(F.col("new_id").alias("read_id"), "orig_id", "idx", "len")
    alone_ids = new_of.where("kind = 't'").select(F.col("old").alias("read_id"), "new_id")
    lineage = cut(lineage.unionByName(state.lineage.join(alone_ids, "read_id").select(F.col("new_id").alias("read_id"), "orig_id", "idx", "len")))
    bridge = grouped.join(single_ids, "group").select(F.col("read_id").alias("node"), F.col("new_id").alias("sr"), F.col("at").alias("off"))
    bridge = bridge.unionByName(alone_ids.select(F.col("read_id").alias("node"), F.col("new_id").alias("sr"), F.lit(0).cast("long").alias("off")))
    lengths = reads.select(F.col("read_id").alias("sr"), F.length("seq").cast("long").alias("length"))
    known = edges.select("v1", "v2", "pos").unionByName(nonedges.select("v1", "v2", "pos"))
    overlaps = cut(induce.from_edges(known, cut(bridge), lengths).select("id1", "id2", "pos", "len"))
    return State(reads, overlaps, lineage, n_edges, made.count())


def assemble(state: State, cfg: Config, rounds: int = 50) -> tuple[State, list[dict]]:
    """Iterates until no overlaps or edges are left, or the number of reads has stayed the same twice.

    Returns the last state and a row of counts for each iteration.
    """
    log: list[dict] = []
    same = 0
    n = state.reads.count()
    for step in range(rounds):
        if state.overlaps.isEmpty():
            break
        state = iterate(state, cfg)
        if not state.edges:
            break
        after = state.reads.count()
        log.append({"iteration": step, "edges": state.edges, "merged": state.merged, "reads": after})
        same = same + 1 if after == n else 0
        n = after
        if same == 2:
            break
        if cfg.error_correction:
            cfg = replace(cfg, error_correction=False, cliques=False, min_clique_size=2, remove_trans=1)
    return state, log


def staged(state: State, stages: list[Config]) -> tuple[State, list[dict]]:
    """Stages one after another; each begins with overlaps found anew between the contigs so far."""
    log: list[dict] = []
    for k, cfg in enumerate(stages):
        if k:
            found = joins.suffix_prefix(state.reads, cfg.min_overlap_len)
            state = replace(state, overlaps=cut(found))
        state, rows = assemble(state, cfg)
        log += [{"stage": k, **r} for r in rows]
    return state, log


def regions(alignments: DataFrame, size: int = 10_000, overlap_len: int = 1_000, min_depth: int = 2) -> DataFrame:
    """(read_id, start, stop): reads dealt to overlapping tiles of the covered islands.

    alignments (read_id, a, b): closed intervals on one reference. Each tile is assembled alone.
    """
    depth = alignments.select(F.explode(F.sequence("a", "b")).alias("pos")).groupBy("pos").agg(F.count("*").alias("depth"))
    tiles = analysis.tiles(analysis.islands(depth, min_depth, 0), size, overlap_len).withColumnsRenamed({"start": "t0", "stop": "t1"})
    return joins.interval_overlaps(alignments, tiles, ("a", "b"), ("t0", "t1"), size).select("read_id", F.col("t0").alias("start"), F.col("t1").alias("stop"))
