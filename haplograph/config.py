"""Parameters of an assembly and the profiles of its iterations."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Thresholds of one assembly iteration, checked when built."""

    max_overlaps: int = 100_000_000
    max_reads: int = 100_000_000
    min_clique_size: int = 4
    min_qual: float = 0.9
    min_overlap_perc: int = 0
    min_overlap_len: int = 150
    edge_threshold: float = 0.99
    ov_threshold: float = 0.9
    keep_singletons: int = 0
    error_correction: bool = False
    cliques: bool = False
    ignore_inclusions: bool = False
    optimize: bool = True
    no_inclusion_overlaps: bool = False
    merge_contigs: float = 0.0
    remove_trans: int = 0
    remove_branches: bool = False
    remove_tips: bool = True
    min_read_len: int = 0
    max_tip_len: int = 150
    separate_tips: bool = True
    diploid: bool = False
    relax_pe_edges: bool = False
    branch_reduction: bool = False
    careful_diploid: bool = True

    def __post_init__(self):
        for name in ("edge_threshold", "ov_threshold", "min_qual", "merge_contigs"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in 0..1")
        if not 0 <= self.min_overlap_perc <= 100:
            raise ValueError("min_overlap_perc must lie in 0..100")
        if self.remove_trans not in (0, 1, 2, 3):
            raise ValueError("remove_trans must be 0, 1, 2 or 3")
        if (self.remove_branches or self.branch_reduction) and self.remove_trans != 1:
            raise ValueError("branches are removed from the graph reduced once: remove_trans must be 1")
        if self.remove_branches and self.branch_reduction:
            raise ValueError("structural and evidence branch removal exclude one another")


def viral_error_correction(average_read_length: float) -> Config:
    return Config(edge_threshold=0.97, min_clique_size=4, min_overlap_len=int(0.6 * average_read_length), remove_trans=2, error_correction=True, cliques=True)


def viral_merge(stage: str, min_overlap_len: int) -> Config:
    return Config(edge_threshold=0.97 if stage == "a" else 0.995, min_clique_size=2, min_overlap_len=100 if stage == "c" else min_overlap_len, remove_trans=1)


def polyploid_error_correction(average_read_length: float) -> Config:
    return Config(edge_threshold=0.95, min_clique_size=3, min_overlap_len=int(2 + 0.5 * average_read_length), remove_trans=2, min_qual=0.0, error_correction=True, cliques=True)


def polyploid_merge() -> Config:
    return Config(edge_threshold=1.0, min_clique_size=2, min_overlap_len=50, remove_trans=1, min_qual=0.0)


def with_branch_reduction(config: Config) -> Config:
    return replace(config, branch_reduction=True, remove_branches=False, remove_trans=1)
