"""Procedures: an assembly iteration and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..fixtures import plain_overlaps, reads, with_tables
from ..plans import assemble as A
from . import query


@query()
def assembly_iteration(spark, sf):
    """Lengths of the reads after one merging iteration, with the number of originals each holds."""
    r = reads(spark, sf).select("read_id", "seq", "qual")
    first = A.first_state(r, plain_overlaps(spark, sf))
    state = A.iterate(first, Config(edge_threshold=0.97, min_overlap_len=31, min_clique_size=2, remove_trans=1, max_tip_len=30))
    held = state.lineage.groupBy("read_id").agg(F.count("*").alias("originals"))
    return state.reads.join(held, "read_id", "left").select("read_id", F.length("seq").cast("long").alias("length"), "originals")


_TILES = """cov AS (SELECT pos, count(*) AS d FROM (SELECT unnest(range(start, start + 60)) AS pos FROM reads) GROUP BY 1), g AS (SELECT *, pos - row_number() OVER (ORDER BY pos) AS g FROM cov),
    i AS (SELECT min(pos) AS a, max(pos) AS b FROM g GROUP BY g HAVING max(d) > 1 AND max(pos) > min(pos)), t AS (SELECT f AS s, least(b, f + 599) AS e FROM (SELECT b, unnest(range(a, b + 1, 500)) AS f FROM i))"""


@query(with_tables("reads", _TILES, "SELECT read_id, s AS start, e AS stop FROM reads JOIN t ON reads.start <= e AND reads.start + 59 >= s"))
def assembly_regions(spark, sf):
    """Reads dealt to overlapping tiles of the covered genome."""
    a = reads(spark, sf).select("read_id", F.col("start").alias("a"), (F.col("start") + 59).alias("b"))
    return A.regions(a, 500, 100, 1)
