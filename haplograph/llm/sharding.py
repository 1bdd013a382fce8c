"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Atomic groups: ranges of the text's hash. Their sizes, and no more, come to the driver.
ATOMS = 1 << 17
#: An atom of more rows than this, and than its share of 2^16 splits, is numbered in several tasks.
SPLIT_ROWS = 1 << 14
SPLITS = 1 << 16


def minimax_cuts(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each ordered atom, so that parts are contiguous and the largest is least.

    Binary search finds the smallest capacity at which greedy filling needs no more than parts;
    filling at that capacity then cuts.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def fill(capacity: int) -> list[int]:
        ends, at = [], 0
        while at < len(sizes) and len(ends) <= parts:
            at = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
            ends.append(at)
        return ends

    low = max(int(sizes.max(initial=0)), -(-int(total[-1]) // parts))
    high = max(low, int(sizes.max(initial=0)) + int(total[-1]) // parts)
    while low < high:
        mid = (low + high) // 2
        if len(fill(mid)) <= parts:
            high = mid
        else:
            low = mid + 1
    return np.searchsorted(np.array(fill(low) or [0]), np.arange(len(sizes)), "right")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, atoms: int = ATOMS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: shards of nearly equal bytes.

    A row's size is its text's UTF-8 bytes plus overhead. Rows of equal text stay together; a
    null text counts as an empty one. Groups are ordered by the text's hash and joined into
    atoms by its range; the minimax partition cuts between atoms. slot numbers a shard's rows
    from 0 without gaps, in order of atom. A large atom is numbered in several tasks. Repeated
    rows and null ids get slots like any other row. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
        )
    )
    found = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("atom").reset_index(drop=True)
    shard = minimax_cuts(found["size"].to_numpy(np.int64), shards)
    n = found["n"].to_numpy(np.int64)
    split = max(SPLIT_ROWS, int(n.sum()) // SPLITS)
    pieces = -(-n // split)
    where = pd.DataFrame({"atom": found["atom"].astype("int32"), "shard": shard.astype("int32"), "pieces": pieces.astype("int32")})
    places = spark.createDataFrame(where, "atom int, shard int, pieces int") if len(where) else spark.createDataFrame([], "atom int, shard int, pieces int")
    # at most as many places as atoms: a bounded table
    rows = rows.join(F.broadcast(places), "atom")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0).cast("int")
    rows = rows.withColumn("piece", piece).drop("pieces")
    if (pieces > 1).any():
        large = found.loc[pieces > 1, "atom"].astype("int32")
        counted = rows.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"atom": large}), "atom int")), "atom").groupBy("atom", "piece").agg(F.count("*").alias("n")).toPandas()
        small = found.loc[pieces <= 1, ["atom", "n"]].assign(piece=0)
        found = pd.concat([small, counted]).sort_values(["atom", "piece"]).reset_index(drop=True)
        shard = found["atom"].map(dict(zip(where["atom"], where["shard"]))).to_numpy(np.int32)
    else:
        found = found.assign(piece=0)
    before = np.cumsum(found["n"].to_numpy(np.int64)) - found["n"].to_numpy(np.int64)
    first = pd.Series(before).groupby(shard).transform("min").to_numpy() if len(found) else before
    base = pd.DataFrame({"atom": found["atom"].astype("int32"), "piece": found["piece"].astype("int32"), "base": (before - first).astype("int64")})
    bases = spark.createDataFrame(base, "atom int, piece int, base long") if len(base) else spark.createDataFrame([], "atom int, piece int, base long")
    order = Window.partitionBy("atom", "piece").orderBy("doc_id", "size")
    rank = (F.row_number().over(order) - 1).cast("long")
    # at most as many bases as atoms and splits together
    return rows.withColumn("rank", rank).join(F.broadcast(bases), ["atom", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))
