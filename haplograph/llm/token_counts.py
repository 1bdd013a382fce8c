"""Token counts: one exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoded_runs, encoder


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            lengths = [np.diff(ends, prepend=0) for _, _, _, ends in encoded_runs(coder, batch.column(0))]
            value, many = np.unique(np.concatenate([*lengths, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(many.astype(np.int64))], names=["n_tokens", "n_docs"])

    return run


class LengthHistogram:
    """Documents by length, with suffix sums. It has a row for each distinct length, whatever the corpus."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray):
        order = np.argsort(lengths)
        self.lengths, self.docs = lengths[order].astype(np.int64), docs[order].astype(np.int64)
        self._docs_from = np.append(np.cumsum(self.docs[::-1])[::-1], 0)
        self._tokens_from = np.append(np.cumsum((self.docs * self.lengths)[::-1])[::-1], 0)

    @property
    def total_docs(self) -> int:
        return int(self._docs_from[0])

    @property
    def total_tokens(self) -> int:
        return int(self._tokens_from[0])

    def longer(self, limit: int) -> int:
        """Documents of more than limit tokens."""
        return int(self._docs_from[np.searchsorted(self.lengths, limit, "right")])

    def truncated_total(self, limit: int) -> int:
        """Tokens left when every document is cut to limit."""
        at = np.searchsorted(self.lengths, limit, "right")
        return self.total_tokens - int(self._tokens_from[at]) + limit * int(self._docs_from[at])

    def quantile(self, q: float) -> int | None:
        """The least length that a share q of the documents does not exceed; None without documents."""
        if not self.total_docs:
            return None
        upto = self.total_docs - self._docs_from[1:]
        return int(self.lengths[np.searchsorted(upto, max(1, int(np.ceil(q * self.total_docs))))])

    def table(self) -> pd.DataFrame:
        """For each length taken as the context limit: documents, tokens and what truncation leaves."""
        after = self._docs_from[1:]
        return pd.DataFrame(
            {
                "n_tokens": self.lengths,
                "n_docs": self.docs,
                "docs_upto": self.total_docs - after,
                "docs_longer": after,
                "tokens_upto": self.total_tokens - self._tokens_from[1:],
                "tokens_longer": self._tokens_from[1:],
                "truncated_tokens": self.total_tokens - self._tokens_from[1:] + self.lengths * after,
                "share_upto": (self.total_docs - after) / max(self.total_docs, 1),
            }
        )


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> LengthHistogram:
    """The histogram of the encoded lengths of all whole texts.

    A null or empty text has length 0. Repeated rows count each time. Other columns are ignored.
    Only the histogram, a row for each distinct length, comes to the driver.
    """
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_batches(path or default_path()), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).toPandas()
    return LengthHistogram(counts["n_tokens"].to_numpy(np.int64), counts["n_docs"].to_numpy(np.int64))


SCHEMA = "n_tokens long, n_docs long, docs_upto long, docs_longer long, tokens_upto long, tokens_longer long, truncated_tokens long, share_upto double"


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The histogram with its suffix sums, as a DataFrame with a row for each distinct length."""
    rows = length_histogram(docs, text_col, path).table()
    return docs.sparkSession.createDataFrame(rows, SCHEMA) if len(rows) else docs.sparkSession.createDataFrame([], SCHEMA)
