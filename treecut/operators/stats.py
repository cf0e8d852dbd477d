"""Corpus accounting (A1-A3): files, bytes and tokens, per group and overall."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tokenize import byte_length, ptb_token_count, tokens


def _token_count(text_col: str, method: str):
    if method == "ptb":
        return ptb_token_count(F.col(text_col))
    return F.size(tokens(F.col(text_col), method))


def _measured(df: DataFrame, text_col: str, group_cols: list[str], method: str) -> DataFrame:
    """Bytes and token count per row, projected before any grouping.

    Computing them here (not inside the aggregate) matters for ``rollup``:
    its Expand copies every row once per grouping set, and a token count
    inside the aggregate would run the cascade that many times.
    """
    return df.select(*group_cols, byte_length(F.col(text_col)).alias("_b"),
                     _token_count(text_col, method).alias("_t"))


def _measures() -> list:
    return [F.count(F.lit(1)).alias("files"), F.sum("_b").cast("bigint").alias("bytes"),
            F.sum("_t").cast("bigint").alias("tokens")]


def corpus_totals(df: DataFrame, text_col: str = "text", group_cols: list[str] | None = None,
                  method: str = "ptb") -> DataFrame:
    """A2: ``files``, ``bytes`` (UTF-8), ``tokens``; grouped when ``group_cols`` is given.

    The token count builds no token array; the aggregate is partial per
    task, then final after a shuffle of one row per group and task.
    """
    m = _measured(df, text_col, group_cols or [], method)
    if group_cols:
        return m.groupBy(*group_cols).agg(*_measures())
    return m.agg(*_measures())


def corpus_rollup(df: DataFrame, group_cols: list[str], text_col: str = "text", method: str = "ptb") -> DataFrame:
    """A2 with subtotals: ``rollup`` over ``group_cols`` plus the grand total.

    ``level`` is the grouping id (0 = finest); NULL keys mark subtotal rows.
    """
    m = _measured(df, text_col, group_cols, method)
    return m.rollup(*group_cols).agg(F.grouping_id().cast("bigint").alias("level"), *_measures())


def batch_totals(batched: DataFrame, text_col: str = "text", batch_col: str = "batch_id",
                 method: str = "ptb") -> DataFrame:
    """A1: files, bytes and tokens per batch."""
    return corpus_totals(batched, text_col, [batch_col], method)


@dataclass
class RunReport:
    seconds: float
    bytes: int
    tokens: int
    files: int

    @property
    def kb_per_s(self) -> float:
        return self.bytes / 1024.0 / self.seconds if self.seconds > 0 else float("nan")

    def line(self) -> str:
        """The reference's timing line (its log format), from the totals."""
        return (f"time: {self.seconds:.3f} secs to tokenize {self.bytes}b, "
                f"{int(self.kb_per_s)}kb/s (tokens:{self.tokens}).")


def run_report(df: DataFrame, text_col: str = "text", method: str = "ptb") -> RunReport:
    """A3: tokenise every row once and measure it.

    Bytes, files and tokens are gathered with ``DataFrame.observe`` while the
    rows flow into the ``noop`` sink, so nothing comes back to the driver but
    three numbers; the wall time is taken on the driver around the action.
    Totals are used for kB/s (the reference divides the last chunk's bytes).
    """
    obs = Observation("treecut_run")
    counted = df.select(F.size(tokens(F.col(text_col), method)).alias("_n"),
                        byte_length(F.col(text_col)).alias("_b"))
    observed = counted.observe(obs, F.count(F.lit(1)).alias("files"),
                               F.coalesce(F.sum("_b"), F.lit(0)).alias("bytes"),
                               F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens"))
    t0 = time.perf_counter()
    observed.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t0
    m = obs.get
    return RunReport(seconds=secs, bytes=int(m["bytes"]), tokens=int(m["tokens"]), files=int(m["files"]))
