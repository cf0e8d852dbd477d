"""Token sink (S6): one token per line, one part folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import tokens
from ..operators.tokens import capped


def part_lines(docs: DataFrame, batch_col: str = "batch_id", order_cols: tuple[str, ...] = ("doc_id",),
               text_col: str = "text", method: str = "ptb", cap: int | None = None) -> DataFrame:
    """``(batch, value)``: the tokens of a document as one value of many lines, a
    batch's documents in one task and in order; none for documents without tokens."""
    cols = [batch_col, *order_cols]
    ordered = docs.select(*cols, text_col).repartition(F.col(batch_col)).sortWithinPartitions(*cols)
    t = ordered.select(*cols, tokens(F.col(text_col), method).alias("_t"))
    if cap is not None:
        t = capped(t, batch_col, list(order_cols), "_t", cap)
    # A filter on the tokens would be pushed below the shuffle and make them twice.
    value = F.when(F.size("_t") > 0, F.array(F.concat_ws("\n", "_t")))
    return t.select(batch_col, F.explode_outer(value).alias("value")).where(F.col("value").isNotNull())


def write_token_parts(docs: DataFrame, out: str, batch_col: str = "batch_id", order_cols: tuple[str, ...] = ("doc_id",),
                      text_col: str = "text", method: str = "ptb", cap: int | None = None) -> None:
    """Write the tokens of ``docs`` one per line into ``out/<batch_col>=<id>/``; old
    output is replaced.

    The documents of a batch are hashed to one task and sorted there by
    ``order_cols``, so every batch is one file in reading order; only then are
    they tokenised, so texts are moved, never token rows, and a document is
    written as one value of many lines.  Batches are size-bounded (W1), which
    bounds each task.  ``cap`` keeps the first tokens of each part (L4).
    """
    lines = part_lines(docs, batch_col, order_cols, text_col, method, cap)
    # Static overwrite: the whole folder is replaced even if the session is
    # set to dynamic partition overwrite (stale parts must not survive).
    (lines.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(batch_col).text(out))
