"""Token tables, previews and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokenize import WS_CLASS, token_text, tokens

PREVIEW_FIRST = 50
PREVIEW_LAST = 10
# The reference's preview layout (first 50, a dotted gap, last
# 10, the count) and its default caps.
PREVIEW_GAP = "........................................"
RETAIN_K = 1000
OUTPUT_CAP = 11_000_000


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens", method: str = "ptb") -> DataFrame:
    """Add the token array of a text column."""
    return df.withColumn(out, tokens(F.col(text_col), method))


def token_table(df: DataFrame, id_cols: list[str], text_col: str = "text", method: str = "ptb") -> DataFrame:
    """F8: one row per token, ``(*id_cols, pos, token)``, ``pos`` from 0.

    ``posexplode_outer`` plus a null filter on the exploded side keeps the
    cascade evaluated once per row: a plain ``posexplode`` makes Catalyst
    infer ``size(tokens) > 0`` and push it under the projection, which would
    run the cascade again.
    """
    exploded = df.select(*id_cols, F.posexplode_outer(tokens(F.col(text_col), method)).alias("pos", "token"))
    return exploded.where(F.col("token").isNotNull()).select(
        *id_cols, F.col("pos").cast("bigint").alias("pos"), "token")


def first_tokens(arr: Column | str, k: int = PREVIEW_FIRST) -> Column:
    """L1 / L3: the first ``k`` tokens."""
    return F.slice(F.col(arr) if isinstance(arr, str) else arr, 1, k)


def last_tokens(arr: Column | str, k: int = PREVIEW_LAST) -> Column:
    """L2: the last ``k`` tokens (all of them when there are fewer)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, F.greatest(F.size(a) - F.lit(k - 1), F.lit(1)), k)


def _preview(first: Column, last: Column, n_tokens: Column) -> Column:
    def each_then_comma(part: Column) -> Column:
        # "t1,t2,...,tk," - every token followed by a comma (codegen'd, no lambda).
        return F.concat(F.concat_ws(",", part), F.when(F.size(part) > 0, F.lit(",")).otherwise(F.lit("")))

    return F.concat(each_then_comma(first), F.lit(PREVIEW_GAP), each_then_comma(last),
                    F.lit("("), n_tokens.cast("string"), F.lit(" tokens)"))


def preview_line(arr: Column | str) -> Column:
    """The reference's preview: ``t1,...,t50,<gap>t-10,...,t-1,(N tokens)``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return _preview(first_tokens(a), last_tokens(a), F.size(a))


def previews(df: DataFrame, id_cols: list[str], text_col: str = "text", method: str = "ptb") -> DataFrame:
    """Per document: preview line, first and last tokens as text, count."""
    t = df.select(*id_cols, tokens(F.col(text_col), method).alias("_t"))
    return t.select(
        *id_cols,
        F.size("_t").cast("bigint").alias("n_tokens"),
        token_text(first_tokens("_t")).alias("first_tokens"),
        token_text(last_tokens("_t")).alias("last_tokens"),
        preview_line("_t").alias("preview"),
    )


def corpus_head(table: DataFrame, order_cols: list[str], k: int = PREVIEW_FIRST) -> DataFrame:
    """Corpus-wide first ``k`` tokens: a top-k (TakeOrderedAndProject), no global sort."""
    return table.orderBy(*[F.col(c).asc() for c in order_cols]).limit(k)


def corpus_tail(table: DataFrame, order_cols: list[str], k: int = PREVIEW_LAST) -> DataFrame:
    """Corpus-wide last ``k`` tokens, returned in reading order."""
    last = table.orderBy(*[F.col(c).desc() for c in order_cols]).limit(k)
    return last.orderBy(*order_cols)


def _edge_tokens(df: DataFrame, id_cols: list[str], text_col: str, k: int, method: str, last: bool) -> DataFrame:
    """Token rows of the first or last ``k`` documents that have tokens.

    Every text with a character that is not white space has a token, so the first
    (last) ``k`` tokens of a corpus lie in its first (last) ``k`` such documents:
    a top-k on the keys (TakeOrderedAndProject) finds them, and only those ``k``
    texts are tokenised.
    """
    filled = df.select(*id_cols, F.col(text_col).alias("_x")).where(F.col("_x").rlike(f"[^{WS_CLASS[1:-1]}]"))
    docs = filled.orderBy(*[F.col(c).desc() if last else F.col(c).asc() for c in id_cols]).limit(k)
    t = docs.select(*id_cols, tokens(F.col("_x"), method).alias("_t"))
    part = last_tokens("_t", k) if last else first_tokens("_t", k)
    skipped = F.greatest(F.size("_t") - F.lit(k), F.lit(0)) if last else F.lit(0)
    rows = t.select(*id_cols, skipped.alias("_skipped"), F.posexplode_outer(part).alias("pos", "token"))
    return rows.where(F.col("token").isNotNull()).select(
        *id_cols, (F.col("_skipped") + F.col("pos")).cast("bigint").alias("pos"), "token")


def corpus_preview_head(df: DataFrame, id_cols: list[str], text_col: str = "text", k: int = PREVIEW_FIRST,
                        method: str = "ptb") -> DataFrame:
    """L1 over a corpus: its first ``k`` tokens in (key, pos) order."""
    return corpus_head(_edge_tokens(df, id_cols, text_col, k, method, last=False), id_cols + ["pos"], k)


def corpus_preview_tail(df: DataFrame, id_cols: list[str], text_col: str = "text", k: int = PREVIEW_LAST,
                        method: str = "ptb") -> DataFrame:
    """L2 over a corpus: its last ``k`` tokens, in reading order."""
    return corpus_tail(_edge_tokens(df, id_cols, text_col, k, method, last=True), id_cols + ["pos"], k)


def batch_previews(docs: DataFrame, batch_col: str, order_cols: list[str], text_col: str = "text",
                   method: str = "ptb", first: int = PREVIEW_FIRST, last: int = PREVIEW_LAST) -> DataFrame:
    """L1 + L2 per batch: ``n_tokens``, the first and last tokens as text and the
    preview line of each batch, in document order.

    The tokens that earlier and later documents of the batch hold are sums over
    a window of one row per document; only documents at the edges keep tokens,
    so a batch's group holds at most ``first + last`` of them.
    """
    t = docs.select(batch_col, *order_cols, tokens(F.col(text_col), method).alias("_t"))
    small = t.select(batch_col, *order_cols, F.size("_t").alias("_n"), first_tokens("_t", first).alias("_f"),
                     last_tokens("_t", last).alias("_l"))
    w = Window.partitionBy(batch_col).orderBy(*order_cols)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(batch_col))
    placed = small.withColumn("_before", before).withColumn("_total", total)
    after = F.col("_total") - F.col("_before") - F.col("_n")
    head = F.when(F.col("_before") < first, F.slice("_f", F.lit(1), F.greatest(F.lit(first) - F.col("_before"), F.lit(0)).cast("int")))
    room = F.greatest(F.lit(last) - after, F.lit(0)).cast("int")
    tail = F.when(after < last, F.slice("_l", F.greatest(F.size("_l") - room + 1, F.lit(1)), room))
    edge = F.struct(*order_cols, head.alias("_h"), tail.alias("_e"))
    g = placed.groupBy(batch_col).agg(
        F.first("_total").cast("bigint").alias("n_tokens"),
        F.sort_array(F.collect_list(F.when(head.isNotNull() | tail.isNotNull(), edge))).alias("_edges"))
    none = F.array().cast("array<string>")
    whole = g.select(batch_col, "n_tokens",
                     F.flatten(F.transform("_edges", lambda x: F.coalesce(x["_h"], none))).alias("_h"),
                     F.flatten(F.transform("_edges", lambda x: F.coalesce(x["_e"], none))).alias("_e"))
    line = _preview(F.col("_h"), F.col("_e"), F.col("n_tokens"))
    return whole.select(batch_col, "n_tokens", token_text("_h").alias("first_tokens"),
                        token_text("_e").alias("last_tokens"), line.alias("preview"))


def retain_k(df: DataFrame, id_cols: list[str], text_col: str = "text", k: int = RETAIN_K,
             method: str = "ptb") -> DataFrame:
    """L3: keep the first ``k`` tokens, count them all."""
    t = df.select(*id_cols, tokens(F.col(text_col), method).alias("_t"))
    return t.select(*id_cols, F.size("_t").cast("bigint").alias("n_tokens"),
                    token_text(first_tokens("_t", k)).alias("kept"))


def output_cap(docs: DataFrame, group_col: str, doc_cols: list[str], text_col: str = "text",
               cap: int = OUTPUT_CAP, method: str = "ptb") -> DataFrame:
    """L4: token rows ``(group, *doc_cols, pos, token)`` keeping the first
    ``cap`` tokens of every output part (``group_col``), in document order.

    One pass: each document is tokenised once; a window over the
    *documents* of a part (one row each, carrying its token array) gives the
    tokens of the earlier documents; the array is sliced to what still fits
    and only that is exploded.  Parts are size-bounded batches (W1), so every
    window partition is bounded too.
    """
    t = docs.select(group_col, *doc_cols, tokens(F.col(text_col), method).alias("_t"))
    kept = capped(t, group_col, doc_cols, "_t", cap).withColumnRenamed("_t", "_k")
    rows = kept.select(group_col, *doc_cols, F.posexplode_outer("_k").alias("pos", "token"))
    return rows.where(F.col("token").isNotNull()).select(
        group_col, *doc_cols, F.col("pos").cast("bigint").alias("pos"), "token")


def capped(tokenised: DataFrame, group_col: str, doc_cols: list[str], tokens_col: str, cap: int) -> DataFrame:
    """Token arrays cut to the first ``cap`` tokens of each group, in document order."""
    w = Window.partitionBy(group_col).orderBy(*doc_cols).rowsBetween(Window.unboundedPreceding, -1)
    t = tokenised.withColumn("_off", F.coalesce(F.sum(F.size(tokens_col)).over(w), F.lit(0)))
    room = F.greatest(F.lit(cap) - F.col("_off"), F.lit(0))
    return t.where(room > 0).withColumn(tokens_col, F.slice(tokens_col, 1, room.cast("int"))).drop("_off")
