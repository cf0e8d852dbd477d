"""Compare two tokenisations of the same texts.

The walk is the reference's greedy resync: step over equal tokens; on a
mismatch look a few tokens ahead on either side for the place where the two
lists meet again, charge a cost, and jump there; stop when no look-ahead
meets.  Only ``min(len a, len b)`` tokens take part and the last pair is
never compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokenize import tokens

# The look-ahead cases in the order they are tried, as
# (kind, tested offset in a, in b, move of i, move of j, cost, context
# width).  "skip" is a one-token mismatch: it costs 1 and moves one step.
LOOKAHEAD = [
    ("skip", 1, 1, 1, 1, 1, 7),
    ("b_jump1", 1, 2, 2, 3, 1, 5),
    ("a_jump1", 2, 1, 3, 2, 1, 5),
    ("a_jump2", 3, 1, 4, 2, 2, 6),
    ("a_jump3", 4, 1, 5, 2, 3, 7),
    ("a_jump5", 6, 1, 7, 2, 5, 9),
]
STOP_CONTEXT = 12


def _eq(a: Column, i: Column, b: Column, j: Column) -> Column:
    # get() is 0-based and NULL past the end: a missing token never matches.
    return F.coalesce(F.get(a, i) == F.get(b, j), F.lit(False))


def token_diff(a: Column | str, b: Column | str) -> Column:
    """``STRUCT<mismatched BIGINT, compared BIGINT>`` for two token arrays.

    A fold (``aggregate``) over the elements of ``a``: each element is one
    turn of the walk, and a finished walk passes its state through.
    JVM-side, linear in the list, no Python.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    n = F.least(F.size(a), F.size(b))
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"),
                    F.lit(0).cast("bigint").alias("c"), F.lit(False).alias("s"))

    def step(acc, _x):
        i, j, c = acc["i"], acc["j"], acc["c"]
        live = (~acc["s"]) & (i < n - 1) & (j < n - 1)

        def to(di, dj, cost, stop=False):
            return F.struct((i + di).alias("i"), (j + dj).alias("j"),
                            (c + F.lit(cost).cast("bigint")).alias("c"), F.lit(stop).alias("s"))

        move = F.when(_eq(a, i, b, j), to(1, 1, 0))
        for _kind, da, db, mi, mj, cost, _w in LOOKAHEAD:
            move = move.when(_eq(a, i + da, b, j + db), to(mi, mj, cost))
        move = move.otherwise(to(0, 0, 0, True))
        done = F.struct(i.alias("i"), j.alias("j"), c.alias("c"), F.lit(True).alias("s"))
        return F.when(live, move).otherwise(done)

    # Each live step moves i by at least one and the walk ends before
    # i = n - 1, so folding over ``a`` itself (size >= n) gives enough steps
    # without allocating a separate index array; extra steps are no-ops.
    res = F.aggregate(a, init, step)
    return F.struct(res["c"].alias("mismatched"), res["i"].cast("bigint").alias("compared"))


def pair_tokenisations(df: DataFrame, key_cols: list[str], text_col: str = "text",
                       base: str = "ptb", other: str = "whitespace") -> DataFrame:
    """J1 for one table: both tokenisations side by side, ``(keys, a, b)``.

    With both lists from the same row no join is needed; ``pair_tables``
    joins two independently produced token tables.
    """
    return df.select(*key_cols, tokens(F.col(text_col), base).alias("a"),
                     tokens(F.col(text_col), other).alias("b"))


def packed(name: Column | str) -> Column:
    """A token list as one text, a token a line; the list itself if a token is
    null or holds a newline (the tokenisers make none of these)."""
    plain = ~F.exists(name, lambda t: t.isNull() | F.contains(t, F.lit("\n")))
    return F.struct(F.size(name).alias("n"), F.when(plain, F.concat_ws("\n", name)).alias("joined"), F.when(plain, None).otherwise(F.col(name)).alias("list"))


def unpacked(name: Column | str) -> Column:
    """The token list that ``packed`` made ``name`` of."""
    p = F.col(name) if isinstance(name, str) else name
    return F.when(p["n"] == 0, F.array().cast("array<string>")).when(p["joined"].isNotNull(), F.split(p["joined"], "\n", -1)).otherwise(p["list"])


def pair_tables(left: DataFrame, right: DataFrame, key_cols: list[str],
                left_col: str = "tokens", right_col: str = "tokens") -> DataFrame:
    """Inner equi-join of two tokenisations on the file/document key.

    The key names one document on each side (a path, a document id), so the
    join is one-to-one and emits no pairs within a key.  The lists are shuffled
    as one text each, not as arrays with a place and padding per token.
    """
    lt = left.select(*key_cols, F.col(left_col).alias("a")).select(*key_cols, packed("a").alias("a"))
    rt = right.select(*key_cols, F.col(right_col).alias("b")).select(*key_cols, packed("b").alias("b"))
    return lt.join(rt, on=key_cols, how="inner").select(*key_cols, unpacked("a").alias("a"), unpacked("b").alias("b"))


def diff_table(pairs: DataFrame, key_cols: list[str]) -> DataFrame:
    """J2 per pair: ``(keys, mismatched, compared, len_a, len_b)``."""
    d = pairs.select(*key_cols, token_diff("a", "b").alias("_d"),
                     F.size("a").cast("bigint").alias("len_a"), F.size("b").cast("bigint").alias("len_b"))
    return d.select(*key_cols, "_d.mismatched", "_d.compared", "len_a", "len_b")


def mismatch_rollup(diffs: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A4: sum of mismatched and compared, and the mismatch rate."""
    aggs = [F.count(F.lit(1)).alias("files"),
            F.sum("mismatched").cast("bigint").alias("mismatched"),
            F.sum("compared").cast("bigint").alias("compared")]
    out = diffs.groupBy(*group_cols).agg(*aggs) if group_cols else diffs.agg(*aggs)
    return out.withColumn(
        "rate", F.round(F.when(F.col("compared") > 0, F.col("mismatched") / F.col("compared")), 6))


#: Turns of the walk of J3 that one inner fold takes.
WALK_BLOCK = 256
#: Bits of a place in an event that the fold holds as one number.
_PLACE = 30


def walk_events(a: Column | str, b: Column | str) -> Column:
    """The mismatches of the walk of ``token_diff``, in order, as an array of
    ``STRUCT<i, j, kind, cost, width>``.

    A fold copies its whole state at every turn.  So the walk is a fold over
    blocks of ``WALK_BLOCK`` turns, each a fold of its own that holds the
    mismatches of the block alone, one number each; those of earlier blocks are
    copied once a block.  A walk that has ended takes no more turns.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    n = F.least(F.size(a), F.size(b))
    cases = [*((kind, cost, width) for kind, _da, _db, _mi, _mj, cost, width in LOOKAHEAD), ("stop", 0, STOP_CONTEXT)]

    def state(i, j, stopped, **lists):
        return F.struct(i.alias("i"), j.alias("j"), stopped.alias("s"), *(x.alias(name) for name, x in lists.items()))

    def live(acc):
        return (~acc["s"]) & (acc["i"] < n - 1) & (acc["j"] < n - 1)

    def turn(acc, _x):
        i, j = acc["i"], acc["j"]

        def to(di, dj, case=None):
            held = acc["open"]
            if case is not None:
                event = (i.cast("bigint") * F.lit(1 << _PLACE) + j) * 8 + case
                held = F.array_append(held, event)
            return state(i + di, j + dj, F.lit(case == len(LOOKAHEAD)), open=held)

        move = F.when(_eq(a, i, b, j), to(1, 1))
        for case, (_kind, da, db, mi, mj, _cost, _width) in enumerate(LOOKAHEAD):
            move = move.when(_eq(a, i + da, b, j + db), to(mi, mj, case))
        return F.when(live(acc), move.otherwise(to(0, 0, len(LOOKAHEAD)))).otherwise(acc)

    def block(acc, k):
        start = state(acc["i"], acc["j"], acc["s"], open=F.array().cast("array<bigint>"))
        walked = F.aggregate(F.slice(a, k * WALK_BLOCK + 1, F.lit(WALK_BLOCK)), start, turn,
                             lambda r: state(r["i"], r["j"], r["s"], full=F.array_append(acc["full"], r["open"])))
        return F.when(live(acc), walked).otherwise(acc)

    def event(x):
        case = (F.pmod(x, F.lit(8)) + 1).cast("int")
        kind, cost, width = (F.element_at(F.array(*map(F.lit, c)), case) for c in zip(*cases))
        return F.struct(F.shiftright(x, _PLACE + 3).alias("i"), F.pmod(F.shiftright(x, 3), F.lit(1 << _PLACE)).alias("j"),
                        kind.alias("kind"), cost.cast("bigint").alias("cost"), width.cast("bigint").alias("width"))

    init = state(F.lit(0), F.lit(0), F.lit(False), full=F.array().cast("array<array<bigint>>"))
    blocks = F.sequence(F.lit(0), F.floor(F.size(a) / WALK_BLOCK).cast("int"))
    return F.transform(F.aggregate(blocks, init, block, lambda acc: F.flatten(acc["full"])), event)


def diff_rows(pairs: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per mismatch with its kind, cost and context on both sides.

    Context is tokens ``i-2 .. i+width-3`` of ``a`` and ``j-2 ..`` of ``b``
    (clipped at the start), joined by spaces.  The contexts are cut from the
    arrays while they are still one row per pair (``transform`` over the
    events, JVM-side), so the explode copies only the small event structs,
    never the token arrays.
    """
    def ctx(arr: str, k: Column, width: Column) -> Column:
        start = F.greatest(k - F.lit(2), F.lit(0))
        stop = k + width - F.lit(2)
        return F.concat_ws(" ", F.slice(F.col(arr), (start + 1).cast("int"), (stop - start).cast("int")))

    walked = pairs.select(*key_cols, "a", "b", walk_events("a", "b").alias("_ev"))
    events = F.transform("_ev", lambda e, seq: F.struct(
        seq.cast("bigint").alias("seq"), e["i"].alias("i"), e["j"].alias("j"), e["kind"].alias("kind"),
        e["cost"].alias("cost"), ctx("a", e["i"], e["width"]).alias("a_context"),
        ctx("b", e["j"], e["width"]).alias("b_context")))
    ev = walked.select(*key_cols, F.explode(events).alias("e"))
    return ev.select(*key_cols, "e.seq", "e.i", "e.j", "e.kind", "e.cost", "e.a_context", "e.b_context")


def file_pairs(spark, path: str, base: str = "ptb", other: str = "ptb_lines") -> DataFrame:
    """J1 on a corpus folder or file: ``(path, a, b)``, every file tokenised two ways."""
    from ..sources.files import read_corpus
    return pair_tokenisations(read_corpus(spark, path), ["path"], "text", base, other)


def batch_token_runs(batched: DataFrame, batch_col: str = "batch_id", order_cols: tuple[str, ...] = ("doc_id",),
                     text_col: str = "text", method: str = "ptb", as_text: bool = False) -> DataFrame:
    """``(batch, off, n, tokens)``: the tokens of a batch's documents in order, each
    document's (``as_text``: ``packed``) with the place of its first token in the batch
    and their number.

    The marks ``...`` and ``--`` are spaced, as in parts that are read back.  The
    places are sums over a row of numbers per document; a batch's texts or
    tokens never meet in a row.
    """
    from ..functions.tokenize import normalise_marks, ptb_text, split_tokens, token_text
    from ..session import scratch_path
    # The marks hold no blank, so they are spaced before the text is split, and once.
    text = ptb_text(text_col) if method == "ptb" else token_text(tokens(F.col(text_col), method))
    spaced = split_tokens(normalise_marks(text))
    t = batched.select(F.col(batch_col).cast("bigint").alias(batch_col), *order_cols, F.coalesce(spaced, F.array().cast("array<string>")).alias("tokens"))
    t = t.select(batch_col, *order_cols, F.monotonically_increasing_id().alias("_row"), F.size("tokens").alias("_n"), packed("tokens").alias("tokens"))
    out = scratch_path(batched.sparkSession, f"batch_tokens/{uuid.uuid4().hex}")
    t.write.parquet(out)
    written = batched.sparkSession.read.schema(t.schema).parquet(out)
    earlier = Window.partitionBy(batch_col).orderBy(*order_cols, "_row").rowsBetween(Window.unboundedPreceding, -1)
    places = written.select("_row", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("bigint").alias("off"))
    lists = written.select(batch_col, "_row", F.col("_n").alias("n"), "tokens")
    placed = lists.join(places, "_row").select(batch_col, "off", "n", "tokens")
    return placed if as_text else placed.withColumn("tokens", unpacked("tokens"))


def compare_with_parts(batched: DataFrame, folder: str, batch_col: str = "batch_id", order_cols: tuple[str, ...] = ("doc_id",),
                       text_col: str = "text", method: str = "ptb", size: int | None = None):
    """J1 with S7: the tokens of every batch against those of its part in
    ``folder``, in chunks (``chunked.Chunked``), so parts may have any size."""
    from ..sources.files import token_part_runs
    from .chunked import CHUNK, Chunked
    left = batch_token_runs(batched, batch_col, order_cols, text_col, method, as_text=True)
    return Chunked(left, token_part_runs(batched.sparkSession, folder, batch_col, as_text=True), [batch_col], size or CHUNK)


def compare_large_files(spark, path: str, base: str = "ptb", other: str = "ptb_lines", cut: str = "lines",
                        size: int | None = None, piece: int | None = None):
    """``compare_files`` for files larger than a cell: both tokenisations of every
    file as runs (S4), compared in chunks (``chunked.Chunked``)."""
    from ..sources.files import PIECE, file_token_runs
    from .chunked import CHUNK, Chunked
    runs = [file_token_runs(spark, path, cut, piece or PIECE, method, as_text=True) for method in (base, other)]
    return Chunked(*runs, ["path"], size or CHUNK)


def compare_files(spark, path: str, base: str = "ptb", other: str = "ptb_lines") -> DataFrame:
    """The comparison run end to end on a corpus folder or file: every file
    tokenised two ways (S1/S2 + F1), walked (J2), one row per file with
    ``(path, mismatched, compared, len_a, len_b)``; ``mismatch_rollup`` of
    the result gives the totals and the rate (A4)."""
    return diff_table(file_pairs(spark, path, base, other), ["path"])
