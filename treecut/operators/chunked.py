"""Comparison of token lists of any length, in chunks.

``token_diff`` folds over two whole lists in one row.  Here both lists are rows of
tokens: one document may have any number of them, and no row or task ever holds
more than a few spans of ``SPAN`` tokens.

1. Both lists are cut into spans of whole chunks; a list that lies in its first span
   on both sides needs no more exchange.  Of a longer one every span of the left list
   guesses where the walk enters it: letters and digits are counted on both sides,
   and the place with as many before it is looked up on the right.
2. In a span every chunk guesses its entry in the same way, and takes the nearby place
   where most of the next tokens agree.  All chunks are walked at once from their
   guesses (``walks``).  A chunk notes the states that it passes at its start and
   the state in which it leaves.
3. Where the state in which the chunk before leaves is one of those passed, the
   walks are one walk, whatever the guess was.  The other chunks are walked again
   from the state in which the chunk before leaves, until all of a span's chunks up
   to the end of its walk are linked.  Each round settles at least one more chunk,
   and walks on over four times as many chunks as the round before.
4. The spans of a list are linked in the same way: a span whose first chunk did not
   pass the state in which the span before leaves is walked again from that state.
   Lists whose guesses all fail need a round per span; settled lists leave the rounds.

The answer never depends on the guesses.  Costs and event numbers are sums over
the chunks of a document, a row of numbers each.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path
from . import walks
from .compare import packed, unpacked
from .walks import MARKS

#: Tokens of a chunk.
CHUNK = 4096
#: Tokens that a chunk shows of its neighbours: the widest context before, and
#: the furthest look-ahead or context behind.
BEFORE, BEHIND = 2, 16
#: Tokens of a span, the row in which chunks are walked; at least a chunk.
SPAN = 4 * CHUNK

_PARTS = "array<struct<at:bigint,p:struct<n:int,joined:string,list:array<string>>>>"
_ENTRIES = "array<struct<c:bigint,i:bigint,j:bigint,ink:bigint>>"
_LINKED = "_s bigint, chunks array<struct<c:bigint,i:bigint,j:bigint,cost:bigint,ended:boolean,to:bigint>>, noted array<struct<i:bigint,j:bigint,cost:bigint>>, i bigint, j bigint, ended boolean, rounds bigint"
_EVENTS = "_s bigint, seq bigint, i bigint, j bigint, kind string, cost bigint, a_context string, b_context string"


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared scratch folder and read back."""
    out = scratch_path(df.sparkSession, f"chunked/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _count(runs: DataFrame) -> Column:
    """The tokens of a run: ``n`` where the runs tell it, so that sums need no tokens."""
    return F.col("n") if "n" in runs.columns else F.size("tokens")


def windows(runs: DataFrame, keys: list[str], size: int, before: int, behind: int) -> DataFrame:
    """``(keys, c, at, tokens)``: the tokens ``c * size - before`` to ``(c + 1) * size
    + behind`` of every list, with the place of the first, for every ``c`` that has
    tokens of its own.  ``runs``: ``(keys, off, tokens)``, any pieces of the lists
    with the place of their first token.  Pieces are shuffled as one text each."""
    pieces = _pieces(runs, keys, size, before, behind).where(F.col("part.n") > 0)
    whole = pieces.select(*keys, "_s", F.struct("at", F.col("part").alias("p")).alias("_p")).groupBy(*keys, "_s").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    at, tokens = _together(F.col("_p"))
    return whole.select(*keys, F.col("_s").alias("c"), at.alias("at"), unpacked(tokens).alias("tokens")).where(F.col("at") + F.size("tokens") > F.col("c") * size)


def _pieces(runs: DataFrame, keys: list[str], size: int, before: int, behind: int) -> DataFrame:
    """``(keys, _s, at, own, part)``: what the window ``_s`` takes of a run, packed, and how
    many of these tokens are its own.  A run without tokens is a piece of the first
    window.  Runs that are packed stay so, unless a window takes a part of one only."""
    n, s = _count(runs), F.col("_s")
    lists = isinstance(runs.schema["tokens"].dataType, T.ArrayType)
    tokens = F.col("tokens") if lists else unpacked("tokens")
    some = F.coalesce(F.col("_n") > 0, F.lit(False))
    first = F.when(some, F.greatest(F.floor((F.col("off") - behind) / size), F.lit(0))).otherwise(F.lit(0))
    last = F.when(some, F.floor((F.col("off") + F.col("_n") - 1 + before) / size)).otherwise(F.lit(0))
    cut = runs.select(*keys, "off", n.alias("_n"), "tokens").select(*keys, "off", "_n", "tokens", F.explode(F.sequence(first, last)).alias("_s"))
    off, end = F.col("off"), F.col("off") + F.col("_n")
    start, stop = F.greatest(off, s * size - before), F.least(end, (s + 1) * size + behind)
    own = F.greatest(F.least(end, (s + 1) * size) - F.greatest(off, s * size), F.lit(0))
    taken = F.slice(tokens, (start - off + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    none, whole = F.array().cast("array<string>"), (start <= off) & (stop >= end)
    if lists:
        cut = cut.withColumn("_part", F.when(~some, none).when(whole, F.col("tokens")).otherwise(taken))
        part = packed("_part")
    else:
        cut = cut.withColumn("_part", F.when(~some, none).when(~whole, taken))
        part = F.when(some & whole, F.col("tokens")).otherwise(packed("_part"))
    return cut.select(*keys, s.cast("bigint").alias("_s"), F.greatest(start, F.lit(0)).cast("bigint").alias("at"), F.when(F.col("_n").isNotNull(), own).cast("bigint").alias("own"), part.alias("part"))


def _together(parts: Column) -> tuple[Column, Column]:
    """Sorted pieces (``at``, packed ``p``) that follow each other as one: the place of
    the first token and all tokens, packed."""
    n = F.aggregate(parts, F.lit(0), lambda sum, x: sum + x["p"]["n"])
    plain = F.struct(n.alias("n"), F.concat_ws("\n", F.transform(parts, lambda x: x["p"]["joined"])).alias("joined"), F.lit(None).cast("array<string>").alias("list"))
    other = F.struct(n.alias("n"), F.lit(None).cast("string").alias("joined"), F.flatten(F.transform(parts, lambda x: unpacked(x["p"]))).alias("list"))
    whole = F.when(F.size(parts) == 1, F.get(parts, 0)["p"]).when(F.forall(parts, lambda x: x["p"]["joined"].isNotNull()), plain).otherwise(other)
    return F.get(parts, 0)["at"], F.when(F.size(parts) > 0, whole)


class Chunked:
    """Two token lists per key as chunks.  ``left`` and ``right``: ``(keys, off,
    tokens)``, any runs of the lists' tokens (maybe packed) with the place of their first,
    and maybe ``n``, their number; a list without tokens has a run without any.  Keys on
    both sides are compared (J1)."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str], size: int = CHUNK) -> None:
        if size < 2 * BEHIND:
            raise ValueError(f"chunks have {2 * BEHIND} tokens at least")
        self.keys, self.size = keys, size
        #: Chunks of a span, and its tokens.
        self.per = max(SPAN // size, 1)
        self.span = self.per * size
        self.spans = _written(self._spans(left, right), "spans")
        known = functools.reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
        lengths = self.spans.where(known).groupBy(*keys).agg(F.max("has_a").alias("_a"), F.max("has_b").alias("_b"), F.sum("a_own").cast("bigint").alias("len_a"), F.sum("b_own").cast("bigint").alias("len_b"))
        self.lengths = _written(lengths.where("_a and _b").drop("_a", "_b"), "lengths")
        own = lambda side: F.coalesce(F.col(f"{side}_own"), F.lit(0))
        self._short = (own("a") < self.span) & (own("b") < self.span)
        # Lists that lie in their first span on both sides, told from that span alone.
        direct = self.spans.where(known & (F.col("_s") == 0) & F.col("has_a") & F.col("has_b") & self._short)
        self._direct = direct.select(*keys, "_s", own("a").alias("len_a"), own("b").alias("len_b"), "a_at", "a", "b_at", "b", F.lit(None).cast(_ENTRIES).alias("_e"))
        self.rounds = 0
        self.linked = self._link()

    def _same(self, *extra: str) -> list[str]:
        return [*self.keys, *extra]

    def _spans(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """A row per key and span that has tokens: the left list's window, what the right
        list has in the span, how many tokens of either are the span's own, and the
        letters and digits in these for lists that are longer than a span."""
        sides = []
        for side, runs, before, behind in ((0, left, BEFORE, BEHIND), (1, right, 0, 0)):
            pieces = _pieces(runs, self.keys, self.span, before, behind)
            sides.append(pieces.select(*self.keys, "_s", F.lit(side).alias("_side"), "own", F.struct("at", F.col("part").alias("p")).alias("_p")))
        on = [F.col("_side") == side for side in (0, 1)]
        aggs = [F.max(x).alias(f"has_{side}") for x, side in zip(on, "ab")] + [F.sum(F.when(x, F.col("own"))).alias(f"{side}_own") for x, side in zip(on, "ab")]
        aggs += [F.sort_array(F.collect_list(F.when(x & (F.col("_p.p.n") > 0), F.col("_p")))).cast(_PARTS).alias(f"_{side}") for x, side in zip(on, "ab")]
        whole = sides[0].unionByName(sides[1]).groupBy(*self.keys, "_s").agg(*aggs)
        parts = [x.alias(name) for side in "ab" for x, name in zip(_together(F.col(f"_{side}")), (f"{side}_at", side))]
        spans = whole.select(*self.keys, "_s", "has_a", "has_b", "a_own", "b_own", *parts)
        long = (F.col("_s") > 0) | (F.col("a_own") >= self.span) | (F.col("b_own") >= self.span)
        letters = lambda side: F.length(F.translate(F.concat_ws("", self._own_tokens(side)), MARKS, "")).cast("bigint")
        spans = spans.withColumns({f"{side}_ink": F.when(long & (F.col(f"{side}_own") > 0), letters(side)) for side in "ab"})
        return spans.where((F.col("_s") == 0) | (F.col("a_own") > 0) | (F.col("b_own") > 0))

    def _own_tokens(self, side: str) -> Column:
        skipped = F.col("_s") * self.span - F.col(f"{side}_at")
        return F.slice(unpacked(side), (skipped + 1).cast("int"), self.span)

    def _chunks(self, side: str, before: int, behind: int) -> DataFrame:
        """``(keys, c, at, tokens)``: the windows of the chunks, cut from those of the spans."""
        spans = self.spans.where(F.col(f"{side}_own") > 0).select(*self.keys, "_s", F.col(f"{side}_at").alias("_at"), F.col(f"{side}_own").alias("_own"), unpacked(side).alias("_t"))
        first = F.col("_s") * self.per
        cut = spans.withColumn("c", F.explode(F.sequence(first, first + F.floor((F.col("_own") - 1) / self.size))))
        at = F.greatest(F.col("c") * self.size - before, F.col("_at"))
        stop = (F.col("c") + 1) * self.size + behind
        return cut.select(*self.keys, "c", at.alias("at"), F.slice("_t", (at - F.col("_at") + 1).cast("int"), (stop - at).cast("int")).alias("tokens"))

    @property
    def a(self) -> DataFrame:
        return self._chunks("a", BEFORE, BEHIND)

    @property
    def b(self) -> DataFrame:
        return self._chunks("b", 0, 0)

    def _own(self, side: DataFrame) -> DataFrame:
        """The tokens that belong to a chunk, without its neighbours'."""
        skipped = F.col("c") * self.size - F.col("at")
        return side.select(*self.keys, "c", F.slice("tokens", (skipped + 1).cast("int"), self.size).alias("own"))

    def _guesses(self) -> DataFrame:
        """``(keys, c, i, j, ink)``: where the spans of lists longer than one look for their
        entry, said of their first chunk: about at ``j``, behind ``ink`` letters and
        digits of the span of ``j``.  A row of numbers per span."""
        longer = self.lengths.where((F.col("len_a") >= self.span) | (F.col("len_b") >= self.span)).select(*self.keys)
        sides = [self.spans.where(F.col(f"{side}_own") > 0).select(*self.keys, F.lit(k).alias("_side"), "_s", F.coalesce(f"{side}_ink", F.lit(0)).alias("_ink"), F.col(f"{side}_own").alias("_n")) for k, side in enumerate("ba")]
        numbers = _written(sides[0].unionByName(sides[1]).join(longer, self.keys, "left_semi"), "ink")
        earlier = Window.partitionBy(*self.keys, "_side").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        placed = numbers.withColumn("_before", F.coalesce(F.sum("_ink").over(earlier), F.lit(0)))
        here = F.when(F.col("_side") == 0, F.struct("_s", "_before", "_ink", "_n"))
        upto = Window.partitionBy(*self.keys).orderBy("_before", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
        found = placed.withColumn("_at", F.last(here, ignorenulls=True).over(upto)).where("_side = 1")
        ink = F.least(F.col("_before") - F.col("_at._before"), F.col("_at._ink"))
        inside = F.least(F.floor(ink / F.greatest("_at._ink", F.lit(1)) * F.col("_at._n")), F.col("_at._n") - 1)
        j = F.when(F.col("_s") == 0, F.lit(0)).otherwise(F.coalesce(F.col("_at._s") * self.span + inside, F.lit(0)))
        return found.select(*self.keys, (F.col("_s") * self.per).alias("c"), (F.col("_s") * self.span).alias("i"), j.cast("bigint").alias("j"), ink.cast("bigint").alias("ink"))

    def _with_tokens(self, entries: DataFrame) -> DataFrame:
        """The spans in which ``entries`` (``keys, c, i, j``, maybe ``ink``) lie, with these
        as ``_e`` and the tokens that walks over the span from there see."""
        told = "ink" in entries.columns
        entry = F.struct("c", "i", "j", F.col("ink") if told else F.lit(None).cast("bigint").alias("ink"))
        e = entries.groupBy(*self.keys, F.floor(F.col("c") / self.per).alias("_s")).agg(F.sort_array(F.collect_list(entry)).cast(_ENTRIES).alias("_e"), F.min("j").alias("_low"), F.max("j").alias("_high"))
        e = e.join(self.lengths.select(*self.keys, F.coalesce("len_a", F.lit(0)).alias("len_a"), F.coalesce("len_b", F.lit(0)).alias("len_b")), self.keys)
        # A walk moves three tokens on the right for two on the left at most.
        room = walks.around(self.size) + 4 * BEHIND + (walks.slack(self.span) if told else 0)
        ahead = F.greatest(F.get("_e", 0)["j"] + self.span + self.span // 2, F.col("_high") + self.size + self.size // 2) + room
        first = F.floor(F.greatest(F.col("_low") - room, F.lit(0)) / self.span)
        last = F.floor(F.least(ahead, F.col("len_b") - 1) / self.span)
        right = e.where(first <= last).select(*self.keys, "_s", F.explode(F.sequence(first, last)).alias("_q"))
        blocks = self.spans.where("b_own > 0").select(*self.keys, F.col("_s").alias("_q"), F.struct(F.col("b_at").alias("at"), F.col("b").alias("p")).alias("_p"))
        b = right.join(blocks, self._same("_q")).groupBy(*self.keys, "_s").agg(F.sort_array(F.collect_list("_p")).cast(_PARTS).alias("_b"))
        b = b.select(*self.keys, "_s", *(x.alias(name) for x, name in zip(_together(F.col("_b")), ("b_at", "b"))))
        a = self.spans.where("a_own > 0").select(*self.keys, "_s", "a_at", "a")
        # An entry behind the right list's end has no tokens there.
        seen = e.join(a, self._same("_s")).join(b, self._same("_s"), "left")
        return seen.select(*self.keys, "_s", "len_a", "len_b", "a_at", "a", "b_at", "b", "_e")

    def _in_tasks(self, seen: DataFrame, work: Callable, fields: str, flag: bool) -> DataFrame:
        """``work`` (of ``walks``) on the spans ``seen``, in the tasks that read them."""
        schema = T.StructType([*(seen.schema[k] for k in self.keys), *T.StructType.fromDDL(fields).fields])
        run = functools.partial(work, self.keys, self.size, self.span, flag, schema.names)
        return seen.mapInArrow(run, schema)

    def _nudged(self, seen: DataFrame) -> DataFrame:
        """Guesses are moved to the nearby place where most of the next tokens agree: says
        how far the chunks of ``seen`` look for it."""
        return seen.withColumn("_around", F.lit(walks.around(self.size)))

    def _walked(self, seen: DataFrame, exact: bool = False) -> DataFrame:
        """The linked chunks of every span, the states noted in its first one and the
        state in which it is left.  ``exact``: the first entries are known."""
        return self._in_tasks(self._nudged(seen), walks.linked, _LINKED, exact)

    def _link(self) -> DataFrame:
        """Every chunk up to the end of its list's walk with its true entry (``i``,
        ``j``) and what the walk costs there, the last one with ``ended``."""
        guesses = _written(self._guesses(), "guesses")
        # Short lists are walked as they lie, unless there are guesses for them, too.
        if not guesses.join(self.lengths.where(F.greatest("len_a", "len_b") < self.span), self.keys, "left_semi").isEmpty():
            self._direct = self._direct.join(guesses.select(*self.keys).distinct(), self.keys, "left_anti")
        direct = _written(self._walked(self._direct), "walked")
        self.rounds = direct.agg(F.max("rounds")).first()[0] or 0
        settled = [self._chunk_rows(direct)]
        self._longer = None
        if not guesses.isEmpty():
            settled.append(self._linked_spans(_written(self._walked(self._with_tokens(guesses)), "walked")))
            self._longer = settled[-1]
        return functools.reduce(DataFrame.unionByName, settled)

    def _chunk_rows(self, spans: DataFrame) -> DataFrame:
        return spans.select(*self.keys, F.explode("chunks").alias("_x")).select(*self.keys, "_x.c", "_x.i", "_x.j", "_x.cost", "_x.ended", "_x.to")

    def _linked_spans(self, walked: DataFrame) -> DataFrame:
        """The spans of longer lists linked: the rows of their chunks."""
        order = Window.partitionBy(*self.keys).orderBy("_s")
        settled, rounds = [], 0
        self.rounds = max(self.rounds, walked.agg(F.max("rounds")).first()[0] or 0)
        while True:
            rounds += 1
            entry = F.lag(F.struct("i", "j", "ended")).over(order)
            seen = walked.withColumn("_entry", F.when(F.col("_s") > 0, entry))
            passed = F.get(F.filter("noted", lambda s: (s["i"] == F.col("_entry.i")) & (s["j"] == F.col("_entry.j"))), 0)
            # A walk that ends where it is entered notes nothing and costs nothing.
            seen = seen.withColumn("_passed", F.when(F.col("_s") == 0, F.lit(0)).when(~F.col("_entry.ended"), passed["cost"]))
            numbers = _written(seen.select(*self.keys, "_s", "_entry", "_passed", F.col("_passed").isNotNull().alias("_linked"), "ended", "chunks"), "links")
            first = numbers.groupBy(*self.keys).agg(F.min(F.when(~F.col("_linked"), F.col("_s"))).alias("_bad"), F.min(F.when(F.col("_linked") & F.col("ended"), F.col("_s"))).alias("_end"))
            is_open = F.col("_bad").isNotNull() & (F.col("_end").isNull() | (F.col("_bad") < F.col("_end")))
            first = _written(first.withColumn("_open", is_open), "firsts")
            kept = numbers.join(first.where(~F.col("_open")), self.keys).where(F.col("_s") <= F.col("_end"))
            # The first chunk of a span is entered where the span before is left.
            rows = kept.select(*self.keys, "_s", "_entry", "_passed", F.explode("chunks").alias("_x"))
            here = (F.col("_x.c") == F.col("_s") * self.per) & (F.col("_s") > 0)
            either = lambda name: F.when(here, F.col(f"_entry.{name}")).otherwise(F.col(f"_x.{name}")).alias(name)
            cost = F.col("_x.cost") - F.when(here, F.col("_passed")).otherwise(F.lit(0))
            settled.append(rows.select(*self.keys, "_x.c", either("i"), either("j"), cost.alias("cost"), "_x.ended", "_x.to"))
            still = first.where("_open")
            if still.isEmpty():
                self.rounds += rounds - 1
                return functools.reduce(DataFrame.unionByName, settled)
            bad = numbers.join(still.select(*self.keys), self.keys, "left_semi").where(~F.col("_linked") & ~F.col("_entry.ended"))
            again = _written(bad.select(*self.keys, (F.col("_s") * self.per).alias("c"), "_entry.i", "_entry.j"), "again")
            redone = _written(self._walked(self._with_tokens(again), exact=True), "redone")
            walked = walked.join(still.select(*self.keys), self.keys, "left_semi").join(redone.select(*self.keys, "_s"), self._same("_s"), "left_anti")
            walked = _written(walked.unionByName(redone), "walked")

    def diff(self) -> DataFrame:
        """``(keys, mismatched, compared, len_a, len_b)``, as ``diff_table`` gives."""
        sums = self.linked.groupBy(*self.keys).agg(F.sum("cost").alias("mismatched"), F.max(F.when(F.col("ended"), F.col("to"))).alias("compared"))
        zero = F.lit(0).cast("bigint")
        return self.lengths.join(sums, self.keys, "left").select(*self.keys, F.coalesce("mismatched", zero).alias("mismatched"), F.coalesce("compared", zero).alias("compared"), "len_a", "len_b")

    def rows(self) -> DataFrame:
        """A row per mismatch, as ``diff_rows`` gives.  An event's number is its
        place in its span and the events of the spans before."""
        columns = [*self.keys, "seq", "i", "j", "kind", "cost", "a_context", "b_context"]
        direct = self._in_tasks(self._nudged(self._direct), walks.events, _EVENTS, False).select(*columns)
        if self._longer is None:
            return direct
        seen = self._with_tokens(self._longer.select(*self.keys, "c", "i", "j"))
        found = _written(self._in_tasks(seen, walks.events, _EVENTS, True), "events")
        earlier = Window.partitionBy(*self.keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        counts = found.groupBy(*self.keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
        numbered = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        rows = found.join(numbered, self._same("_s")).withColumn("seq", (F.col("_before") + F.col("seq")).cast("bigint"))
        return direct.unionByName(rows.select(*columns))


def runs_of(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Whole token lists as runs: ``(keys, off, tokens)``."""
    return df.select(*keys, F.lit(0).cast("bigint").alias("off"), tokens.alias("tokens"))
