"""Operator 13, source divergence audit over a minimal acyclic transducer.

The terms that enough documents of a language hold are its vocabulary.  Sorted
``language, term`` keys are cut into ranges; each range becomes a minimal acyclic
transducer from keys to ordinals in lexicographic order.  The texts are streamed
through the transducers again, as many in one pass as ``PASS_BYTES`` allow, and
counted per (language, source, ordinal); from there on terms are numbers, which
also break ties, until the reported ones are named again.  Shares are exact whole
numbers; sources of a language are compared block by block of terms.

Defined cases: null text, language and source read as empty; texts without terms
still make their group, whose counts are 0; a language without kept terms compares
its sources with value 0; rows that repeat are documents each; ties go to the item
that is smaller in UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import emit, growing, load, scan, stored, utf8
from .transducer import Builder, loads

#: Letters A-Z in lower case and everything beyond ASCII, as UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Distinct terms that a task holds before it hands its counts on; terms of a block
#: of texts; ordinals and counts that a task remembers.
HELD, REMEMBERED = 200_000, 500_000
#: Bytes of the keys of one transducer, and of the transducers of one pass over the texts.
SHARD_BYTES, PASS_BYTES = 1 << 20, 64 << 20
#: Terms and sources that are compared in one group.
TERMS, SOURCES = 8192, 256
#: What is added to every count.
PRIOR = 5


def _plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(read(text, "text"), read(lang, "lang"), read(source, "source"))


def _terms(text: str) -> list[bytes]:
    return TERM.findall(utf8(text).lower())


def _key(lang: str, term: bytes) -> bytes:
    # No term holds a zero byte, so the last one ends the language.
    return utf8(lang) + b"\0" + term


def kept_terms(plain: DataFrame, least: int) -> DataFrame:
    """``(lang, term, key)`` of the terms in at least ``least`` documents of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from emit(((lang, term.decode(), n) for lang, own in held.items() for term, n in own.items()), schema)

        for lang, text in scan(batches, "lang", "text"):
            own = held.setdefault(lang, Counter())
            size -= len(own)
            own.update(set(_terms(text)))
            size += len(own)
            if size > HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    seen = plain.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    kept = seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return kept.select("lang", "term", F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.encode("term", "UTF-8")).alias("key"))


class Vocabulary:
    """The transducers of a vocabulary in key order, as a table, with the first
    key of each and the ordinal it starts at (a row per transducer)."""

    def __init__(self, kept: DataFrame, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> None:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built, first = Builder(), None
            for (key,) in scan(batches, "key"):
                first = key if first is None else first
                built.add(key)
            if built.n:
                blob = built.finish().dumps()
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([built.n], pa.int64()), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["first", "n", "size", "blob"])

        total = kept.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
        ordered = kept.select("key").repartitionByRange(1 + total // shard_bytes, "key").sortWithinPartitions("key")
        self.table = stored(ordered.mapInArrow(make, "first binary, n long, size long, blob binary"), "transducers")
        self.passes: list[list[tuple[bytes, int]]] = []
        at, room = 0, 0
        for row in sorted(self.table.select("first", "n", "size").collect(), key=lambda r: bytes(r["first"])):
            if not self.passes or room < row["size"]:
                self.passes.append([])
                room = pass_bytes
            self.passes[-1].append((bytes(row["first"]), at))
            at, room = at + row["n"], room - row["size"]

    def each(self) -> Iterator["Lookup"]:
        """The passes: what a task needs to look keys up, of bounded size."""
        for shards in self.passes:
            rows = self.table.where(F.col("first").between(F.lit(shards[0][0]), F.lit(shards[-1][0]))).select("first", "blob").collect()
            blobs = {bytes(r["first"]): bytes(r["blob"]) for r in rows}
            yield Lookup(shards, self.table.sparkSession.sparkContext.broadcast([blobs[first] for first, _ in shards]))


class Lookup:
    """Keys to ordinals by the transducers of one pass."""

    def __init__(self, shards: list[tuple[bytes, int]], blobs) -> None:
        self.first, self.at = [s[0] for s in shards], [s[1] for s in shards]
        self.blobs, self.open = blobs, {}

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        shard = np.fromiter((bisect_right(self.first, k) - 1 for k in keys), dtype=np.int64, count=len(keys))
        out = np.full(len(keys), -1, dtype=np.int64)
        for s in np.unique(shard[shard >= 0]).tolist():
            if s not in self.open:
                self.open[s] = loads(self.blobs.value[s])
            own = np.flatnonzero(shard == s)
            found = self.open[s].ordinals([keys[i] for i in own])
            out[own] = np.where(found < 0, -1, found + self.at[s])
        return out


def _numbered(kept: DataFrame, look: Lookup) -> DataFrame:
    """``(lang, term, ordinal)`` of the kept terms that this pass knows."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(look(batch.column("key").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), found], names=["lang", "term", "ordinal"])

    return kept.mapInArrow(number, "lang string, term string, ordinal long").where("ordinal >= 0")


def _recounted(plain: DataFrame, look: Lookup) -> DataFrame:
    """``(lang, source, ordinal, n)`` as the tasks count them, a block of texts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        held: dict[tuple[str, str], Counter] = {}

        def through(block: list[tuple[str, str, list[bytes]]]) -> None:
            """A block of texts through the transducers: terms that were not met
            lately are walked, all are counted."""
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            for lang in {lang for lang, _, _ in block}:
                own = known.setdefault(lang, {})
                new = list(set().union(*(terms for l, _, terms in block if l == lang)).difference(own))
                prefix = _key(lang, b"")
                own.update(zip(new, look([prefix + term for term in new]).tolist()))
            for lang, source, terms in block:
                held.setdefault((lang, source), Counter()).update(map(known[lang].__getitem__, terms))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                own.pop(-1, None)  # terms that are not kept
                if own:
                    same = pa.array(np.zeros(len(own), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(same), pa.array([source]).take(same), pa.array(list(own.keys()), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "source", "ordinal", "n"])
            held.clear()

        block, size = [], 0
        for lang, source, text in scan(batches, "lang", "source", "text"):
            terms = _terms(text)
            block.append((lang, source, terms))
            size += len(terms)
            if size > HELD:
                through(block)
                block, size = [], 0
                if sum(map(len, held.values())) > REMEMBERED:
                    yield from flush()
        through(block)
        yield from flush()

    return plain.mapInArrow(count, "lang string, source string, ordinal long, n long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), in whole numbers."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def _all(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for frame in frames:
        out = out.unionByName(frame)
    return out


def _pair_sums(rows: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` with the summed differences of one block of terms
    for every two sources of two blocks of sources.  ``rows``: the share of a
    source for the terms that it has, and a row without a term with its share for
    the others and the block's number of terms."""

    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        number = lambda c: rows.column(c).to_numpy()
        lang, terms = rows.column("lang")[0].as_py(), int(number("terms").max())
        x, y = int(number("x")[0]), int(number("y")[0])
        coded = rows.column("source").combine_chunks().dictionary_encode()
        names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # Rows come in any order: by name, so that every block of terms has a pair the same way round.
        by_name = sorted(range(len(names)), key=names.__getitem__)
        names, source = [names[i] for i in by_name], np.argsort(by_name)[source]
        ordinal, value = number("ordinal"), number("share")
        seed, known = ordinal < 0, ordinal >= 0
        rest, own = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        rest[source[seed]], own[source[seed]] = value[seed], number("own")[seed]
        columns, column = np.unique(ordinal[known], return_inverse=True)
        share = np.repeat(rest[:, None], len(columns), axis=1)
        share[source[known], column] = value[known]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        pairs, values = [], []
        for k, i in enumerate(left):
            others = right[k + 1 :] if x == y else right
            pairs += [(names[i], names[o]) for o in others]
            values += (np.abs(share[others] - share[i]).sum(axis=1) + (terms - len(columns)) * np.abs(rest[others] - rest[i])).tolist()
        return pa.table([pa.array([lang] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(values, pa.int64())], schema=schema)

    return rows.groupBy("lang", "block", "x", "y").applyInArrow(compare, "lang string, a string, b string, value long")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, top: int = 50, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a
    language is from each other one (``pair``), and the ``top`` terms that it has
    more often than the language (``term``)."""
    spark = docs.sparkSession
    plain = _plain(docs, text, lang, source)
    kept = stored(kept_terms(plain, least), "kept-terms")
    vocabulary = Vocabulary(kept, shard_bytes, pass_bytes)
    numbered, counted = [], []
    for look in vocabulary.each():
        numbered.append(stored(_numbered(kept, look), "ordinals"))
        counted.append(stored(_recounted(plain, look).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recounts"))
    numbered = _all(numbered, spark.createDataFrame([], "lang string, term string, ordinal long"))
    counts = _all(counted, spark.createDataFrame([], "lang string, source string, ordinal long, n long"))

    sizes = numbered.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(growing(totals), ["lang", "source"], "left").join(growing(sizes), "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"))
    groups = stored(groups.join(growing(whole), "lang"), "groups")
    shared = counts.join(growing(groups), ["lang", "source"])
    shared = stored(shared.select("lang", "source", "ordinal", "n", "of_lang", "v", _share(F.col("n"), F.col("total"), F.col("v")).alias("share")), "shares")

    # Terms that a source has more often than its language.
    of_lang = shared.groupBy("ordinal").agg(F.sum("n").alias("n"), F.first("of_lang").alias("of_lang"), F.first("v").alias("v"))
    of_lang = of_lang.select("ordinal", _share(F.col("n"), F.col("of_lang"), F.col("v")).alias("q"))
    above = shared.join(growing(of_lang), "ordinal").where("share > q").select("lang", "source", "ordinal", (F.col("share") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    best = stored(best, "best-terms").join(growing(numbered.select("ordinal", "term")), "ordinal")
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # Differences between the sources of a language.
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks_of = 1 + most // sources
    own = F.pmod(F.xxhash64("source"), F.lit(blocks_of)).cast("int")
    block = F.floor(F.col("ordinal") / terms).cast("long")
    filled = numbered.groupBy("lang", block.alias("block")).agg(F.count("*").alias("terms"))
    rest = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    seeds = groups.join(growing(filled), "lang", "left")
    seeds = seeds.select("lang", "source", F.coalesce("block", F.lit(-1)).cast("long").alias("block"), F.lit(-1).cast("long").alias("ordinal"), rest.alias("share"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    rows = shared.select("lang", "source", block.alias("block"), "ordinal", "share", F.lit(0).cast("long").alias("terms")).unionByName(seeds)
    rows = rows.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks_of - 1))))
    rows = rows.select("*", F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y")).drop("_other")
    sums = _pair_sums(rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = stored(sums, "pair-sums")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of every language in ``documents``."""
    return divergence(load(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {v})"
OP13_SQL = f"""WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
said AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, s.v
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, ({_SHARE.format(n='n', total='total', v='v')})::BIGINT AS p FROM grid),
whole AS (
  SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, any_value(v) AS v FROM grid GROUP BY lang, term),
langs AS (SELECT lang, term, ({_SHARE.format(n='n', total='total', v='v')})::BIGINT AS q FROM whole),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
