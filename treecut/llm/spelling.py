"""Operator 11, spelling variants by reduced-alphabet generation.

Letters are hashed to ``symbols`` symbols that are about equally frequent in the
vocabulary.  Two words that differ by one edit have reduced words that differ by
one edit or none, so the one-edit neighbourhood of every reduced word (deletions,
replacements and itself; insertions are the deletions of the other word) is
generated as 64-bit rolling hashes and joined with the reduced vocabulary.  The
words of two classes that meet are verified on the original strings.  A word's
form is its most frequent near word, if that is frequent enough; roots follow
forms by pointer doubling.

A neighbour's hash comes from prefix sums in constant time, so a word of any
length costs rows in proportion to its length.  Equal hashes of different strings
only add candidates, which the verification rejects.

Defined cases: null and empty texts have no words; a null key is hashed as the
empty text; rows that repeat are counted each; ties between near words go to the
smaller one in code-point order; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, growing, load, scan, stored, utf8

#: Maximal runs of these are words, after lower-casing A-Z.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Symbols of the reduced alphabet: more of them mean more neighbours and fewer candidates.
SYMBOLS = 8
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000
#: Numbers of a block when neighbourhoods are generated.
BLOCK = 1 << 20

#: Any odd numbers: base of the rolling hash, its inverse mod 2^64, salt of the length.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = 0xC2B2AE3D27D4EB4F


def typo(run: str, doc_hash: int, every: int | None) -> str:
    """The run, or the run without one letter where ``every`` divides its hash;
    ``doc_hash`` is the CRC-32 of what the hash starts with."""
    if every:
        h = zlib.crc32(utf8(run), doc_hash)
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", every: int | None = None, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """``(word, n)``: the words of at least ``shortest`` code points that occur at
    least ``rarest`` times; ``every`` asks for the deletions of ``typo``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        held: Counter = Counter()
        for own, body in scan(batches, "key", "text"):
            start = zlib.crc32(utf8(f"{own}:" if own is not None else ":"))
            runs = Counter(RUN.findall(utf8(body).lower().decode("utf-8", "surrogatepass")))
            for run, n in runs.items():
                word = typo(run, start, every)
                if len(word) >= shortest:
                    held[word] += n
            if len(held) > HELD:
                yield from emit(held.items(), schema)
                held = Counter()
        yield from emit(held.items(), schema)

    source = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text is not null")
    counted = source.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def alphabet(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, int]:
    """A symbol for every letter of the vocabulary, the most frequent letters
    first, each to the least used symbol (a row per letter comes to the driver)."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    load_of, found = [0] * symbols, {}
    for letter, n in sorted(((r["letter"], r["count"]) for r in letters if r["letter"]), key=lambda x: (-x[1], x[0])):
        found[letter] = min(range(symbols), key=lambda s: (load_of[s], s))
        load_of[found[letter]] += n
    return found


def _weights(length: int) -> np.ndarray:
    """Powers of the base: the first character has the highest."""
    powers = np.full(length, np.uint64(_BASE))
    powers[:1] = 1
    return np.multiply.accumulate(powers)[::-1]


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length, a row of symbols each."""
    length = codes.shape[1]
    letter = codes.astype(np.uint64) + np.uint64(1)
    return (letter * _weights(length)).sum(axis=1, dtype=np.uint64) + np.uint64(length * _SALT % (1 << 64))


def neighbourhood(codes: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the neighbours of such words: the word itself, its
    deletions, and its replacements by smaller symbols (those by larger ones are
    found from the other end)."""
    n, length = codes.shape
    weight = _weights(length)
    letter = codes.astype(np.uint64) + np.uint64(1)
    part = letter * weight
    ends = np.cumsum(part, axis=1, dtype=np.uint64)
    whole = ends[:, -1]
    own = hashes(codes)
    rows, keys = [np.arange(n)], [own]
    # Deleting any letter of a run of equal ones gives one word: only the first counts.
    first = np.ones_like(codes, dtype=bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    shorter = (ends - part) * np.uint64(_INVERSE) + (whole[:, None] - ends) + np.uint64((length - 1) * _SALT % (1 << 64))
    rows.append(np.nonzero(first)[0])
    keys.append(shorter[first])
    for symbol in range(symbols - 1):
        lower = codes > symbol
        rows.append(np.nonzero(lower)[0])
        keys.append((own[:, None] - (letter - np.uint64(symbol + 1)) * weight)[lower])
    return np.concatenate(rows), np.concatenate(keys)


def _coded(reduced: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and symbols of reduced words (a letter of ``a``, ``b``, ... per
    symbol) in blocks of one length and bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(reduced):
        by_length.setdefault(len(word), []).append(i)
    for length, places in by_length.items():
        step = max(1, BLOCK // length)
        for at in range(0, len(places), step):
            block = places[at : at + step]
            flat = np.frombuffer("".join(reduced[i] for i in block).encode(), dtype=np.uint8)
            yield block, flat.reshape(len(block), length).astype(np.int64) - ord("a")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(a, na, b, nb)``: every two words of ``(word, n)`` that one inserted,
    deleted or replaced code point apart, once."""
    to_symbol = str.maketrans({c: chr(ord("a") + s) for c, s in alphabet(words, symbols).items()})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = [w.translate(to_symbol) for w in batch.column("word").to_pylist()]
            keys = np.zeros(len(reduced), dtype=np.uint64)
            for block, codes in _coded(reduced):
                keys[block] = hashes(codes)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(reduced, pa.string()), pa.array(keys.view(np.int64))], names=["word", "n", "reduced", "key"])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _coded(batch.column("reduced").to_pylist()):
                row, key = neighbourhood(codes, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(hashes(codes)[row].view(np.int64)), pa.array(key.view(np.int64))], names=["of", "key"])

    classed = stored(words.mapInArrow(reduce, "word string, n long, reduced string, key long"), "reduced-words")
    vocabulary = stored(classed.select("reduced", "key").distinct(), "reduced-vocabulary")
    made = vocabulary.select("reduced").mapInArrow(generate, "of long, key long")
    met = made.join(growing(vocabulary.select("key").distinct()), "key")
    left = classed.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("key").alias("of"))
    right = classed.select(F.col("word").alias("b"), F.col("n").alias("nb"), "key")
    # Within a class each pair is looked at once; between classes the edge is there once.
    once = (F.col("of") != F.col("key")) | (F.col("a") < F.col("b"))
    one_edit = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    paired = growing(left).join(met, "of").withColumnRenamed("key", "to")
    verified = paired.join(growing(right), (F.col("to") == F.col("key")) & once & one_edit)
    smaller = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(smaller, F.col(x)).otherwise(F.col(y))
    # Two reduced words with one hash would bring a pair twice.
    return verified.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form; each round doubles the
    forms followed (a form is at least twice as frequent, so no circle is possible)."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = stored(at.join(growing(ahead), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = stepped.select("word", "root")
        if stepped.where("_moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, symbols: int = SYMBOLS, times: int = 2) -> DataFrame:
    """``words`` (``word``, ``n``) with ``n_near``, the ``form`` (the near word of
    largest ``n``, if at least ``times`` the word's own), its count ``form_n`` and
    the ``root`` at which the forms end."""
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words, symbols), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"), F.first("n").alias("_n"))
    is_form = -F.col("_best.m") >= times * F.col("_n")
    best = stored(best.select("word", "n_near", F.when(is_form, F.col("_best.near")).alias("form"), F.when(is_form, -F.col("_best.m")).alias("form_n")), "near-counts")
    roots = _roots(best.where("form is not null"))
    found = words.join(growing(best), "word", "left").join(growing(roots), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``, one run in 97 misspelt."""
    return spelling_variants(word_counts(load(spark, sf_dir, "documents"), every=97))


#: DuckDB's levenshtein counts bytes: letters beyond ASCII are compared as other ASCII characters.
_WIDE, _FLAT = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

#: CRC-32 byte by byte with its table of 256 numbers; all pairs of words by length.
OP11_SQL = f"""WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
           list_transform(range(len(hex) // 2), lambda j: ('0x' || substr(hex, (2 * j + 1)::BIGINT, 2))::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h
  FROM hexed, crc),
changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, translate(word, '{_WIDE}', '{_FLAT}') AS flat, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM words a JOIN words b
  ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.flat, b.flat) = 1),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY m DESC, near) AS form, max(m) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
steps AS (
  SELECT word, word AS root, 0 AS k FROM words
  UNION ALL
  SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(s.root, s.k) AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s USING (word) GROUP BY ALL"""
