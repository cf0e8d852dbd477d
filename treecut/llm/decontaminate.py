"""Operator 8, benchmark decontamination with a positional inverted index.

The documents are cut into blocks; Spark stores, per block, the positions of
every word that a benchmark item uses.  A phrase is looked up from its rarest
word in the block: that word's positions, shifted to the phrase's start, are
intersected with the shifted positions of the next rarest word, and so on, which
leaves exact occurrences.  ``proximity`` does the same for all words of a query
within some distance.  No posting leaves its block, so nothing is skewed by a
frequent word, and the work is one pass over the documents for every
``BLOCK_BYTES`` of benchmark text.

Defined cases: null texts and texts without words have 0 words and no hits;
benchmark items without words have no window; a null item_id hits but is not
listed; items that share an id are one item; repeated documents are answered
each on their own; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, load, scan, stored, utf8

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Benchmark text that one pass looks for; the terms and windows of a pass are
#: all that the driver and the tasks hold of the benchmark.
BLOCK_BYTES = 8 << 20
#: Words of a block of the index; a longer document is a block of its own.
BLOCK_WORDS = 1 << 20

#: Everything but letters, digits and non-ASCII characters ends a word.
SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return utf8(text).lower().translate(SPACED).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of documents with, for each word of ``vocabulary`` in them, its
    sorted positions.  A row: the ids, each document's first position (and the
    end), the words' numbers, where their postings end, and the postings as
    steps from one position to the next (all little-endian 32-bit)."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("row"))
    kind = dict(source.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    n_terms = len(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(id_type)), ("rows", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("starts", "terms", "ends", "steps"))])

        def block(held: list[tuple]) -> tuple:
            """``held``: id, row, numbers of the words. One position between documents stays empty."""
            ids, rows, found = zip(*held)
            lengths = np.array([len(x) + 1 for x in found])
            all_ = np.full(lengths.sum(), n_terms, dtype=np.int32)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            for at, x in zip(starts, found):
                all_[at : at + len(x)] = x
            at = np.flatnonzero(all_ < n_terms)
            order = at[np.argsort(all_[at], kind="stable")]
            terms, first = np.unique(all_[order], return_index=True)
            steps = np.diff(order, prepend=0)
            steps[first] = order[first]
            ends = np.append(first[1:], len(order)) if len(terms) else first
            return (list(ids), list(rows), [len(x) for x in found], *(np.asarray(x, dtype="<i4").tobytes() for x in (starts, terms, ends, steps)))

        def blocks() -> Iterator[tuple]:
            held, words = [], 0
            for doc_id, row, body in scan(batches, "doc_id", "row", "_text"):
                own = tokens(body)
                if held and words + len(own) > BLOCK_WORDS:
                    yield block(held)
                    held, words = [], 0
                held.append((doc_id, row, np.fromiter(map(vocabulary.get, own, repeat(n_terms)), dtype=np.int32, count=len(own))))
                words += len(own)
            if held:
                yield block(held)

        yield from emit(blocks(), schema, 1)

    return source.mapInArrow(index, f"ids array<{kind}>, rows array<long>, n_words array<long>, starts binary, terms binary, ends binary, steps binary")


class Block:
    """One row of the index, opened."""

    def __init__(self, starts: bytes, terms: bytes, ends: bytes, steps: bytes, n_terms: int):
        self.starts, present, ends_, self.steps = (np.frombuffer(x, dtype="<i4") for x in (starts, terms, ends, steps))
        self.lo, self.hi = np.zeros(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
        self.hi[present] = ends_
        self.lo[present] = np.concatenate(([0], ends_[:-1])) if len(ends_) else 0
        self.opened: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        if term not in self.opened:
            self.opened[term] = np.cumsum(self.steps[self.lo[term] : self.hi[term]], dtype=np.int64)
        return self.opened[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where ``terms`` occur one after the other."""
        rare = np.argsort((self.hi - self.lo)[terms], kind="stable")
        at = self.postings(int(terms[rare[0]])) - rare[0]
        for offset in rare[1:]:
            if not len(at):
                break
            own = self.postings(int(terms[offset])) - offset
            at = at[own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at]
        return at

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest of ``terms`` with each other one at most
        ``within`` positions away, in the same document."""
        distinct = np.unique(terms)
        rare = distinct[np.argsort((self.hi - self.lo)[distinct], kind="stable")]
        at = self.postings(int(rare[0]))
        for term in rare[1:]:
            if not len(at):
                break
            doc = np.searchsorted(self.starts, at, side="right")
            own = self.postings(int(term))
            lowest = np.maximum(at - within, self.starts[doc - 1])
            next_ = np.searchsorted(own, lowest)
            at = at[(next_ < len(own)) & (own[np.minimum(next_, len(own) - 1)] <= np.minimum(at + within, self.starts[doc] - 1))]
        return at


def _look_up(index: DataFrame, names: list[str | None], item_of: np.ndarray, queries: list[np.ndarray], n_terms: int, within: int | None) -> DataFrame:
    """Per document (``row``): hit spans as (first, end) word numbers, and the
    names of the items found."""
    kind = dict(index.dtypes)["ids"][len("array<") : -1]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))])
    lengths = np.array([len(q) for q in queries], dtype=np.int64)
    flat = np.concatenate(queries) if queries else np.zeros(0, dtype=np.int64)
    begin = np.cumsum(lengths) - lengths

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for ids, own, n_words, *packed in scan(batches, "ids", "rows", "n_words", "starts", "terms", "ends", "steps"):
                block = Block(*packed, n_terms)
                spans, items = [[] for _ in ids], [set() for _ in ids]
                whole = np.minimum.reduceat((block.hi - block.lo)[flat], begin) > 0 if len(flat) else []
                for q in np.flatnonzero(whole):
                    terms = flat[begin[q] : begin[q] + lengths[q]]
                    at = block.phrase(terms) if within is None else block.near(terms, within)
                    for d, p in zip((np.searchsorted(block.starts, at, side="right") - 1).tolist(), at.tolist()):
                        p -= int(block.starts[d])
                        spans[d].append((p, p + (int(lengths[q]) if within is None else 1)))
                        items[d].add(int(item_of[q]))
                for row, doc_id, n, s, i in zip(own, ids, n_words, spans, items):
                    yield row, doc_id, n, [{"first": a, "end": b} for a, b in joined(s)], [names[x] for x in sorted(i)]

        yield from emit(rows(), schema)

    return index.mapInArrow(find, f"row long, doc_id {kind}, n_words long, spans array<struct<first:long,end:long>>, items array<string>")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _passes(benchmark: DataFrame, text: str, key: str) -> Iterator[tuple[list, dict[bytes, int], np.ndarray, list[np.ndarray]]]:
    """Benchmark items in blocks of about ``BLOCK_BYTES``: ids, terms, and each
    item's words as term numbers."""
    items = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = 1 + size // BLOCK_BYTES
    for block in range(n):
        ids: dict = {}
        terms: dict[bytes, int] = {}
        item_of, found = [], []
        for item_id, body in items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block).toLocalIterator():
            if own := tokens(body):
                item_of.append(ids.setdefault(item_id, len(ids)))
                found.append(np.array([terms.setdefault(w, len(terms)) for w in own], dtype=np.int64))
        yield list(ids), terms, np.array(item_of, dtype=np.int64), found


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int | None = None, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, hit ``spans`` and found ``items`` (ids as
    text) of every document: exact windows, or with ``within`` all words of an
    item at most so far from its rarest word."""
    out = []
    for ids, terms, item_of, found in _passes(benchmark, item_text, item_key):
        queries, owner = [], []
        for item, own in zip(item_of, found):
            last = 1 if within is not None else max(1, len(own) - window + 1)
            for at in range(last):
                queries.append(own[at : at + window] if within is None else own)
                owner.append(item)
        index = stored(build_index(docs, terms, text, key), "postings")
        names = [None if x is None else str(x) for x in ids]
        out.append(_look_up(index, names, np.array(owner, dtype=np.int64), queries, len(terms), within))
    if len(out) == 1:
        return out[0]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    joined_up = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    # Spans of several passes may overlap: take each from the furthest end before it.
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hits = F.aggregate(F.array_sort("spans"), state, lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["first"]), F.lit(0))).alias("n")))
    return joined_up.withColumn("_hits", hits["n"])


def contamination(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The report per document of ``occurrences``."""
    spanned = F.col("_hits") if "_hits" in found.columns else F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    return found.select("row", "doc_id", "n_words", spanned.alias("n_hit"), items.alias("_items"), "spans").select(
        "row", "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", F.col("_items").alias("items"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, judged by the share of words hit."""
    found = occurrences(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
