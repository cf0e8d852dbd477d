"""Operator 7, language-model scoring with an Elias-Fano n-gram trie.

1. Spark stores the documents as blocks of tokens: each block has its own
   vocabulary of 64-bit word hashes and its tokens as numbers in it.  The blocks
   lie in buckets, so that they stay where they are when answers come to them.
2. Word counts meet in shards of the hash space: a block sends a shard its words
   and training counts, and gets back the corpus counts of its words and their
   numbers in the corpus, so no vocabulary is ever whole in one place.
3. Pairs and triples meet in shards by their context (a word's number, the hash
   of a pair): a block sends each shard its distinct n-grams with their training
   counts, a word as its number.  All n-grams seen ``LEAST`` times are kept,
   whatever the size of the corpus.
4. A shard's part of the trie's level: the kept n-grams and their contexts,
   Elias-Fano coded, with 8-bit quantised discounted probabilities and back-off
   weights.  It is built and read in the shard's task, which answers the blocks
   with codes; a shard's code books are sent once, not to every block.
5. Blocks are scored from the answers: the longest n-gram found, or the shorter
   one's probability times the back-off weight; at last the absolutely discounted
   word count, whose discounts are the probability of a word never seen in training.

For every context the probabilities of all words and of one unknown word sum to
at most 1 (quantising rounds down).

Defined cases: a null or empty text is its end token alone; repeated rows count
and are scored each; rows with a null key are learned from; without training
tokens every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import emit, growing, input_tasks, load, scan, stored, words_of
from .eliasfano import EliasFano
from .langid import fold

#: Tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Words (of all blocks) that one shard merges.
SHARD_WORDS = 8_000_000
#: N-grams (of all blocks) that one shard merges, and how many it holds unmerged.
SHARD_GRAMS = 1_000_000
HELD_GRAMS = 500_000
#: Bytes of a shard's questions that wait in memory.
HELD_BYTES = 16 << 20
#: No share of the training tokens is asked of a word or n-gram, the model grows
#: with the corpus (test_lm.py reads these).
WORD_SHARE = NGRAM_SHARE = 0.0
#: N-grams are kept from this count on.
LEAST = 2
#: Absolute discount of n-grams.
DISCOUNT = 0.75
#: The hash of the end token; no word has it.
END = 0

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def planes(numbers: np.ndarray) -> bytes:
    """Numbers, their bytes of equal weight together and compressed: the many zero
    bytes and small numbers then cost next to nothing."""
    raw = np.ascontiguousarray(numbers, dtype="<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    plain = pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(8, n).T.copy().view("<i8").reshape(-1)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted numbers as steps."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def expanded(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(opened(raw).view(kind), dtype=kind)


def distinct(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number (in ascending order, all below ``most``) stands
    first, and of each number which of these it is."""
    n = len(code)
    bits = n.bit_length()
    if most.bit_length() + bits < 64:  # place and number in one word sort much faster
        both = np.sort((code << bits) | np.arange(n))
        at, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        at = np.argsort(code, kind="stable")
        ordered = code[at]
    new = np.diff(ordered, prepend=-1) != 0
    which = np.empty(n, dtype=np.int32)
    which[at] = np.cumsum(new) - 1
    return at[new], which


def tokenised(docs: DataFrame, held_out: Column, text: str, key: str) -> DataFrame:
    """Blocks: ids and folds of the documents, their token counts, the sorted
    word hashes, and all tokens as places in them."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), held_out.alias("held"), F.spark_partition_id().alias("part"))
    kind = dict(source.dtypes)["doc_id"]
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(_ARROW[kind])), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("train_tokens", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(number: int, ids: list, held: list, lengths: list, known: _Numbers, tokens: list) -> tuple:
            own = np.fromiter((max(xxhash.xxh64_intdigest(w), END + 1) if w is not None else END for w in known), dtype=np.uint64, count=len(known))
            words, place = np.unique(own, return_inverse=True)
            at = place[np.concatenate(tokens)]
            train = sum(n for n, h in zip(lengths, held) if not h)
            return number, ids, held, lengths, train, len(words), squeezed(words), planes(at)

        def blocks() -> Iterator[tuple]:
            done, ids, held, lengths, known, tokens, total, part = 0, [], [], [], _Numbers(), [], 0, 0
            for doc_id, body, out, part in scan(batches, "doc_id", "_text", "held", "part"):
                own = words_of(body)
                if ids and total + len(own) + 1 > BLOCK_TOKENS:
                    yield block((part << 32) + done, ids, held, lengths, known, tokens)
                    done, ids, held, lengths, known, tokens, total = done + 1, [], [], [], _Numbers(), [], 0
                own.append(None)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(own))
                tokens.append(np.fromiter(map(known.__getitem__, own), dtype=np.uint32, count=len(own)))
                total += len(own)
            if ids:
                yield block((part << 32) + done, ids, held, lengths, known, tokens)

        yield from emit(blocks(), schema, 1)

    return source.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, train_tokens long, n_words long, words binary, tokens binary")


def word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """Rows (``block``, ``shard``, ``places`` of the block's words among those of that
    shard, their ``counts``) and, with a null block, per shard: ``stats`` (words
    seen, seen once and twice in training, all words)."""
    edge = [(i << 64) // shards for i in range(1, shards)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, held, lengths, words, tokens in scan(batches, "block", "held", "lengths", "words", "tokens"):
                own, train = expanded(words), ~np.repeat(np.array(held, dtype=bool), lengths)
                counts = np.bincount(opened(tokens)[train], minlength=len(own))
                cut = [0, *np.searchsorted(own, np.array(edge, dtype=np.uint64)), len(own)]
                for shard, (a, b) in enumerate(zip(cut, cut[1:])):
                    if a < b:
                        yield shard, block, squeezed(own[a:b]), planes(counts[a:b])

        yield from emit(rows(), pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]), 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, group in groupby(scan(batches, "shard", "block", "words", "counts"), key=lambda r: r[0]):
                _, block, words, counts = zip(*group)
                own = [expanded(w) for w in words]
                every, place = np.unique(np.concatenate(own), return_inverse=True)
                total = np.zeros(len(every), dtype=np.int64)
                np.add.at(total, place, np.concatenate([opened(c) for c in counts]))
                for b, at in zip(block, np.split(place, np.cumsum([len(w) for w in own])[:-1])):
                    yield b, shard, squeezed(at), planes(total[at]), None
                yield None, shard, None, None, [int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), len(every)]

        yield from emit(rows(), pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]), 16)

    sent = blocks.select("block", "held", "lengths", "words", "tokens").mapInArrow(send, "shard int, block long, words binary, counts binary")
    return sent.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(merge, "block long, shard int, places binary, counts binary, stats array<long>")


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book of at most 256 values, each rounded down."""
    book = np.unique(np.quantile(values, np.linspace(0, 1, 256), method="lower")) if len(values) else np.zeros(1)
    return (np.searchsorted(book, values, side="right") - 1).astype(np.uint8), book


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """63-bit hashes of ordered pairs of hashes."""
    x = (first.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> np.uint64(29))) + second.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(30))) >> np.uint64(1)).astype(np.int64)


class Grams:
    """The distinct ``size``-grams of a block by context, without those of which a
    shorter part is too rare (``known`` says of each token whether the shorter
    n-gram that ends there is kept).  A context is a word's number, or the hash of
    one of the pairs ``shorter``.  ``asks`` are the tokens after a context, ``of``
    the numbers of these contexts; ``ends`` the tokens that end an n-gram,
    ``place`` its number, ``which`` the number of each n-gram's context, ``last``
    its last word in the block's vocabulary ``ids``."""

    def __init__(self, ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, known: np.ndarray, shorter: "Grams | None" = None):
        nth = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.asks = np.flatnonzero((nth >= (1 if shorter is None else 2)) & np.roll(known, 1))
        if shorter is None:
            before, names = tokens, ids
        else:
            before = np.zeros(len(tokens), dtype=np.int64)
            before[shorter.ends] = shorter.place
            names = _mix(shorter.contexts[shorter.which], ids[shorter.last])
        before = before[self.asks - 1]
        used = np.flatnonzero(np.bincount(before, minlength=len(names)))
        used = used[np.argsort(names[used])]
        number = np.zeros(len(names), dtype=np.int32)
        number[used] = np.arange(len(used))
        self.contexts, self.of = names[used], number[before]
        inner = known[self.asks]
        self.ends = self.asks[inner]
        first, self.place = distinct(self.of[inner] * np.int64(len(ids)) + tokens[self.ends], len(used) * len(ids))
        self.first, self.which = self.ends[first], self.of[inner][first]
        self.last = tokens[self.first]


def valued(answers: list, codes: str, base: np.ndarray) -> np.ndarray:
    """Places of the values that the shards' codes name, in the code books one
    after another; 0 where there is none."""
    if not answers:
        return np.zeros(0, dtype=np.int64)
    own = [opened(a[codes]) for a in answers]
    return np.concatenate([np.where(c > 0, base[a["shard"]] + c, 0) for a, c in zip(answers, own)])


class Books:
    """The code books of all shards, one after another, behind a NaN for what is
    not there (no more than 256 values a shard)."""

    def __init__(self, books: dict[int, bytes], shards: int):
        own = [np.frombuffer(books.get(i, b""), np.float64) for i in range(shards)]
        size = np.array([len(b) for b in own], dtype=np.int64)
        self.base, self.values = np.cumsum(size) - size, np.concatenate([[np.nan], *own])


def pair_scores(ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, counts: np.ndarray, answers: list, books: Books) -> tuple[Grams, np.ndarray]:
    """The pairs of a block, and where the score of the kept pair that ends at each
    token is in the books, else 0."""
    own = Grams(ids, tokens, lengths, (counts >= LEAST)[tokens])
    found = np.zeros(len(tokens), dtype=np.int64)
    found[own.ends] = valued(answers, "codes", books.base)[own.place]
    return own, found


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where each distinct one begins in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _summed(parts: list[tuple]) -> tuple:
    """Contexts (sorted, distinct) and how often they occur."""
    context, count = map(np.concatenate, zip(*parts))
    order, starts = _groups(context)
    return context[order[starts]], np.add.reduceat(count[order], starts)


def _merged(parts: list[tuple]) -> tuple:
    """Contexts, keys (sorted, distinct), counts and lower-order scores."""
    context, key, count, lower = map(np.concatenate, zip(*parts))
    order, starts = _groups(key)
    first = order[starts]
    return context[first], key[first], np.add.reduceat(count[order], starts), lower[first]


class Level:
    """One shard's n-grams of one size: Elias-Fano coded keys and contexts with
    codes of their log10 probabilities and back-off weights."""

    def __init__(self, every: np.ndarray, total: np.ndarray, context: np.ndarray, key: np.ndarray, count: np.ndarray, lower: np.ndarray):
        kept = count >= LEAST
        which, n = np.searchsorted(every, context[kept]), len(every)
        self.codes, self.book = quantised(np.log10((count[kept] - DISCOUNT) / total[which]))
        log_floor = lambda x: np.log10(np.maximum(x, 1e-12))
        has = np.bincount(which, minlength=n) > 0
        left, below = (1 - np.bincount(which, 10**x, minlength=n)[has] for x in (self.book[self.codes], lower[kept]))
        self.back, self.back_book = quantised(log_floor(left) - log_floor(below))
        self.keys, self.contexts = EliasFano.encode(key[kept]), EliasFano.encode(every[has])

    @staticmethod
    def _find(among: EliasFano, asked: np.ndarray, codes: np.ndarray) -> bytes:
        """The codes of ``asked`` plus 1, 0 where it is not there."""
        out = np.zeros(len(asked), dtype=np.int64)
        if among.n:
            at = among.successor(asked)
            inside = np.flatnonzero(at < among.n)
            hit = inside[among.get(at[inside]) == asked[inside]]
            out[hit] = codes[at[hit]].astype(np.int64) + 1
        return planes(out)

    def answer(self, contexts: np.ndarray, keys: np.ndarray) -> tuple:
        return self._find(self.keys, keys, self.codes), self._find(self.contexts, contexts, self.back)


class Words:
    """log10 probabilities of words by their training counts."""

    def __init__(self, tokens: int, words: int, discount: float):
        self.tokens, self.words, self.discount = tokens, words, discount

    def unknown(self) -> float:
        return np.log10(self.discount * self.words / self.tokens) if self.tokens else 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, np.log10(np.maximum(counts - self.discount, 1e-300) / max(self.tokens, 1)), self.unknown())


def vocabulary(answers: list, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's words in the corpus (ascending), and their counts."""
    ids = [starts[a["shard"]] + expanded(a["places"], np.int64) for a in answers]
    return np.concatenate(ids), np.concatenate([opened(a["counts"]) for a in answers])


_GRAMS = ("contexts", "totals", "sizes", "last", "counts", "lower")
_ANSWER = ("codes", "back")
_BOOKS = ("book", "back_book")


def gram_scores(blocks: DataFrame, model: Words, starts: np.ndarray, shards: int, books: Books | None = None) -> DataFrame:
    """Rows (``block``, ``shard``, codes of its n-grams and their contexts there) and,
    with a null block, a shard's code books.  ``blocks`` has the answers for the
    next shorter ones: triples are scored with the ``books`` of the pairs."""
    shorter = ["answers1"] if books is None else ["answers1", "answers2"]
    top = int(starts[-1]) if books is None else 1 << 63
    edge = np.array([i * top // shards for i in range(1, shards)], dtype=np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, held, lengths, raw, *answers in scan(batches, "block", "held", "lengths", "tokens", *shorter):
                tokens, n, (ids, known) = opened(raw), np.array(lengths), vocabulary(answers[0], starts)
                if books is None:
                    own, lower = Grams(ids, tokens, n, (known >= LEAST)[tokens]), known[tokens]
                else:
                    pairs, lower = pair_scores(ids, tokens, n, known, answers[1], books)
                    own = Grams(ids, tokens, n, lower > 0, pairs)
                lower, train = lower[own.first], np.repeat(~np.array(held, dtype=bool), n)
                counts = np.bincount(own.place[train[own.ends]], minlength=len(own.which))
                totals = np.bincount(own.of[train[own.asks]], minlength=len(own.contexts))
                sizes = np.bincount(own.which, minlength=len(own.contexts))
                cut = [0, *np.searchsorted(own.contexts, edge), len(own.contexts)]
                start, last = np.concatenate(([0], np.cumsum(sizes))), ids[own.last]
                for shard, (a, b) in enumerate(zip(cut, cut[1:])):
                    if a < b:
                        at = slice(start[a], start[b])
                        yield shard, block, squeezed(own.contexts[a:b]), *map(planes, (totals[a:b], sizes[a:b], last[at], counts[at], lower[at]))

        yield from emit(rows(), pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in _GRAMS)]), 16)

    def keyed(contexts: bytes, sizes: bytes, last: bytes) -> tuple:
        own = expanded(contexts, np.int64)
        of = np.repeat(own, opened(sizes))
        return own, of, _mix(of, opened(last))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, group in groupby(scan(batches, "shard", "block", *_GRAMS), key=lambda r: r[0]):
                # A frequent context sends all blocks here: distinct n-grams are held, what was asked waits, beyond HELD_BYTES on disk.
                with tempfile.SpooledTemporaryFile(HELD_BYTES) as asked:
                    parts, seen, fresh, blocks = [], [], 0, 0
                    for _, block, contexts, totals, sizes, last, counts, lower in group:
                        own, of, key = keyed(contexts, sizes, last)
                        pickle.dump((block, contexts, sizes, last), asked)
                        seen.append((own, opened(totals)))
                        below = opened(lower)
                        parts.append((of, key, opened(counts), model.scores(below) if books is None else books.values[below]))
                        fresh, blocks = fresh + len(own) + len(key), blocks + 1
                        if fresh > HELD_GRAMS:
                            parts, seen, fresh = [_merged(parts)], [_summed(seen)], 0
                    level = Level(*_summed(seen), *_merged(parts))
                    parts, seen = [], []
                    asked.seek(0)
                    for _ in range(blocks):
                        block, *asks = pickle.load(asked)
                        own, _, key = keyed(*asks)
                        yield block, shard, *level.answer(own, key), None, None
                    yield None, shard, None, None, level.book.tobytes(), level.back_book.tobytes()

        yield from emit(rows(), pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in _ANSWER + _BOOKS)]), 16)

    sent = blocks.select("block", "held", "lengths", "tokens", *shorter).mapInArrow(send, "shard int, block long, " + ", ".join(f"{c} binary" for c in _GRAMS))
    return sent.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(merge, "block long, shard int, " + ", ".join(f"{c} binary" for c in _ANSWER + _BOOKS))


def books_of(answers: DataFrame, shards: int) -> tuple[Books, Books]:
    """The shards' code books of scores and of back-off weights."""
    rows = answers.where("block is null").select("shard", *_BOOKS).collect()
    return tuple(Books({r.shard: bytes(r[c]) for r in rows}, shards) for c in _BOOKS)


def token_scores(word: np.ndarray, ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, known: np.ndarray, pairs: list, triples: list, books: list) -> np.ndarray:
    """log10 probability of every token of a block."""
    score = word[tokens]
    (book2, back2), (book3, back3) = books
    own, at = pair_scores(ids, tokens, lengths, known, pairs, book2)
    score[own.asks] += np.nan_to_num(back2.values[valued(pairs, "back", back2.base)])[own.of]
    score = np.where(at > 0, book2.values[at], score)
    own = Grams(ids, tokens, lengths, at > 0, own)
    score[own.asks] += np.nan_to_num(back3.values[valued(triples, "back", back3.base)])[own.of]
    at = valued(triples, "codes", book3.base)[own.place]
    score[own.ends] = np.where(at > 0, book3.values[at], score[own.ends])
    return score


def in_buckets(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``stored``, in ``n`` buckets by ``key``: joins with what is partitioned like
    them leave ``df`` where it is."""
    spark, own = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", scratch_path(spark, own)).bucketBy(n, key).saveAsTable(own)
    table = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # only its name; the files stay, like those of other stored tables
    return table


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that has ended go at once, not only when the
    driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with(blocks: DataFrame, answers: DataFrame, buckets: int, size: int, *columns: str) -> DataFrame:
    own = answers.where("block is not null").repartition(buckets, "block")
    mine = own.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", *columns))).alias(f"answers{size}"))  # of one block's n-grams
    return blocks.join(growing(mine), "block", "left")


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of all rows of ``docs`` by the model of those not ``held_out``."""
    with shuffles_let_go(docs.sparkSession):
        return _score_texts(docs, held_out, text, key)


def _score_texts(docs: DataFrame, held_out: Column, text: str, key: str) -> DataFrame:
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, input_tasks(docs))
    blocks = in_buckets(tokenised(docs, held_out, text, key), "blocks", "block", buckets)
    sums = blocks.agg(F.sum("train_tokens"), F.sum("n_words"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).head()
    tokens, entries = sums[0] or 0, sums[1] or 0
    shards = max(least, 1 + entries // SHARD_WORDS)
    answers = stored(word_counts(blocks, shards), "word-counts")
    stats = answers.where("block is null").select("shard", "stats").collect()
    n_words, once, twice = (sum(r.stats[i] for r in stats) for i in range(3))
    size = dict.fromkeys(range(shards), 0) | {r.shard: r.stats[3] for r in stats}
    starts = np.cumsum([0, *(size[i] for i in range(shards))])
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    model = Words(tokens, n_words, discount)
    shards = max(least, 1 + (sums[2] or 0) // SHARD_GRAMS)
    counted = _with(blocks, answers, buckets, 1, "places", "counts")
    pairs = stored(gram_scores(counted, model, starts, shards), "pairs")
    books2 = books_of(pairs, shards)
    paired = _with(counted, pairs, buckets, 2, *_ANSWER)
    triples = stored(gram_scores(paired, model, starts, shards, books2[0]), "triples")
    books = [books2, books_of(triples, shards)]
    kind = dict(blocks.dtypes)["ids"][len("array<") : -1]
    schema = pa.schema([("doc_id", _ARROW[kind]), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for ids, held, lengths, raw, *answers in scan(batches, "ids", "held", "lengths", "tokens", "answers1", "answers2", "answers3"):
                (words, known), at, n = vocabulary(answers[0], starts), opened(raw), np.array(lengths)
                first = np.cumsum(n) - n
                base = np.log10((known + 1) / (model.tokens + model.words + 1))
                score = np.add.reduceat(token_scores(model.scores(known), words, at, n, known, answers[1] or [], answers[2] or [], books), first)
                yield from zip(ids, held, lengths, np.add.reduceat((known > 0)[at].astype(np.int64), first).tolist(), [model.tokens] * len(ids), np.add.reduceat(base[at], first).tolist(), score.tolist())

        yield from emit(rows(), schema)

    both = _with(paired, triples, buckets, 3, *_ANSWER)
    return both.select("ids", "held", "lengths", "tokens", "answers1", "answers2", "answers3").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and n-gram score of every document."""
    return score_texts(load(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
