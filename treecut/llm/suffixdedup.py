"""Operator 10, removal of repeated byte strings by a distributed suffix sort.

A byte goes if a string of ``LENGTH`` bytes over it also starts somewhere else.
Sorting every suffix would ship the text many times over, so, as in
communication-efficient string sorting, fingerprints first tell which suffixes
can have an equal prefix at all, and only those are exchanged:

1. Anchors.  Of the hashes of all GRAM-byte strings, each stretch of LENGTH bytes
   selects its smallest, so equal stretches select it at the same place.  An
   anchor's context is what all stretches that could select it consist of: up to
   LENGTH - GRAM bytes before it and LENGTH from it on.
2. Blocks of documents send the shards (ranges of the anchors' hashes) their
   distinct anchor and context hashes.  An anchor that is unique covers nothing
   repeated; contexts equal under one anchor are settled, all their stretches
   repeat.  Of the others, and one of each settled kind that has another context
   beside it, the suffixes are sorted.
3. A block sorts those suffixes (ordered by anchor hash, then bytes) and sends
   each shard its run front-coded: the length of the prefix shared with the
   suffix before, and the rest.
4. A shard merges its runs with a loser tree that compares from the known common
   prefix on, and takes the prefixes common to neighbours from it.  Two suffixes
   share d bytes to the left and LENGTH - d to the right just where they lie in
   the same interval of the merged order and of the order of the left parts.
5. Blocks mark the stretches found and cut the bytes that they cover.

An anchor with more than HOT contexts would be a heavy group: each of its
stretches is sent as a suffix of its own instead, under its own hash.

Defined cases: a null text is empty; texts shorter than LENGTH stay whole; copies
of a text, and rows that repeat, remove each other wholly; matches never cross
texts; keys may be null or repeat; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, growing, load, once_per_worker, scan, stored, utf8

LENGTH = 200
GRAM = 100
#: Bytes of a block, and of a text that are hashed at a time.
BLOCK_BYTES = 1 << 22
PART = 1 << 20
#: Suffixes cut out at a time.
ROWS = 1 << 13
#: Anchors that one shard merges, and contexts of an anchor sent as such.
SHARD_ANCHORS = 2_000_000
HOT = 4096

_BASE = 0xD6E8FEB86659FD93
#: States that a shard answers for an anchor's context.
UNIQUE, SETTLED, SORT, SETTLED_SORT, SORT_EACH, SETTLED_SORT_EACH = range(6)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    def make(base: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return once_per_worker(("powers", n), lambda: (make(_BASE), make(pow(_BASE, -1, 1 << 64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by running bests of blocks."""
    rows = np.full(-(-len(a) // width) * width, fill, dtype=a.dtype)
    rows[: len(a)] = a
    rows = rows.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: len(a) - width + 1], ahead[width - 1 : len(a)])


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of a text's anchors; a long text is
    hashed in overlapping parts."""
    reach, found = length - gram + 1, []
    stretches = len(text) - length + 1
    for start in range(0, stretches, PART):
        count = min(PART, stretches - start)
        lo, hi = max(0, start - reach + 1), min(len(text), start + count + length + reach)
        power, inverse = _powers(PART + length + 2 * reach + length + 2)
        own = text[lo:hi].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * power[: len(own)], dtype=np.uint64)))
        at = np.arange(start - lo, start - lo + count + reach - 1)
        grams = _mixed((sums[at + gram] - sums[at]) * inverse[at])
        least = _sliding(grams, reach, np.minimum, (1 << 64) - 1)
        edge = np.zeros(reach - 1, np.uint64)
        chosen = np.flatnonzero(grams == _sliding(np.concatenate((edge, least, edge)), reach, np.maximum, 0))
        place = chosen + start
        left, right = np.maximum(place - reach + 1, 0), np.minimum(place + length, len(text))
        sizes = (place - left) * (length + 1) + (right - place)
        context = _mixed((sums[right - lo] - sums[left - lo]) * inverse[left - lo] + np.uint64(0x2545F4914F6CDD1D) * sizes.astype(np.uint64))
        found.append((place, grams[chosen], context))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, key, context = map(np.concatenate, zip(*found))
    place, first = np.unique(place, return_index=True)  # parts overlap
    return place, key[first], context[first]


def _blocks(docs: DataFrame, text: str, key: str, length: int, gram: int) -> DataFrame:
    """Blocks of documents: ids, lengths, the compressed text, and the anchors'
    places and hashes."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.spark_partition_id().alias("part"))
    kind = dict(source.dtypes)["doc_id"]
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(_ARROW[kind])), ("lengths", pa.list_(pa.int64())), ("text", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("contexts", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(number: int, ids: list, texts: list[bytes]) -> tuple:
            lengths = [len(t) for t in texts]
            start = np.cumsum(lengths) - lengths
            parts = [anchors(np.frombuffer(t, np.uint8), length, gram) for t in texts]
            place = np.concatenate([p + s for (p, _, _), s in zip(parts, start)]).astype("<u4")
            steps = np.diff(place, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
            return number, ids, lengths, zstandard.compress(b"".join(texts), 3), steps, *(np.concatenate([p[i] for p in parts]).tobytes() for i in (1, 2)), len(place)

        def blocks() -> Iterator[tuple]:
            done, ids, texts, total, part = 0, [], [], 0, 0
            for doc_id, body, part in scan(batches, "doc_id", "_text", "part"):
                own = utf8(body)
                if ids and total + len(own) > BLOCK_BYTES:
                    yield block((part << 32) + done, ids, texts)
                    done, ids, texts, total = done + 1, [], [], 0
                ids.append(doc_id)
                texts.append(own)
                total += len(own)
            if ids:
                yield block((part << 32) + done, ids, texts)

        yield from emit(blocks(), schema, 1)

    return source.mapInArrow(run, f"block long, ids array<{kind}>, lengths array<long>, text binary, places binary, keys binary, contexts binary, n long")


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1), dtype=np.int64)


def _kinds(keys: bytes, contexts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, context) hashes in order, how often each occurs, and
    the number of each anchor's kind."""
    key, context = np.frombuffer(keys, np.uint64), np.frombuffer(contexts, np.uint64)
    order = np.lexsort((context, key))
    k, c = key[order], context[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
    kind = np.empty(len(k), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    return k[new], c[new], np.bincount(kind, minlength=int(new.sum())), kind


def _cuts(key: np.ndarray, shards: int) -> np.ndarray:
    edge = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(key, edge), [len(key)])).astype(np.int64)


def states(blocks: DataFrame, shards: int) -> DataFrame:
    """``block``, ``shard`` and a state byte per distinct context sent."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, keys, contexts in scan(batches, "block", "keys", "contexts"):
                key, context, often, _ = _kinds(keys, contexts)
                cut = _cuts(key, shards)
                for shard in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    own = slice(cut[shard], cut[shard + 1])
                    yield shard, block, key[own].tobytes(), context[own].tobytes(), (often[own] > 1).astype(np.uint8).tobytes()

        yield from emit(rows(), pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary()), ("twice", pa.binary())]), 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, group in groupby(scan(batches, "shard", "block", "keys", "contexts", "twice"), key=lambda r: r[0]):
                _, block, keys, contexts, twice = zip(*group)
                key, context, _, kind = _kinds(b"".join(keys), b"".join(contexts))
                own = np.frombuffer(b"".join(twice), np.uint8)
                seen = np.bincount(kind, own + 1, minlength=len(key))
                first = np.full(len(key), len(kind))
                np.minimum.at(first, kind, np.arange(len(kind)))
                group_of = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
                size = np.bincount(group_of)[group_of]
                several, settled = size > 1, seen > 1
                state = np.where(settled, SETTLED, UNIQUE)[kind]
                sort = several[kind] & (~settled[kind] | (first[kind] == np.arange(len(kind))))
                state[sort] += np.where(size[kind] > HOT, SORT_EACH, SORT)[sort]
                state = state.astype(np.uint8)
                ends = np.cumsum([len(k) // 8 for k in keys])
                for b, part in zip(block, np.split(state, ends[:-1])):
                    yield b, shard, part.tobytes()

        yield from emit(rows(), pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("states", pa.binary())]), 16)

    sent = blocks.select("block", "keys", "contexts").mapInArrow(send, "shard int, block long, keys binary, contexts binary, twice binary")
    return sent.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(merge, "block long, shard int, states binary")


def _suffixes(text: np.ndarray, end: np.ndarray, begin: np.ndarray, place: np.ndarray, key: np.ndarray, length: int, left: int) -> np.ndarray:
    """Rows to sort: the hash, the bytes from ``place`` on with their number,
    the ``left`` bytes before it backwards with their number plus 1."""
    ahead, behind = np.arange(length), np.arange(1, left + 1)
    out = np.zeros((len(place), 8 + length + 1 + left + 1), dtype=np.uint8)
    out[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8 + length] = np.minimum(end - place, length)
    out[:, -1] = np.minimum(place - begin, left) + 1
    for lo in range(0, len(place), ROWS):
        some = slice(lo, lo + ROWS)
        at = place[some, None] + ahead
        out[some, 8 : 8 + length] = np.where(at < end[some, None], text[np.minimum(at, len(text) - 1)], 0)
        if left:
            at = place[some, None] - behind
            out[some, 9 + length : -1] = np.where(at >= begin[some, None], text[np.maximum(at, 0)], 0)
    return out


def _shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before."""
    differ = rows[1:] != rows[:-1]
    return np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]))[: len(rows)]


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Row order by bytes (the last byte is never 0)."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def runs(both: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """From blocks with their states: front-coded sorted runs for the shards
    (``shared``, ``rest``; ``of`` and ``places`` tell which suffix is at which
    place), and with a null shard the places of settled anchors."""
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, lengths, packed, steps, keys, contexts, states_ in scan(batches, "block", "lengths", "text", "places", "keys", "contexts", "states"):
                place, (key, _, _, kind) = _places(steps), _kinds(keys, contexts)
                state = np.frombuffer(b"".join(s["states"] for s in states_), np.uint8)[kind] if len(place) else np.zeros(0, np.uint8)
                key = key[kind]
                yield block, None, None, None, None, place[np.isin(state, (SETTLED, SETTLED_SORT, SETTLED_SORT_EACH))].astype("<u4").tobytes()
                text = np.frombuffer(zstandard.decompress(packed), np.uint8)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, place, side="right")
                begin, end = (ends - lengths)[doc], ends[doc]
                # One of equal contexts in the block is enough.
                _, once = np.unique(kind, return_index=True)
                whole = once[np.isin(state[once], (SORT, SETTLED_SORT))]
                each = once[np.isin(state[once], (SORT_EACH, SETTLED_SORT_EACH))]
                found = [(_suffixes(text, end[whole], begin[whole], place[whole], key[whole], length, left), place[whole])]
                start = (place[each, None] - np.arange(left + 1)).ravel()
                lowest, highest = np.repeat(begin[each], left + 1), np.repeat(end[each], left + 1)
                # Neighbouring anchors share stretches; each place counts once.
                start = np.unique(start[(start >= lowest) & (start + length <= highest)])
                power, _ = _powers(length)
                for lo in range(0, len(start), ROWS):
                    some = start[lo : lo + ROWS]
                    wide = _suffixes(text, some + length, some, some, np.zeros(len(some), np.uint64), length, left)
                    own = ((wide[:, 8 : 8 + length].astype(np.uint64) + np.uint64(1)) * power).sum(axis=1, dtype=np.uint64)
                    wide[:, :8] = _mixed(own).astype(">u8").view(np.uint8).reshape(-1, 8)
                    found.append((wide, some))
                suffix, at = map(np.concatenate, zip(*found))
                order = _sorted(suffix)
                suffix, at = suffix[order], at[order]
                shared = _shared(suffix)
                of = np.cumsum(shared < suffix.shape[1]) - 1
                hash_ = suffix[:, :8].copy().view(">u8").ravel().astype(np.uint64)
                cut = _cuts(hash_, shards)
                for shard in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    own = slice(cut[shard], cut[shard + 1])
                    new = np.flatnonzero(shared[own] < suffix.shape[1]) + cut[shard]
                    common = shared[new].copy()
                    common[0] = 0
                    rest = suffix[new][np.arange(suffix.shape[1]) >= common[:, None]]
                    yield block, shard, common.astype("<u2").tobytes(), rest.tobytes(), (of[own] - of[cut[shard]]).astype("<u4").tobytes(), at[own].astype("<u4").tobytes()

        yield from emit(rows(), pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("shared", "rest", "of", "places"))]), 4)

    return both.mapInArrow(run, "block long, shard int, shared binary, rest binary, of binary, places binary")


class Run:
    """A front-coded run being read: the current suffix and the length of the
    prefix that it is known to share with the last one the merge gave out."""

    def __init__(self, number: int, shared: bytes, rest: bytes, width: int):
        self.number, self.width, self.rest, self.at, self.next = number, width, rest, 0, 0
        self.steps = np.frombuffer(shared, "<u2").tolist()
        self.suffix: bytes | None = b""
        self.common = 0
        self.advance()

    def advance(self) -> None:
        if self.next == len(self.steps):
            self.suffix = None
            return
        self.common = self.steps[self.next]
        end = self.at + self.width - self.common
        self.suffix = self.suffix[: self.common] + self.rest[self.at : end]
        self.at, self.next = end, self.next + 1


def merged(runs_: list[Run]) -> Iterator[tuple[int, bytes, int]]:
    """Run number, suffix, and the prefix shared with the suffix before.

    A loser tree whose nodes know how much their suffix shares with the last
    winner: of two, the one that shares more is the smaller; only if they share
    the same are bytes compared, from there on.
    """
    size = 1
    while size < len(runs_):
        size *= 2
    losers: list[Run | None] = [None] * size

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if a is None or a.suffix is None:
            return b, a
        if b is None or b.suffix is None:
            return a, b
        if a.common != b.common:
            return (a, b) if a.common > b.common else (b, a)
        known = a.common
        x, y = a.suffix[known:], b.suffix[known:]
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        common = known + len(x) - (differ.bit_length() + 7) // 8
        if x < y or (not differ and a.number < b.number):
            b.common = common
            return a, b
        a.common = common
        return b, a

    level: list[Run | None] = [*runs_, *[None] * (size - len(runs_))]
    at = size
    while at > 1:
        at //= 2
        won = []
        for i in range(at):
            winner, losers[at + i] = play(level[2 * i], level[2 * i + 1])
            won.append(winner)
        level = won
    winner = level[0]
    leaf = {r.number: size + i for i, r in enumerate(runs_)}
    while winner is not None and winner.suffix is not None:
        yield winner.number, winner.suffix, winner.common
        own = winner
        own.advance()
        node, winner = leaf[own.number] // 2, own
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def stretches(sent: DataFrame, length: int, gram: int) -> DataFrame:
    """``block`` and the starts of its repeated stretches, per shard."""
    left = length - gram
    width = 8 + length + 1 + left + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(scan(batches, "shard", "block", "shared", "rest", "of", "places"), key=lambda r: r[0]):
                _, block, shared, rest, of, places = zip(*group)
                order = list(merged([Run(i, s, r, width) for i, (s, r) in enumerate(zip(shared, rest))]))
                number = np.array([n for n, _, _ in order])
                common = np.array([c for _, _, c in order])
                suffix = np.frombuffer(b"".join(s for _, s, _ in order), np.uint8).reshape(-1, width)
                hit = repeated(suffix, common, length, left)
                # A stretch that a block sent for several places repeats as it is.
                for i, b in enumerate(block):
                    own, at = (np.frombuffer(x[i], "<u4").astype(np.int64) for x in (of, places))
                    mine = hit[np.flatnonzero(number == i)]
                    mine[np.bincount(own, minlength=len(mine)) > 1, 0] = True
                    which, d = np.nonzero(mine[own])
                    yield b, (at[which] - d).astype("<u4").tobytes()

        yield from emit(rows(), pa.schema([("block", pa.int64()), ("starts", pa.binary())]), 16)

    ordered = sent.where("shard is not null").repartition("shard").sortWithinPartitions("shard", "block")
    return ordered.select("shard", "block", "shared", "rest", "of", "places").mapInArrow(run, "block long, starts binary")


def repeated(suffix: np.ndarray, common: np.ndarray, length: int, left: int) -> np.ndarray:
    """For sorted distinct or equal suffixes: whether the stretch that starts d
    bytes before each one's place is also that of another."""
    n_right, n_left = suffix[:, 8 + length].astype(np.int64), suffix[:, -1].astype(np.int64) - 1
    right = np.clip(common - 8, 0, length)
    right[1:] = np.minimum(right[1:], np.minimum(n_right[1:], n_right[:-1]))
    before = suffix[:, 9 + length :]
    by_left = _sorted(before)
    ordered, n = before[by_left], n_left[by_left]
    shares = np.minimum(_shared(ordered), left)
    shares[1:] = np.minimum(shares[1:], np.minimum(n[1:], n[:-1]))
    hit = np.zeros((len(suffix), left + 1), dtype=bool)
    left_class = np.empty(len(suffix), dtype=np.int64)
    for d in range(left + 1):
        able = np.flatnonzero((n_right >= length - d) & (n_left >= d))
        if len(able) < 2:
            continue
        left_class[by_left] = np.cumsum(shares < d) if d else 0
        pair = np.cumsum(right < length - d)[able] * (len(suffix) + 1) + left_class[able]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        hit[able[order[1:][same]], d] = True
        hit[able[order[:-1][same]], d] = True
    return hit


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``kept``, the remaining bytes."""
    spark = docs.sparkSession
    blocks = stored(_blocks(docs, text, key, length, gram), "blocks")
    total = blocks.agg(F.sum("n")).head()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // SHARD_ANCHORS)
    answer = stored(states(blocks, shards), "states")
    mine = answer.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "states"))).alias("states"))  # of one block's anchors
    both = blocks.select("block", "lengths", "text", "places", "keys", "contexts").join(growing(mine), "block")
    sent = stored(runs(both, shards, length, gram), "runs")
    settled = sent.where("shard is null").groupBy("block").agg(F.first("places").alias("settled"))
    found = stored(stretches(sent, length, gram), "stretches").groupBy("block").agg(F.collect_list("starts").alias("starts"))
    done = blocks.select("block", "ids", "lengths", "text").join(growing(settled.join(growing(found), "block", "left")), "block", "left")
    kind = dict(blocks.dtypes)["ids"][len("array<") : -1]
    schema = pa.schema([("doc_id", _ARROW[kind]), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for ids, lengths, packed, places, starts in scan(batches, "ids", "lengths", "text", "settled", "starts"):
                text = np.frombuffer(zstandard.decompress(packed), np.uint8)
                ends = np.cumsum(lengths)
                change = np.zeros(len(text) + 1, dtype=np.int32)
                place = np.frombuffer(places or b"", "<u4").astype(np.int64)
                doc = np.searchsorted(ends, place, side="right")
                # All stretches over a settled anchor: from its context's start to its end.
                begin, end = np.maximum(place - length + gram, (ends - lengths)[doc]), np.minimum(place + length, ends[doc])
                some = end - begin >= length
                np.add.at(change, begin[some], 1)
                np.add.at(change, end[some], -1)
                start = np.frombuffer(b"".join(starts or []), "<u4").astype(np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                for doc_id, n, last in zip(ids, lengths, ends.tolist()):
                    own = gone[last - n : last]
                    kept = text[last - n : last][~own].tobytes()
                    spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                    yield doc_id, n, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept

        yield from emit(rows(), schema, 500)

    return done.select("ids", "lengths", "text", "settled", "starts").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that repeat."""
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")
