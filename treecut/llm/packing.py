"""Operator 6, best-fit packing by exact-complement hashing.

Spark tokenises and counts pieces per length.  The plan is made on those at most
``capacity`` counts alone: sums of one, two and three available lengths are
looked up for the gap that a length leaves, and a combination that fills it
exactly is used as often as its lengths last; what remains is placed best-fit,
longest first.  Spark then numbers the pieces of each length and looks their
places up, so no piece passes through the driver.

Defined cases: a null or empty text has only the end id 0; repeated rows are
packed each on their own; a null doc_id is carried along; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import emit, growing, load, once_per_worker, scan, stored

CAPACITY = 2048
END = b"\0\0\0\0"
#: Fixed value: the token that the public vocabulary adds to its ranks.
ADDED = {"<|endoftext|>": 50256}
#: Words whose ids a worker keeps; further words are encoded each time.
CACHED_WORDS = 300_000


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    A blank before a visible character, and a line feed between visible
    characters, always end a pre-token of this vocabulary's pattern, so words
    are encoded once and their ids joined; other texts are encoded whole.  Added
    tokens are cut out first, wherever they stand.
    """

    def __init__(self, ranks_file: str, added: dict[str, int] = ADDED):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {text: np.array([number], dtype="<u4").tobytes() for text, number in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.feed = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._ids(word)
        if len(self.known) < CACHED_WORDS and len(word) < 40:
            self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.at_added and self.at_added.search(text):
            return b"".join(self.added.get(part) or self._plain(part) for part in self.at_added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        known, word, out = self.known, self._word, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            # Blank next to white space: the split would not be a pre-token's end.
            if not line or line[0].isspace() or line[-1].isspace() or not all(rest) or any(x[0].isspace() for x in rest):
                return self._ids(text)
            if out:
                out.append(self.feed)
            out.append(known.get(first) or word(first))
            for x in rest:
                x = " " + x
                out.append(known.get(x) or word(x))
        return b"".join(out)


def pieces(docs: DataFrame, ranks_file: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with length, CRC, and their number among the pieces of that length
    made by the same task (``part``, ``nth``)."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind, id_type = dict(source.dtypes)["doc_id"], to_arrow_type(source.schema["doc_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = once_per_worker(("encoder", ranks_file), lambda: Encoder(ranks_file)), TaskContext.get().partitionId(), [0] * (capacity + 1)

        def rows() -> Iterator[tuple]:
            for doc_id, body in scan(batches, "doc_id", "_text"):
                ids = encode(body or "") + END
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = min(capacity, total) if start or total % capacity == 0 else total % capacity
                    yield doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]
                    seen[length] += 1
                    start, piece = start + length, piece + 1

        schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
        yield from emit(rows(), schema)

    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length: the fewest sequences
    among fillings of a gap by up to three, two, one or no other lengths before
    the best fit.  See ``filled``."""
    return min((filled(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda found: found[1])[0]


def filled(counts: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, int]:
    """Places, and how many sequences they take.

    Returns rows (length, first, per, sequence, offset): the pieces of that
    length numbered from ``first`` go, ``per`` to a sequence, into the sequences
    from ``sequence`` on, the first of each at ``offset``.  Every step uses a
    length or a group of alike sequences up, so there are few rows however many
    pieces there are.
    """
    left, taken, rows, sequence = counts.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64), [], 0

    def put(length: int, per: int, bins: int, at: int, offset: int) -> None:
        rows.append((length, int(taken[length]), per, at, offset))
        taken[length] += per * bins
        left[length] -= per * bins

    def pair(gap: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the longer as long as can be."""
        longer = np.arange(gap - 1, (gap - 1) // 2, -1)
        fits = np.flatnonzero((left[longer] > 0) & (left[gap - longer] > 0) & ((longer * 2 != gap) | (left[longer] > 1)))
        return (int(longer[fits[0]]), int(gap - longer[fits[0]])) if len(fits) else None

    def fill(gap: int) -> tuple[int, ...] | None:
        if gap < 1:
            return () if gap == 0 else None
        if most and left[gap]:
            return (gap,)
        if most > 1 and gap > 1 and (two := pair(gap)):
            return two
        for a in np.flatnonzero(left[: max(gap - 1, 0)])[::-1] if most > 2 else ():
            left[a] -= 1
            two = pair(int(gap - a))
            left[a] += 1
            if two:
                return (int(a), *two)
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            rest = fill(capacity - length)
            left[length] += 1
            if rest is None:
                break
            use: dict[int, int] = {}
            for x in (length, *rest):
                use[x] = use.get(x, 0) + 1
            bins, offset = min(int(left[x]) // n for x, n in use.items()), 0
            for x, n in use.items():
                put(x, n, bins, sequence, offset)
                offset += x * n
            sequence += bins

    gaps: list[int] = []  # sorted room of open groups
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def keep(room: int, at: int, bins: int) -> None:
        if room and bins:
            if room not in open_:
                insort(gaps, room)
            open_.setdefault(room, []).append((at, bins))

    for length in range(capacity, 0, -1):
        while left[length]:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                per = min(capacity // length, int(left[length]))
                bins = int(left[length]) // per
                put(length, per, bins, sequence, 0)
                keep(capacity - per * length, sequence, bins)
                sequence += bins
                continue
            room = gaps[i]
            at, bins = open_[room].pop()
            if not open_[room]:
                del open_[room], gaps[i]
            per = min(room // length, int(left[length]))
            used = min(bins, int(left[length]) // per)
            put(length, per, used, at, capacity - room)
            keep(room - per * length, at, used)
            keep(room, at + used, bins - used)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (see ``pieces``; it is stored first) with its places."""
    cut = stored(cut, "pieces")
    per_task = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).toLocalIterator():  # at most `capacity` rows
        counts[length] = n
    places = plan(counts, capacity)
    # How many pieces of a length earlier tasks made: one row per task and length.
    before = per_task.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n as before")
    numbered = cut.join(growing(before), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("_nth"))
    kind = dict(cut.dtypes)["doc_id"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(counts.max()) + 1
        first = places[:, 0] * stride + places[:, 1]
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("_nth").to_numpy()
            row = places[np.searchsorted(first, length * stride + nth, side="right") - 1]
            bin_, slot = np.divmod(nth - row[:, 1], row[:, 2])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(look_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, ranks_file: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pack every document; ``ranks_file`` names the byte-level BPE vocabulary."""
    return place(pieces(docs, ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), text, key, capacity), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(load(spark, sf_dir, "documents"))
