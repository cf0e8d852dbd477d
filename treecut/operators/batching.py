"""Size-bounded next-fit batching of a file manifest, exact and distributed.

The reference packs files, in order, into the open batch while the batch's
bytes stay below the limit; the file that reaches the limit opens the next
batch (so a file at or over the limit is a batch of its own).  Because the
fill resets at every batch, a running sum does not give the batches.

1. The manifest (keys and sizes) is cut into range parts of about
   ``ROWS_PER_PART`` items; the parts' byte counts give each part's offset.
2. A part follows, for every item that could be its first batch start (those
   behind less than ``limit`` bytes of the part), the batches to the last one
   opened in the part.  That one's bytes plus the limit name where the next
   batch starts: a place in a later part.
3. These places meet the items of the part they fall into, which makes a
   table per part, a row of packed numbers: runs of possible first starts that
   lead to the same start of a later part.  The real first starts are the orbit
   of item 0; tables are followed twice, four, eight times by joins of a few
   rows per part (pointer doubling over parts).
4. Every part walks from its real first start and numbers its batches.

The driver holds one row per part; no step sees more than one part at once.
A NULL size counts as 0 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import parts_for

# The reference's per-call byte limits.
REFERENCE_LIMIT_PY = 520_000_000
REFERENCE_LIMIT_CPP = 320_000_000

#: Possible first starts of a part are numbered part * this + place.
_STRIDE = 1 << 32


def _next_start(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each item of a part, and the start of the batch after the
    one that would open there (the part's length if that is beyond it)."""
    ends = np.cumsum(sizes)
    before = ends - sizes
    return before, np.maximum(np.searchsorted(ends, before + limit), np.arange(len(sizes)) + 1)


def _runs(nodes: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Neighbouring starts with the same end become one: the first start of each
    run, and the ends."""
    new = np.ones(len(nodes), dtype=bool)
    new[1:] = np.logical_or.reduce([e[1:] != e[:-1] for e in ends])
    return [x[new] for x in (nodes, *ends)]


def _exits(parted: DataFrame, limit: int, offsets: list[int]) -> DataFrame:
    """A row per part, ``(part, node, low, exit, target)`` as packed numbers:
    its possible first starts and the bytes (from the manifest's start) before
    each; and, for runs of starts, the byte that opens the first batch after
    those of the part."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        part = int(rows[0]["_part"].iloc[0])
        sizes = np.concatenate([f["_size"].to_numpy() for f in rows])
        before, following = _next_start(sizes, limit)
        last, inside = np.arange(len(sizes)), following < len(sizes)
        last[inside] = following[inside]
        while True:  # each round doubles the batches followed
            further = last[last]
            if (further == last).all():
                break
            last = further
        first = np.arange(np.searchsorted(before, limit))
        exits, target = _runs(part * _STRIDE + first, offsets[part] + before[last[first]] + limit)
        # Of items with the same bytes before them only the last is not empty and
        # can reach the limit; the part's first item follows a batch that did.
        low = offsets[part] + before[first]
        filled = np.append(low[1:] != low[:-1], True)
        filled[0] = True
        node, low = part * _STRIDE + first[filled], low[filled]
        yield pd.DataFrame({"part": [part], "node": [node.tobytes()], "low": [low.tobytes()], "exit": [exits.tobytes()], "target": [target.tobytes()]})

    return parted.select("_part", "_size").mapInPandas(run, "part int, node binary, low binary, exit binary, target binary")


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64)


_TABLE = "part int, node binary, nxt binary"


def _pointers(exits: DataFrame, offsets: list[int], full: list[int]) -> DataFrame:
    """``(part, node, nxt)``, a row per part: runs of possible first starts and
    the possible first start of a later part that each leads to (beyond the
    last part: the end).  ``full``: the parts that have items."""
    ends, full = np.array(offsets[1:]), np.array([*full, len(offsets) - 1])

    def parts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, node, target in zip(f["part"], f["exit"], f["target"]):
                node, target = _unpacked(node), _unpacked(target)
                to = full[np.searchsorted(full, np.maximum(np.searchsorted(ends, target), part + 1))]
                for q in np.unique(to).tolist():
                    own = to == q
                    yield pd.DataFrame({"part": [part], "to": [q], "node": [node[own].tobytes()], "target": [target[own].tobytes()]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, q, node, target, starts, low in zip(f["part"], f["to"], f["node"], f["target"], f["starts"], f["low"]):
                node, target = _unpacked(node), _unpacked(target)
                if q == len(ends):
                    nxt = np.full(len(node), len(ends) * _STRIDE)
                else:  # The start is the last one with fewer than `target` bytes before it.
                    nxt = _unpacked(starts)[np.maximum(np.searchsorted(_unpacked(low), target) - 1, 0)]
                yield pd.DataFrame({"part": [part], "node": [node.tobytes()], "nxt": [nxt.tobytes()]})

    asked = exits.select("part", "exit", "target").mapInPandas(parts_of, "part int, to int, node binary, target binary")
    starts = exits.select(F.col("part").alias("to"), F.col("node").alias("starts"), "low")
    met = asked.join(starts, "to", "left").mapInPandas(meet, _TABLE)
    return met.groupBy("part").applyInPandas(_whole, _TABLE)


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a part's table as one, its runs joined again."""
    node, nxt = (np.concatenate([_unpacked(x) for x in rows[c]]) for c in ("node", "nxt"))
    order = np.argsort(node, kind="stable")
    node, nxt = _runs(node[order], nxt[order])
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "node": [node.tobytes()], "nxt": [nxt.tobytes()]})


def _led(node: np.ndarray, table: tuple[bytes, bytes]) -> np.ndarray:
    """Where starts lead by a table of runs."""
    runs, nxt = map(_unpacked, table)
    return nxt[np.searchsorted(runs, node, side="right") - 1]


def _composed(tables: DataFrame, end: int) -> DataFrame:
    """The tables followed twice: a part's table meets those of the parts that it
    leads to (joined rows are pairs of parts, not items)."""
    def parts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, node, nxt in zip(f["part"], f["node"], f["nxt"]):
                node, nxt = _unpacked(node), _unpacked(nxt)
                for q in np.unique(nxt // _STRIDE).tolist():
                    own = nxt // _STRIDE == q
                    yield pd.DataFrame({"part": [part], "to": [q], "node": [node[own].tobytes()], "via": [nxt[own].tobytes()]})

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, node, via, runs, nxt in zip(f["part"], f["node"], f["via"], f["runs"], f["nxt"]):
                led = via if runs is None else _led(_unpacked(via), (runs, nxt)).tobytes()
                yield pd.DataFrame({"part": [part], "node": [node], "nxt": [led]})

    asked = tables.mapInPandas(parts_of, "part int, to int, node binary, via binary")
    other = tables.select(F.col("part").alias("to"), F.col("node").alias("runs"), "nxt")
    return asked.join(other, "to", "left").mapInPandas(follow, _TABLE).groupBy("part").applyInPandas(_whole, _TABLE)


def _first_starts(tables: DataFrame, root: int, end: int, parts: int) -> dict[int, int]:
    """The real first start of each part that has one (one row per part): the
    orbit of item 0, by ``log2(parts)`` doublings of the tables."""
    def hop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"i": [int(_led(np.array([i]), (runs, nxt))[0]) for i, runs, nxt in zip(f["i"], f["node"], f["nxt"])]}, dtype="int64")

    found = tables.sparkSession.range(root, root + 1).select(F.col("id").alias("i"))
    for _ in range(max(1, math.ceil(math.log2(parts + 1)))):
        tables = cut_lineage(tables)
        ahead = found.withColumn("part", F.floor(F.col("i") / _STRIDE).cast("int")).join(tables, "part").select("i", "node", "nxt")
        ahead = ahead.mapInPandas(hop, "i long").where(F.col("i") < end)
        found = cut_lineage(found.unionByName(ahead).distinct())
        tables = _composed(tables, end)
    return {r.i // _STRIDE: r.i % _STRIDE for r in found.collect()}


def next_fit(manifest: DataFrame, order_cols: list[str], size_col: str, limit: int) -> DataFrame:
    """``manifest`` + ``rank`` + ``batch_id`` (from 0, no empty batches).

    ``manifest`` holds one row per item with its byte size; only keys and
    sizes are used, never content.  Items are taken in ``order_cols`` order.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    columns = [*order_cols, size_col, *[c for c in manifest.columns if c not in order_cols and c != size_col]]
    base = manifest.withColumn(size_col, F.col(size_col).cast("bigint")).select(*columns)
    n = base.count()
    sized = base.withColumn("_size", F.coalesce(F.col(size_col), F.lit(0)))
    ordered = sized.repartitionByRange(parts_for(n), *order_cols).sortWithinPartitions(*order_cols)
    parted = cut_lineage(ordered.withColumn("_part", F.spark_partition_id()))
    held = {r["_part"]: r for r in parted.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()}
    parts = 1 + max(held, default=0)
    offsets, ranks = [0], [0]
    for part in range(parts):
        offsets.append(offsets[-1] + (held[part].b if part in held else 0))
        ranks.append(ranks[-1] + (held[part].n if part in held else 0))
    root = min(held, default=0)
    first = {root: 0}
    if len(held) > 1:
        exits = cut_lineage(_exits(parted, limit, offsets))
        first = _first_starts(_pointers(exits, offsets, sorted(held)), root * _STRIDE, parts * _STRIDE, parts)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        part = int(rows[0]["_part"].iloc[0])
        _, following = _next_start(np.concatenate([f["_size"].to_numpy() for f in rows]), limit)
        opens, at = np.zeros(len(following), dtype=np.int64), first.get(part, len(following))
        while at < len(following):
            opens[at] = 1
            at = int(following[at])
        opened, done = np.cumsum(opens), 0
        for f in rows:
            f["_opened"], f["rank"] = opened[done : done + len(f)], ranks[part] + done + np.arange(len(f))
            done += len(f)
            yield f

    # Only keys and sizes go through Python; other columns are joined back.
    keyed = parted.select("_part", "_size", F.monotonically_increasing_id().alias("_row"))
    walked = cut_lineage(keyed.mapInPandas(walk, "_part int, _size long, _row long, _opened long, rank long"))
    batches = {r["_part"]: r.n for r in walked.groupBy("_part").agg(F.max("_opened").alias("n")).collect()}
    earlier = np.cumsum([0, *(batches.get(p, 0) for p in range(parts))]).tolist()
    before = F.element_at(F.lit(earlier), F.col("_part") + 1)
    numbered = walked.select("_row", "rank", (before + F.col("_opened") - 1).cast("bigint").alias("batch_id"))
    rows = parted.withColumn("_row", F.monotonically_increasing_id())
    return rows.join(numbered, "_row").select(*columns, "rank", "batch_id")


def next_fit_local(sizes: list[int], limit: int) -> list[int]:
    """The reference's loop on a list of sizes; a test oracle for small fixtures."""
    out, batch, fill, started = [], 0, 0, False
    for s in sizes:
        s = s or 0
        if not started:
            fill, started = s, True
        elif fill + s < limit:
            fill += s
        else:
            batch += 1
            fill = s
        out.append(batch)
    return out
