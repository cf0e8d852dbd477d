"""Exact distributed next-fit equals the reference loop."""

import random

import pytest

from treecut.operators import batching, ordering
from treecut.operators.batching import next_fit, next_fit_local


@pytest.mark.parametrize("seed,limit", [(1, 10), (2, 25), (3, 7), (4, 1000), (5, 1)])
def test_next_fit_matches_loop(spark, monkeypatch, seed, limit):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 3, 5, 8, 13, 30]) for _ in range(rng.randint(1, 300))]
    df = spark.createDataFrame([(f"f{i:05d}", s) for i, s in enumerate(sizes)], "path string, length long")
    exp = next_fit_local(sizes, limit)
    for rows in (200_000, 23):     # one part, many parts
        monkeypatch.setattr(ordering, "ROWS_PER_PART", rows)
        got = {r.path: (r.rank, r.batch_id) for r in next_fit(df, ["path"], "length", limit).collect()}
        for i in range(len(sizes)):
            assert got[f"f{i:05d}"] == (i, exp[i]), (rows, i)


@pytest.mark.parametrize("sizes", [[5, None, 7], [None, 5, 7], [5, 7, None], [None] * 9, [None, None, 11, None, 3] * 6, []])
def test_null_sizes_count_as_zero(spark, monkeypatch, sizes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, bytes long")
    for rows in (200_000, 2):
        monkeypatch.setattr(ordering, "ROWS_PER_PART", rows)
        got = next_fit(df, ["k"], "bytes", 10).orderBy("k").collect()
        assert [(r.bytes, r.batch_id) for r in got] == list(zip(sizes, next_fit_local(sizes, 10)))


def test_oversize_and_phase(spark, monkeypatch):
    # Equal sizes whose batches never re-align across parts, plus oversize items.
    sizes = [1] * 57 + [50] + [1] * 20 + [99, 99] + [2] * 10
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, bytes long")
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 7)
    got = [r.batch_id for r in next_fit(df, ["k"], "bytes", 3).orderBy("k").collect()]
    assert got == next_fit_local(sizes, 3)


def test_reference_semantics():
    # fill + size < limit joins; reaching the limit opens a new batch.
    assert next_fit_local([4, 5, 1, 9, 10, 3], 10) == [0, 0, 1, 2, 3, 4]
    assert next_fit_local([20, 1, 1], 10) == [0, 1, 1]


@pytest.mark.parametrize("sizes,limit", [([3] * 4000, 2000), ([0] * 4000, 10), ([1, 2, 3, 0] * 1000, 10**6), ([1] * 4000, 1900), ([0] * 3000 + [5] * 1000, 7)])
def test_tables_are_rows_per_part(spark, monkeypatch, sizes, limit):
    """Batches beyond a part: what the doublings join is a few rows per part, not
    a row per item, and the batches are those of the loop."""
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 500)
    seen, composed = [], batching._composed
    monkeypatch.setattr(batching, "_composed", lambda tables, end: seen.append(tables.count()) or composed(tables, end))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, bytes long")
    got = [r.batch_id for r in next_fit(df, ["k"], "bytes", limit).orderBy("k").collect()]
    assert got == next_fit_local(sizes, limit)
    assert seen and max(seen) <= 0.01 * len(sizes)
