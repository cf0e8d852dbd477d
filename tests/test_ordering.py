"""Running totals and in-group offsets over range parts vs brute force."""

import random

from treecut.operators.ordering import offsets_within, running_total


def test_offsets_within_hot_group(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        size = 400 if g == 5 else rng.randint(1, 30)      # one group holds about half the rows
        rows += [(f"g{g:02d}", k, rng.randint(0, 9)) for k in range(size)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, k long, v long")
    got = {(r.grp, r.k): r.off for r in offsets_within(df, ["grp"], ["k"], "v", "off", n_parts=13).collect()}
    exp, run = {}, {}
    for grp, k, v in sorted(rows):
        exp[(grp, k)] = run.get(grp, 0)
        run[grp] = run.get(grp, 0) + v
    assert got == exp


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 100)) for k in range(777)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: (r._rank, r.cum) for r in running_total(df, ["k"], "v", "cum", n_parts=7).collect()}
    acc = 0
    for k, v in rows:
        acc += v
        assert got[k] == (k, acc)


def test_with_group_aggregates_hot_group(spark):
    from pyspark.sql import functions as F

    from treecut.operators.ordering import with_group_aggregates
    rows = [("hot", k, 1) for k in range(1000)] + [("cold", k, 2) for k in range(5)] + [(None, None, 4), (None, 3, 4)]
    df = spark.createDataFrame(rows, "g string, turn long, v long")
    out = with_group_aggregates(df, ["g"], [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")])
    got = {(r.g, r.turn): (r.n, r.s) for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[("hot", k)] == (1000, 1000) for k in range(1000))
    assert all(got[("cold", k)] == (5, 10) for k in range(5))
    assert got[(None, None)] == got[(None, 3)] == (2, 8)
