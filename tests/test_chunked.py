"""Comparison in chunks equals the fold over whole lists, whatever the chunks."""

import random

import pytest
from pyspark.sql import functions as F

from treecut.operators import chunked
from treecut.operators.chunked import Chunked, runs_of, windows
from treecut.operators.compare import diff_rows, diff_table


def _edited(rng, base, edits):
    other = list(base)
    for _ in range(edits):
        k = rng.randrange(len(other) + 1)
        what = rng.random()
        if what < 0.35:
            other.insert(k, rng.choice(["x", "y,", "z"]))
        elif what < 0.7 and k < len(other):
            del other[k]
        elif k < len(other):
            other[k] = rng.choice(["x", "y", "q"])
    return other


def _pairs(seed, n=60):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{i}" for i in range(rng.choice([3, 40, 400]))]
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 31, 32, 33, 64, 100, 500, 900]))]
        other = _edited(rng, base, rng.choice([0, 1, 5, len(base) // 12]))
        out.append((base, other) if rng.random() < 0.5 else (other, base))
    out += [([], ["a"]), (["a"], []), ([], []), (["a"] * 200, ["a"] * 170), (["a", "b"] * 100, ["b", "a"] * 100), (["x"] * 150, ["y"] * 150),
            (list("ab") * 90 + ["x"] * 40, list("ab") * 90 + ["y"] * 40)]
    return out


def _frame(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")


@pytest.mark.parametrize("size", [32, 50])
def test_equals_the_fold(spark, size):
    df = _frame(spark, _pairs(size))
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], size)
    assert sorted(chunks.diff().collect()) == sorted(diff_table(df, ["k"]).collect())
    got, want = (sorted(x.select("k", "seq", "i", "j", "kind", "cost", "a_context", "b_context").collect()) for x in (chunks.rows(), diff_rows(df, ["k"])))
    assert got == want and len(want) > 100


def test_wrong_guesses_only_cost_rounds(spark, monkeypatch):
    df = _frame(spark, _pairs(9, 12))
    monkeypatch.setattr(Chunked, "_guesses", lambda self: self._own(self.a).select("k", "c", (F.col("c") * self.size).alias("i"), F.when(F.col("c") == 0, 0).otherwise(7).cast("bigint").alias("j")))
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 200)
    assert chunks.rounds > 2
    assert sorted(chunks.diff().collect()) == sorted(diff_table(df, ["k"]).collect())


def test_good_guesses_need_few_rounds(spark):
    rng = random.Random(1)
    base = [rng.choice([f"word{i}" for i in range(300)]) for _ in range(6000)]
    other = [t for w in base for t in ([w] if rng.random() < 0.9 else [w, ","])]
    df = _frame(spark, [(base, other)])
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 100)
    assert chunks.rounds <= 3
    assert chunks.diff().collect() == diff_table(df, ["k"]).collect()


def test_lists_in_runs_and_windows(spark):
    tokens = [f"t{i}" for i in range(500)]
    rng, runs, at = random.Random(2), [], 0
    while at < len(tokens):
        n = rng.choice([0, 1, 2, 7, 90])
        runs.append(("k", at, tokens[at : at + n]))
        at += n
    rng.shuffle(runs)
    df = spark.createDataFrame(runs, "key string, off long, tokens array<string>")
    rows = windows(df, ["key"], 64, 2, 16).collect()
    assert {r.c for r in rows} == set(range(8))
    for r in rows:
        assert r.at == max(0, r.c * 64 - 2) and r.tokens == tokens[r.at : (r.c + 1) * 64 + 16]
    right = spark.createDataFrame([("k", 0, tokens[:300] + tokens[301:])], "key string, off long, tokens array<string>")
    got = Chunked(df, right, ["key"], 64).diff().collect()
    whole = spark.createDataFrame([("k", tokens, tokens[:300] + tokens[301:])], "key string, a array<string>, b array<string>")
    assert got == diff_table(whole, ["key"]).collect()


def test_only_keys_on_both_sides(spark):
    runs = [spark.createDataFrame([(k, 0, ["a", "b", "c"]) for k in keys], "k int, off long, tokens array<string>") for keys in ((1, 2), (2, 3))]
    assert [r.k for r in Chunked(*runs, ["k"], 32).diff().collect()] == [2]


def test_no_list_becomes_a_row(spark, monkeypatch):
    """The longest array that any step holds is a window, not a list."""
    seen = []
    kept = chunked._written
    monkeypatch.setattr(chunked, "_written", lambda df, name: seen.append((name, df)) or kept(df, name))
    base = [f"w{i % 97}" for i in range(5000)]
    runs = [spark.createDataFrame([(1, at, x[at : at + 100]) for at in range(0, len(x), 100)], "k int, off long, tokens array<string>") for x in (base, base[:2000] + base[2001:])]
    chunks = Chunked(*runs, ["k"], 64)
    assert chunks.diff().first().mismatched == 1
    longest = [chunks.a.select(F.max(F.size("tokens"))).first()[0], chunks.b.select(F.max(F.size("tokens"))).first()[0]]
    assert max(longest) <= 64 * 2 + 64 // 2 + 64


def test_rounds_do_not_grow_with_the_list(spark, monkeypatch):
    """All guesses fail: 200 chunks took 200 rounds, longer walks take a few."""
    rng = random.Random(6)
    base = [rng.choice([f"w{i}" for i in range(50)]) for _ in range(3000)] + list("ab") * 1700
    other = _edited(rng, base, 40)
    df = _frame(spark, [(base, other), (base[:700], other[:650]), (["a"], ["b"]), ([], ["a"])])
    monkeypatch.setattr(Chunked, "_guesses", lambda self: self._own(self.a).select("k", "c", (F.col("c") * self.size).alias("i"), F.when(F.col("c") == 0, 0).otherwise(7).cast("bigint").alias("j")))
    monkeypatch.setattr(Chunked, "_nudged", lambda self, seen: seen)
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 32)
    want = diff_table(df, ["k"]).orderBy("k").collect()
    assert want[0].compared > 3000 and chunks.rounds <= 8
    assert sorted(chunks.diff().collect()) == sorted(want)
    got, want = (sorted(x.select("k", "seq", "i", "j", "kind", "cost", "a_context", "b_context").collect()) for x in (chunks.rows(), diff_rows(df, ["k"])))
    assert got == want


def _nodes(plan):
    children = plan.children()
    return [plan, *(x for i in range(children.size()) for x in _nodes(children.apply(i)))]


def test_no_token_array_is_shuffled(spark):
    """Lists meet as one text each, and sums of ``n`` need no tokens."""
    df = _frame(spark, _pairs(3, 6))
    runs = [df.select("k", F.lit(0).cast("bigint").alias("off"), F.size(x).alias("n"), F.col(x).alias("tokens")) for x in "ab"]
    c = Chunked(*runs, ["k"], 40)
    seen = c._with_tokens(c.linked.select("k", "c", "i", "j"))
    grouped = windows(runs[0], ["k"], 40, 2, 16)
    for plan in (x._jdf.queryExecution().optimizedPlan() for x in (seen, grouped)):
        joins = [x for x in _nodes(plan) if x.nodeName() in ("Join", "Aggregate")]
        assert joins
        for child in (y for x in joins for y in (x.children().apply(i) for i in range(x.children().size()))):
            assert not [f for f in child.schema().fields() if f.dataType().simpleString().startswith("array<string>")]
    assert sorted(map(tuple, c.diff().collect())) == sorted(map(tuple, diff_table(df, ["k"]).collect()))
