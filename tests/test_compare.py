"""The fold, the Python walk, and hand-derived goldens agree."""

import random

from pyspark.sql import functions as F

from treecut.operators.compare import LOOKAHEAD, diff_rows, diff_table, mismatch_rollup, pair_tables


def walk_events(a, b):
    """The walk in plain Python, listing every mismatch."""
    n, i, j, out = min(len(a), len(b)), 0, 0, []
    while i < n - 1 and j < n - 1:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for kind, da, db, mi, mj, cost, _ in LOOKAHEAD:
            if i + da < len(a) and j + db < len(b) and a[i + da] == b[j + db]:
                out.append({"seq": len(out), "kind": kind, "cost": cost})
                i, j = i + mi, j + mj
                break
        else:
            out.append({"seq": len(out), "kind": "stop", "cost": 0})
            break
    return out


def walk_counts(a, b):
    ev = walk_events(a, b)
    count = sum(e["cost"] for e in ev)
    # Re-run the walk to find the final i (compared).
    n = min(len(a), len(b))
    i = j = 0
    moves = {"skip": (1, 1), "b_jump1": (2, 3), "a_jump1": (3, 2), "a_jump2": (4, 2), "a_jump3": (5, 2),
             "a_jump5": (7, 2)}
    evs = iter(ev)
    while i < n - 1 and j < n - 1:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        e = next(evs)
        if e["kind"] == "stop":
            break
        i += moves[e["kind"]][0]
        j += moves[e["kind"]][1]
    return count, i


# Hand-derived: (a, b, mismatched, compared, kinds)
GOLD = [
    (list("abcdef"), list("abcdef"), 0, 5, []),
    (list("abXdef"), list("abYdef"), 1, 5, ["skip"]),
    (list("abcdef"), list("abZcdef"), 1, 4, ["b_jump1"]),     # extra token in b: j reaches n-1
    (list("abZcdef"), list("abcdef"), 1, 5, ["a_jump1"]),     # extra token in a
    (list("abZZcdefg"), list("abcdefg"), 2, 6, ["a_jump2"]),
    (list("abZZZcdefgh"), list("abcdefgh"), 3, 7, ["a_jump3"]),
    (list("abZZZZZcdefghijk"), list("abcdefghijk"), 5, 10, ["a_jump5"]),
    (list("abPQRSTUVW"), list("abxyzwvuts"), 0, 2, ["stop"]),
    ([], list("abc"), 0, 0, []),
    (["x"], ["y"], 0, 0, []),
]


def test_goldens_python():
    for a, b, m, c, kinds in GOLD:
        assert walk_counts(a, b) == (m, c), (a, b)
        assert [e["kind"] for e in walk_events(a, b)] == kinds, (a, b)


def test_fold_equals_walk_on_goldens_and_random(spark):
    rng = random.Random(5)
    pairs = [(a, b) for a, b, *_ in GOLD]
    for _ in range(3000):
        base = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            op = rng.random()
            k = rng.randint(0, max(0, len(other) - 1))
            if op < 0.3 and other:
                other[k] = rng.choice("xyz")
            elif op < 0.6:
                other.insert(k, rng.choice("xyz"))
            elif other:
                del other[k]
        pairs.append((base, other) if rng.random() < 0.5 else (other, base))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "doc_id int, a array<string>, b array<string>")
    got = {r.doc_id: (r.mismatched, r.compared) for r in diff_table(df, ["doc_id"]).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == walk_counts(a, b), (a, b)
    rows = diff_rows(df, ["doc_id"]).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.seq, r.kind, r.cost))
    for i, (a, b) in enumerate(pairs):
        exp = [(e["seq"], e["kind"], e["cost"]) for e in walk_events(a, b)]
        assert sorted(by_doc.get(i, [])) == exp


def test_context_and_rollup(spark):
    df = spark.createDataFrame([(1, list("abXdefg"), list("abYdefg")), (2, list("abc"), list("abc"))],
                               "doc_id int, a array<string>, b array<string>")
    r = diff_rows(df, ["doc_id"]).collect()
    assert len(r) == 1 and r[0].a_context == "a b X d e f g" and r[0].b_context == "a b Y d e f g"
    roll = mismatch_rollup(diff_table(df, ["doc_id"])).collect()[0]
    assert (roll.files, roll.mismatched, roll.compared) == (2, 1, 8)
    assert abs(roll.rate - 0.125) < 1e-9


def test_pair_tables_join(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "doc_id int, tokens array<string>")
    right = spark.createDataFrame([(1, ["a", "q", "c"]), (3, ["y"])], "doc_id int, tokens array<string>")
    out = diff_table(pair_tables(left, right, ["doc_id"]), ["doc_id"]).collect()
    assert [(r.doc_id, r.mismatched, r.compared) for r in out] == [(1, 1, 2)]


def test_many_mismatches_fill_several_lists(spark):
    a, b = ["x", "y"] * 700 + ["z"] * 3, ["x", "w"] * 700 + ["z"] * 3
    df = spark.createDataFrame([(1, a, b)], "k int, a array<string>, b array<string>")
    rows = diff_rows(df, ["k"]).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.cost) for r in rows] == [(e["seq"], e["kind"], e["cost"]) for e in walk_events(a, b)]
    assert len(rows) == 700


def test_diff_rows_runs_in_the_jvm(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"])], "k int, a array<string>, b array<string>")
    plan = diff_rows(df, ["k"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pair_tables_shuffles_texts(spark):
    """Lists of any tokens come back as they were, and no plain one is shuffled as an array."""
    from treecut.operators.compare import packed
    lists = [["a", "b"], [], [""], ["", ""], ["x\ny", "z"], ["a", None], [None], None, ["é", "\r"]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, tokens array<string>")
    rows = pair_tables(df, df, ["k"]).orderBy("k").collect()
    assert [(r.a, r.b) for r in rows] == [(x, x) for x in lists]
    kept = df.select("k", packed("tokens").alias("p")).where("p.list is not null").orderBy("k").collect()
    assert [r.k for r in kept] == [4, 5, 6]


def test_a_turn_copies_no_earlier_mismatches(spark):
    """J3 of a pair four times as long takes about four times as long."""
    import time
    n = 6_000
    lists = {k: (["x", "y", "z"] * k * n, ["x", "w", "z"] * k * n) for k in (1, 4)}
    times = {}
    for k, (a, b) in lists.items():
        df = spark.createDataFrame([(k, a, b)], "k int, a array<string>, b array<string>").cache()
        assert df.count() == 1
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            rows = diff_rows(df, ["k"]).groupBy("kind").count().collect()
            runs.append(time.perf_counter() - start)
        assert [(r.kind, r["count"]) for r in rows] == [("skip", k * n)]
        times[k] = min(runs)
    assert times[4] < 8 * max(times[1], 0.3)
