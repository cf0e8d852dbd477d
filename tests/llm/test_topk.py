"""Top-k search against all inner products in whole numbers."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from treecut.llm import topk as T


def brute(rows, k, is_query):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for (i, v), raw in zip(ok, [v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]):
        if is_query(i):
            queries[i] = min(queries.get(i, (raw, v)), (raw, v))
    out = []
    for i, (_, q) in queries.items():
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k, queries=T.QUERIES):
    d = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    return sorted(tuple(r) for r in T.top_k(d, F.col("vec_id") % 10 == 0, k).collect())


@pytest.mark.parametrize(("queries", "tile", "dimensions"), [(2048, 4096, 16), (5, 7, 3)])
def test_against_all_products(spark, monkeypatch, queries, tile, dimensions):
    for name, value in (("QUERIES", queries), ("TILE", tile), ("DIMENSIONS", dimensions)):
        monkeypatch.setattr(T, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 2 ** -(d % 5) for d in range(20)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0] * 19 + [None]), (402, [1.0] * 19 + [math.nan]), (403, [math.inf] * 20), (None, [9.0] * 20), (410, [1.0, 2.0]), (411, [3.0, 1.0]), (420, []), (421, []), (430, [1e17] * 20), (431, [-1e17] * 20), (5, rows[5][1]), (10, rows[11][1]), (440, [0.0] * 20)]
    rng.shuffle(rows)
    assert run(spark, rows, 10) == brute(rows, 10, lambda i: i % 10 == 0)


def test_few_and_no_rows(spark):
    rows = [(10, [1.0, 0.5]), (3, [0.2, -0.1]), (20, [0.0, 0.0])]
    assert run(spark, rows, 10) == brute(rows, 10, lambda i: i % 10 == 0)
    assert run(spark, [], 10) == []
    assert run(spark, [(1, [1.0])], 10) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in T.op1_exact_topk(spark, sf).collect()) == sorted(duckdb.sql(T.OP1_SQL).fetchall())
