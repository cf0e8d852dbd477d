"""What moves between the blocks and the shards of the n-gram model."""

import numpy as np
import test_lm
from pyspark.sql import functions as F
from treecut.llm import lm as L


def test_blocks_stay_and_code_books_go_once(spark, monkeypatch):
    tables = {}
    stored = L.stored
    monkeypatch.setattr(L, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(L, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    docs = spark.createDataFrame(test_lm.corpus(), "doc_id long, text string")
    scored = L.score_texts(docs, F.lit(False))
    blocks = tables["pairs"].where("block is not null").select("block").distinct().count()
    assert blocks > 20
    for name in ("pairs", "triples"):
        books = tables[name].where("book is not null").select("shard")
        assert books.count() == books.distinct().count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "FileScan" in line and "tokens" in line]
    assert moved and all("Bucketed: true" in line for line in moved)


def test_distinct_of_wide_numbers():
    code = np.random.default_rng(5).integers(0, 300, 2000)
    for most in (300, 1 << 62):
        first, which = L.distinct(code, most)
        own, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        assert (code[first] == own).all() and (first == at).all() and (which == inverse).all()


def test_planes_of_small_numbers_are_small():
    numbers = np.random.default_rng(6).integers(0, 1 << 20, 10_000)
    assert (L.opened(L.planes(numbers)) == numbers).all() and len(L.planes(numbers)) < 3 * len(numbers)
    assert len(L.opened(L.planes(numbers[:0]))) == 0
