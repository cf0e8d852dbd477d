"""Language identification: held-out accuracy, codewords, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from treecut.llm import langid as G


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = G.op5_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and set(r.lang_pred for r in rows) <= set(lang.values()) | {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 11])
def test_codewords(k):
    code = G.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
    if k > 1:
        assert all((code[i] != code[j]).sum() >= 1 for i in range(k) for j in range(i))
        assert all(len(set(column)) == 2 for column in code.T)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog with this and that", "en", "x") for i in range(5)] + [(10 + i, "der hund und die katze mit dem und das", "de", "x") for i in range(5)]
    rows += [(20, None, "en", "x"), (21, "", "de", "x"), (22, "123 ... !!", "fr", "x"), (23, "ŋ", None, "x"), (None, "the cat", None, "x"), (24, "the " * 50000, None, "x"), (1, "the cat and the dog with this and that", "en", "x")]
    d = frame(spark, rows)
    model = G.learn(d)
    assert model.languages == ["de", "en"]  # no text of fr has a letter
    got = G.identify(d, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i].lang_pred for i in (0, 10, 20, 21, 22, 24, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert by_id[20].score == 0 and by_id[23].ambiguous
    kept = G.identify(d, model, keys=("text", "doc_id", "score"))
    assert kept.columns == ["text", "doc_id", "score", "lang_pred", "score", "ambiguous"] and kept.count() == len(rows)


def test_one_language_and_none(spark):
    d = frame(spark, [(1, "alpha", "xx", "s"), (2, "beta", None, "s")])
    assert {r.lang_pred for r in G.identify(d, G.learn(d)).collect()} == {"xx"}
    nothing = G.learn(d.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in G.identify(d, nothing).collect()} == {("und", 0.0)}
    assert G.identify(d.limit(0), G.learn(d.limit(0))).count() == 0


def test_fold(spark):
    d = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long").select("i", G.fold(F.col("i"), 3).alias("f"))
    assert all(r.f == (zlib.crc32(str(r.i).encode()) % 3 if r.i is not None else -1) for r in d.collect())
