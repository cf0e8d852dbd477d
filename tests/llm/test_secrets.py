"""Secret scanning: places, features, held-out accuracy, edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from treecut.llm import secrets as S


def test_query_finds_held_out_secrets(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op3_secret_scan(spark, sf).collect()
    want = {(i, m.start(), m.end(), hashlib.sha256(m.group().encode()).hexdigest()) for i, t in docs.items() for m in S.CANDIDATE.finditer(t)}
    assert {(r.doc_id, r.start, r.end, r.sha256) for r in rows} == want and len(rows) == len(want)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.is_secret == bool(r.assigned) for r in held]) > 0.95
    assert any(r.assigned for r in held) and any(not r.assigned for r in held)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, probability int, features string")


def test_edge_cases(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(i, f'the word token = "{key[i:]}{key[:i]}" and more', "src1", 1, "x") for i in range(20)] + [(100 + i, "a verylongordinaryword" + "abcdefghij"[i % 10] * 3 + " follows", None, 1, "x") for i in range(20)]
    rows += [(200, None, "p", 1, "x"), (201, "", "p", 1, "x"), (None, f"x {key}", "p", 1, "x"), (1, rows[1][1], "src1", 1, "x"), (202, "a" * 100_000, "p", 1, "x")]
    found = S.findings(frame(spark, rows))
    judged = S.classify(found, F.lit(True)).collect()
    assert len(judged) == 20 + 20 + 1 + 1 + 1
    assert all(r.is_secret == bool(r.label) for r in judged if r.doc_id is not None and r.doc_id < 200)
    one_class = S.classify(found.where("label = 1"), F.lit(True)).collect()
    assert {r.probability for r in one_class} == {1.0}
    assert {r.probability for r in S.classify(found, F.lit(False)).collect()} == {0.0}
    assert S.classify(S.findings(frame(spark, [])), F.lit(True)).count() == 0


def test_features():
    flat = np.log(np.full((128, 128), 1 / 128))
    length, mean, rare, digits, upper, distinct, changes, covered = S.described("theandthe1234ABCD", flat, frozenset({"the", "and"}))
    assert (length, digits, upper, covered) == (17, 4 / 17, 4 / 17, 9 / 17)
    assert mean == pytest.approx(rare) == pytest.approx(-np.log(128)) and changes == 2 / 16 and distinct == len(set("theandthe1234ABCD")) / 17


@pytest.mark.parametrize(("text", "label"), [('api_key: "', 1), ("password=", 1), ("Tokens => '", 1), ("token ", 0), ("the words ", 0)])
def test_rule(text, label):
    assert bool(S.ASSIGNED.search(text)) == bool(label)
