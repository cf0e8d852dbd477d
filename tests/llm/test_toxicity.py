"""Toxicity: the field against enumeration, held-out accuracy, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from treecut.llm import toxicity as X


def enumerated(emission, chain):
    """Marginals of the toxic tag and the log partition, over all taggings."""
    n, total, toxic = len(emission), 0.0, np.zeros(len(emission))
    for tags in itertools.product((0, 1), repeat=n):
        score = sum(e for e, y in zip(emission, tags) if y) + sum(chain[a][b] for a, b in zip(tags, tags[1:]))
        total += np.exp(score)
        toxic += np.exp(score) * np.array(tags)
    return toxic / total, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emission, length, chain = rng.normal(size=(6, 5)), np.array([5, 4, 3, 2, 1, 5]), rng.normal(size=(2, 2))
    marginal, joint, partition = X.forward_backward(emission, length, chain)
    logs = 0.0
    for i, n in enumerate(length):
        expected, log = enumerated(emission[i, :n], chain)
        assert np.allclose(marginal[i, :n], expected) and not marginal[i, n:].any()
        logs += log
    assert np.isclose(partition, logs) and np.isclose(joint.sum(), (length - 1).sum())


def test_slope_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    emission, length, chain = rng.normal(size=(3, 4)), np.array([4, 3, 2]), rng.normal(size=(2, 2))
    marginal, joint, base = X.forward_backward(emission, length, chain)
    for i, t in ((0, 0), (1, 2), (2, 1)):
        moved = emission.copy()
        moved[i, t] += 1e-6
        assert np.isclose((X.forward_backward(moved, length, chain)[2] - base) / 1e-6, marginal[i, t], atol=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        moved = chain.copy()
        moved[a, b] += 1e-6
        assert np.isclose((X.forward_backward(emission, length, moved)[2] - base) / 1e-6, joint[a, b], atol=1e-4)


def test_document_marginals_equal_enumeration():
    """Runs of tokens without features count as the tokens they are."""
    rng = random.Random(2)
    for _ in range(60):
        chain = np.array([[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        model = X.Model({}, rng.uniform(-3, 1), chain)
        said = [rng.uniform(-2, 4) if rng.random() < 0.25 else None for _ in range(rng.randint(1, 13))]
        expected, _ = enumerated([model.bias + (e or 0.0) for e in said], chain)
        got = model.marginals(said)
        assert {i for i, e in enumerate(said) if e is not None} <= {i for i, _ in got}
        for i, p in got:
            assert np.isclose(p, expected[i]), (said, got, expected)


def rated(rows, labels):
    said = [r for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in said)
    return hit / max(1, sum(labels[r.doc_id] for r in said)), hit / max(1, sum(r.predicted for r in said)), len(said)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = X.op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    recall, precision, n = rated(rows, labels)
    assert n > 1000 and recall > 0.8 and precision > 0.95, (recall, precision)


def made_up(seed=3, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 40))]
        toxic = int(i % 4 == 0)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Zounds", "zoundslike", "varlet", "VARLETS"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_spans_and_edge_cases(spark):
    docs, labels = made_up()
    schema = "doc_id long, text string, score string, spans string, _text string, _label int"
    full = [(i, t, "s", "p", "x", 0) for i, t in docs]
    given = spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = X.learn(spark.createDataFrame(full, schema), given)
    odd = [(1000, None, "", "", "", 1), (1001, "", "", "", "", 1), (1002, "ab ZOUNDSMAN varlet cd", "", "", "", 1), (1002, "ab ZOUNDSMAN varlet cd", "", "", "", 1), (None, "ab cd", "", "", "", 1), (1003, "ab cd " * 30_000, "", "", "", 1), (1004, "İİ zounds, varlet!", "", "", "", 1)]
    rows = X.score_toxicity(spark.createDataFrame(odd, schema), model, keys=("doc_id", "score")).toDF("doc_id", "own", "score", "spans").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd) and by[1000].score == by[1001].score < 0.3 and by[1003].score < 0.3 and by[None].score < 0.3
    text = odd[2][1]
    assert by[1002].score > 0.7 and [text[s.start : s.end] for s in by[1002].spans] == ["ZOUNDSMAN varlet"]
    assert odd[6][1][by[1004].spans[0].start : by[1004].spans[0].end] == "zounds, varlet"
    assert X.score_toxicity(spark.createDataFrame([], schema), model).collect() == []


@pytest.mark.parametrize(("labels", "expected"), [([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0), ([(1, 0), (1, 1)], 0.0)])
def test_one_label_or_none(spark, labels, expected):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = X.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in X.score_toxicity(docs, model).collect()] == [expected, expected]


def test_a_bounded_sample_learns_the_same(spark):
    docs, labels = made_up(4, 600)
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = X.score_toxicity(d, X.learn(d, g, size=100, windows=150)).collect()
    wrong = sum((r.score >= 0.5) != dict(labels)[r.doc_id] for r in rows)
    assert wrong < 30
