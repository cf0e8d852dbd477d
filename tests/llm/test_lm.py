"""The n-gram model against a dictionary version of the same formulas."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from treecut.llm import lm as L
from treecut.llm.eliasfano import EliasFano, mapped, pack


def tokens(text):
    return (text or "").encode().lower().split() + [None]


class Brute:
    def __init__(self, train, share_word, share_gram):
        docs = [tokens(t) for t in train]
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        once, twice = sum(x == 1 for x in self.c.values()), sum(x == 2 for x in self.c.values())
        self.d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        often = {w for w, x in self.c.items() if x >= max(1, self.n * share_word)}
        least = max(2, self.n * share_gram)
        grams = lambda k: {g: x for g, x in Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1)).items() if x >= least and often.issuperset(g)}
        self.often, self.c2, self.c3 = often, grams(2), grams(3)

    def p1(self, w):
        return (self.c[w] - self.d) / self.n if self.c[w] else self.d * self.v / self.n

    def p2(self, v, w):
        if (v, w) in self.c2:
            return (self.c2[v, w] - L.DISCOUNT) / self.c[v]
        if v not in self.often:
            return self.p1(w)
        kept = [g for g in self.c2 if g[0] == v]
        return (1 - sum(self.p2(*g) for g in kept)) / (1 - sum(self.p1(g[1]) for g in kept)) * self.p1(w)

    def p3(self, u, v, w):
        if (u, v, w) in self.c3:
            return (self.c3[u, v, w] - L.DISCOUNT) / self.c2[u, v]
        if (u, v) not in self.c2:
            return self.p2(v, w)
        kept = [g for g in self.c3 if g[:2] == (u, v)]
        return (1 - sum(self.p3(*g) for g in kept)) / (1 - sum(self.p2(*g[1:]) for g in kept)) * self.p2(v, w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p1(w) if i == 0 else self.p2(t[0], w) if i == 1 else self.p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))

    def base(self, text):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def corpus(n=120):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "Cat", "sat", "on", "a", "mat", "é", "x1"], p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05], size=rng.integers(1, 40))) + (" the cat sat down" if i % 3 else f" rare{i}") for i in range(n)]
    return [*enumerate(texts), (500, None), (501, ""), (502, "unseen words only"), (None, "the cat"), (3, texts[3])]


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_TOKENS", block)
    exact = lambda values: ((np.arange(len(values))).astype(np.uint32), values) if len(values) else (np.zeros(0, np.uint8), np.zeros(1))
    monkeypatch.setattr(L, "quantised", exact)
    docs = corpus()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    got = L.score_texts(d, F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))).collect()
    held = lambda i: i is not None and i % 5 == 2
    model = Brute([t for i, t in docs if not held(i)], L.WORD_SHARE, L.NGRAM_SHARE)
    want = sorted((str(i), held(i), len(tokens(t)), sum(model.c[w] > 0 for w in tokens(t)), model.n, model.base(t), model.score(t)) for i, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_at_most_one(spark):
    train = [t for _, t in corpus()]
    model = Brute(train, L.WORD_SHARE, L.NGRAM_SHARE)
    vocabulary = sorted(model.c, key=lambda w: (w is not None, w)) + [b"never"]
    for u, v in itertools.product([b"the", b"cat", b"on", b"rare0"], repeat=2):
        assert sum(model.p3(u, v, w) for w in vocabulary) == pytest.approx(1)
    code, book = L.quantised(np.log10(np.random.default_rng(1).random(5000)))
    assert code.dtype == np.uint8 and len(book) <= 256


def test_quantising_rounds_down():
    values = np.random.default_rng(1).normal(size=3000)
    code, book = L.quantised(values)
    assert (book[code] <= values).all() and np.abs(book[code] - values).mean() < 0.05


def test_empty_and_untrained(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.score_texts(d.where("false"), F.lit(False)).count() == 0
    (row,) = L.score_texts(d, F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Brute([t for i, t in docs.items() if not held(i)], 2, 2)
    rows = L.op7_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id) and r.train_tokens == model.n and r.base_score == pytest.approx(model.base(docs[r.doc_id]))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10), (1000, 10**9), (777, 64), (5000, 2**40)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = EliasFano.from_parts(*mapped(*pack(EliasFano.encode(values).parts())))
        assert (ef.get(np.arange(n)) == values).all()
        target = np.concatenate((values, values + 1, rng.integers(0, top + 2, 300)))
        assert (ef.successor(target) == np.searchsorted(values, target)).all()
