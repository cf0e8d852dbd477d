"""The n-gram model keeps rare words and n-grams in a large corpus."""

import numpy as np
import pytest
import test_lm
from pyspark.sql import functions as F
from treecut.llm import lm as L


@pytest.mark.parametrize("held_grams", [1_000_000, 50])
def test_rare_ngrams_count_in_a_large_corpus(spark, monkeypatch, held_grams):
    monkeypatch.setattr(L, "HELD_GRAMS", held_grams, raising=False)
    monkeypatch.setattr(L, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(L, "quantised", lambda values: (np.arange(len(values), dtype=np.uint32), values) if len(values) else (np.zeros(0, np.uint8), np.zeros(1)))
    rng = np.random.default_rng(4)
    # 1 / 2**14 of these tokens is more than 6.
    texts = [" ".join(rng.choice([f"common{i}" for i in range(40)], 1000)) for _ in range(120)]
    texts += ["alpha beta gamma delta"] * 3 + ["beta gamma epsilon"] * 2
    docs = [*enumerate(texts), (1001, "alpha beta gamma delta"), (1002, "delta beta gamma epsilon")]
    got = {r.doc_id: r.score for r in L.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") > 1000).collect()}
    model = test_lm.Brute(texts, 0, 0)
    for i in (120, 124, 1001, 1002):
        assert got[i] == pytest.approx(model.score(dict(docs)[i]), rel=1e-9)
