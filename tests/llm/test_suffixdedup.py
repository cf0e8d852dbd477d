"""Removal of repeated strings against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import pytest
from treecut.llm import suffixdedup as S


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet="abcdefgh \n"):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(rng.randrange(10, 90)) for _ in range(12)]
    docs = [(i, "".join(rng.choice([make(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[: rng.randrange(1, 60)]]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    base = make(300)
    docs += [(100 + i, base[: rng.randrange(300)] + "#" + base[rng.randrange(300) :]) for i in range(12)]
    docs += [(200, docs[3][1]), (200, docs[3][1]), (201, docs[5][1]), (202, None), (203, ""), (204, "short"), (None, base), (205, "a" * 150), (206, "ab" * 90), (207, "a\0" * 30 + "\0" * 40), (208, "\0" * 60), (209, "é" * 45)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("length", "gram", "block", "part", "hot"), [(20, 10, 1 << 25, 1 << 20, 4096), (24, 8, 700, 64, 4096), (24, 16, 500, 1 << 20, 2), (40, 20, 3000, 100, 1)])
def test_small(spark, monkeypatch, length, gram, block, part, hot):
    for name, value in (("BLOCK_BYTES", block), ("PART", part), ("HOT", hot)):
        monkeypatch.setattr(S, name, value)
    docs = corpus(length + hot)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, n_bytes int").repartition(3)
    rows = S.remove_repeats(d, length=length, gram=gram).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    want = brute(docs, length)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want) and any(w[1] > w[2] > 0 for w in want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in S.op10_suffix_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(brute(docs, 200))


def test_loser_tree_gives_order_and_common_prefixes():
    import numpy as np

    rng = random.Random(1)
    runs, every = [], []
    for i in range(7):
        own = sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(0, 40))})
        rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 12)
        shared = S._shared(rows) if len(own) else np.zeros(0, int)
        runs.append(S.Run(i, shared.astype("<u2").tobytes(), b"".join(x[c:] for x, c in zip(own, shared)), 12))
        every += [(x, i) for x in own]
    got = list(S.merged(runs))
    assert [(s, n) for n, s, _ in got] == sorted(every)
    common = lambda a, b: next((i for i in range(12) if a[i] != b[i]), 12)
    assert [c for _, _, c in got[1:]] == [common(a[1], b[1]) for a, b in zip(got, got[1:])]
