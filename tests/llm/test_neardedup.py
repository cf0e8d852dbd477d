"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from treecut.llm import neardedup as N


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def brute(docs, size=2):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least.get(find(i)), None if d is None else d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def run(spark, docs, **kw):
    d = spark.createDataFrame([(i, t, True, "x") for i, t in docs], "doc_id long, text string, kept boolean, bands string")
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept if r.doc_id is not None else None) for r in N.near_duplicates(d, **kw).collect()]


def family(rng, n, base_words=60, edits=6):
    base = [f"w{rng.randrange(500)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("chunk", [512, 7])
def test_families_and_edge_cases(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [None, "", "  \n", "one", "ONE", "one two", "a b c d e", "a b c d e f", "é É", "É é", "x " * 5000, "x " * 700]
    for n in (40, 12, 5, 3, 3, 3):
        texts += family(rng, n)
    texts += [" ".join(f"u{rng.randrange(10**5)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    docs = list(enumerate(texts, 100))
    docs += [(120, texts[20]), (500, texts[20]), (None, texts[21]), (None, "nowhere else"), (7, texts[60])]
    rng.shuffle(docs)
    # An id that repeats with one text is one document.
    assert sorted(run(spark, docs, size=2), key=str) == sorted(brute(docs), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in N.op4_minhash_near_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(brute(docs))


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    for n, share in ((3000, 0.8), (3000, 0.0), (100, 0.5)):
        both = rng.integers(0, 1 << 64, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, n - len(both), dtype=np.uint64)))) for _ in range(2))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = N.estimate(N.registers(a), n, np.array([N.registers(b)]), np.array([n]))[0]
        assert abs(found - real) < 5 * np.sqrt(0.25 / min(n, 256))


@pytest.mark.parametrize("links", [[], [(5, 5)], [(i, i + 1) for i in range(200)], [(i + 1, i) for i in range(0, 200, 2)], [(0, i) for i in range(1, 300)],
                                   [(i * 37 % 211, (i * 53 + 7) % 211) for i in range(150)], [(-(1 << 62), 1 << 62), (1 << 62, 3), (9, 8), (8, 9), (9, 8)]])
def test_components(spark, links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_a_large_group_is_not_sent_chunk_by_chunk(spark, monkeypatch):
    """Of a bucket that is one component but for a few, only these few go to all chunks."""
    monkeypatch.setattr(N, "CHUNK", 16)
    rng, sent, compare = random.Random(5), [], N.compare

    def counted(groups, *args):
        sent.append(groups.count())
        return compare(groups, *args)

    monkeypatch.setattr(N, "compare", counted)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for edits in [1] * 240 + [9] * 12:
        copy = list(base)
        for at in rng.sample(range(60), edits):
            copy[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    assert sorted(run(spark, docs, size=2)) == sorted(brute(docs))
    # Twice in each of the 42 bands at most; 25,879 rows when every two chunks met.
    assert sum(sent) < 2 * 42 * len(docs), sent
