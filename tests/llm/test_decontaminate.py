"""Decontamination against a word-by-word reading of the contract."""

import hashlib
import re

import pytest
from treecut.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (found := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    items |= found
        names = sorted(str(x) for x in items if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [(1, LONG + " tail"), (2, "Short Phrase! here"), (3, None), (4, ""), (5, "..."), (1, LONG + " tail"), (None, "x short phrase"),
        (7, " ".join(["a b"] * 40)), (8, "w5 w6 w7"), (9, ("filler " * 400) + LONG), (10, "Éa w0 " + LONG.upper())]
BENCH = [(10, LONG), (2, "short phrase"), (3, None), (4, "!!"), (5, "a b a b a b a b a b a b a b a"), (None, "w29 tail"), (10, "tail"), (11, "short phrase")]


def report(spark, docs, bench):
    d = spark.createDataFrame([(i, t, "extra", 0) for i, t in docs], "doc_id long, text string, spans string, n_hit int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return d, b


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_edge_cases(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    d, b = report(spark, DOCS, BENCH)
    got = [tuple(r) for r in D.contamination(D.occurrences(d, b)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == sorted(brute(DOCS, BENCH), key=str)


def test_empty_tables(spark):
    d, b = report(spark, DOCS, [])
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(D.occurrences(d, b)).collect())
    d, b = report(spark, [], BENCH)
    assert D.contamination(D.occurrences(d, b)).count() == 0


def test_small_blocks_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 16)
    d, b = report(spark, [(1, "alpha x beta y gamma"), (2, "gamma alpha"), (3, "beta"), (4, "alpha beta")], [(1, "alpha beta gamma")])
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in D.occurrences(d, b, within=4).collect()}
    assert found == {1: [(0, 1)], 2: [], 3: [], 4: []}
    assert not any(r.spans for r in D.occurrences(d, b, within=1).collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in D.op8_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(brute(docs, bench))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
