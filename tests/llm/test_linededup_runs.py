"""Line deduplication: a repeated run of lines goes whole, whatever is around it."""

import random

import pytest
from treecut.llm import linededup as L


def brute(docs):
    """Every two neighbouring lines that occur before, and do not overlap that
    first occurrence, go."""
    first, cut = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        for a, pair in enumerate(zip(lines, lines[1:])):
            if first.setdefault(pair, (doc_id, text, a)) not in ((doc_id, text, a), (doc_id, text, a - 1)):
                cut.setdefault((doc_id, text), set()).update((a, a + 1))
    out = []
    for doc_id, text in docs:
        gone = cut.get((doc_id, text), ())
        lines = (text or "").split("\n")
        out.append((doc_id, len(lines) if text else 0, len(gone), text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def run(spark, docs):
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, _n int, lang string")
    return [(r.doc_id, r._n_lines, r._n_removed, r.text) for r in L.dedup_lines(d).collect()]


def own(rng, n):
    return [" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 20])
def test_planted_passages_go_whole(spark, n):
    rng, docs, want = random.Random(n), [], {}
    for i in range(0, 40, 2):
        passage, before, after = own(rng, n), own(rng, rng.randrange(1, 6)), own(rng, rng.randrange(1, 6))
        docs += [(i, "\n".join(own(rng, 3) + passage + own(rng, 2))), (i + 1, "\n".join(before + passage + after))]
        want |= {i: docs[-2][1], i + 1: "\n".join(before + after)}
    assert {i: text for i, _, _, text in run(spark, docs)} == want


def test_edge_cases(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(12))
    docs = [(1, passage), (2, "before\n" + passage + "\nafter"), (3, None), (4, ""), (5, "one line"), (6, "one line"), (7, passage), (7, passage), (None, passage),
            (8, "\n\n\n\n"), (9, "\n\n\n\n"), (10, "x\n" * 3000), (11, passage + "\n" + passage), (12, "é\nü\n" + passage.upper()),
            (13, "y\ny\ny"), (14, "own\ny\ny\ny"), (15, "a b\nc"), (16, "a\nb c"), (17, "line 3 of a passage\nalone")]
    got = run(spark, docs)
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
    assert {r[0]: r[3] for r in got}.items() >= {1: "", 2: "before\nafter", 13: "y\ny\ny", 14: "own", 17: docs[-1][1], None: passage}.items()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in L.op2_line_dedup(spark, sf).collect()) == sorted(brute(docs))


@pytest.mark.parametrize("divisor", [1, 2, 10**9])
def test_chunks_change_no_result(spark, monkeypatch, divisor):
    monkeypatch.setattr(L, "DIVISOR", divisor)
    rng, docs = random.Random(7), []
    passages = [[f"p{k} {i}" for i in range(rng.randrange(2, 25))] for k in range(6)]
    for i in range(40):
        lines = [x for _ in range(rng.randrange(1, 5)) for x in (own(rng, rng.randrange(0, 3)) + rng.choice(passages)[rng.randrange(0, 3) :])]
        docs.append((i, "\n".join(lines)))
    assert sorted(run(spark, docs)) == sorted(brute(docs))


def test_chunks_settle_most_of_a_repeated_passage(spark):
    rng = random.Random(8)
    passage = own(rng, 200)
    docs = [(i, "\n".join(own(rng, i) + passage + own(rng, 2))) for i in range(1, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lines = L._hashed(d, "text", "doc_id")
    settled = L._repeats(d, "text", "doc_id", L._chunks(lines), "chunks").collect()
    assert len(settled) == 7  # all but the first document, however they are shifted
    assert all(sum(c._len for c in r._cuts) > 150 and all(c._len > 1 for c in r._cuts) for r in settled)
    assert L._pairs(lines, L._repeats(d, "text", "doc_id", L._chunks(lines), "chunks")).count() < 0.6 * 8 * 205
