"""Spelling variants: brute force over all pairs, neighbourhoods, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from treecut.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def answers(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def count_words(rows, every=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_random_words_equal_brute_force(spark):
    rng = random.Random(3)
    words = set()
    for _ in range(120):
        w = "".join(rng.choice("abcdéÿ÷z") for _ in range(rng.randint(5, 9)))
        words.add(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdéÿ") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]])
            words.add(w)
    counts = {w: rng.choice([3, 4, 6, 12, 12, 50]) for w in words if w}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute(counts)
    assert sum(x[0] is not None for x in expected.values()) > 30
    for symbols in (2, S.SYMBOLS):
        assert answers(S.spelling_variants(df, symbols)) == expected


def test_neighbourhood_holds_every_one_edit_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 4, size=(50, 7))
    of = {}
    for codes in (base, np.delete(base, 3, axis=1), np.where(np.arange(7) == 2, (base + 1) % 4, base)):
        rows, keys = S.neighbourhood(codes, 4)
        for i, own in enumerate(S.hashes(codes)):
            of.setdefault(tuple(codes[i]), (own, set(keys[rows == i].tolist())))
    texts = {c: "".join(map(str, c)) for c in of}
    for a in of:
        for b in of:
            linked = of[b][0] in of[a][1] or of[a][0] in of[b][1]
            assert linked == (a == b or one_edit(texts[a], texts[b]))


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["Colour", "color", "colours", "GRÜßE", "grüße", "Grüsse", "naïve", "naive", "ab", "abcd", "x×y÷zw"]
    rows = [(i, " ".join(rng.choice(names) + rng.choice(["", "s", "!"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "colour colour colouur colouur colouur"), (7, None), (8, ""), (9, "12 -- ½"), (0, rows[0][1]), (10, "q" * 70_000 + " " + "q" * 70_000), (11, "q" * 70_000 + " " + "q" * 69_999)]
    df = spark.createDataFrame([(k, t, "m", "n", 1) for k, t in rows], "doc_id long, text string, word string, key string, n int")
    counts = count_words(rows)
    assert "q" * 70_000 in counts and any(len(w) < 5 for k, t in rows for w in (t or "").split())
    assert answers(S.spelling_variants(S.word_counts(df, every=97))) == brute(counts)
    by_name = df.selectExpr("cast(doc_id as string) doc_id", "text")
    assert answers(S.spelling_variants(S.word_counts(by_name, every=97))) == brute(counts)


def test_chain_of_forms_and_ties(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(9)} | {"cccccc": 3, "cccccd": 9, "cccccb": 9}
    got = answers(S.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute(chain)
    assert got["aaaaa"][1] == "aaaaa" + "b" * 8 and got["cccccc"][0] == "cccccb"


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(S.word_counts(none)).collect() == []
