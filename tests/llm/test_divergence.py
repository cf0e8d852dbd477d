"""Source divergence: the transducer, brute force over small tables, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from treecut.llm import divergence as D
from treecut.llm import transducer as T


def test_transducer_numbers_keys_in_order():
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 7))).encode() for _ in range(900)})
    made = T.loads(T.build(keys).dumps())
    assert made.n == len(keys) and made.ordinals(keys).tolist() == list(range(len(keys)))
    others = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9))).encode() for _ in range(900)]
    where = {k: i for i, k in enumerate(keys)}
    assert made.ordinals(others).tolist() == [where.get(k, -1) for k in others]


def test_transducer_is_minimal():
    keys = sorted(f"{a}{b}ing".encode() for a in "abcd" for b in "xyz")
    made = T.build(keys)
    right = defaultdict(set)
    for k in keys:
        for i in range(len(k) + 1):
            right[k[:i]].add(k[i:])
    assert made.states == len({frozenset(x) for x in right.values()})


def test_transducer_borders():
    assert T.build([]).ordinals([b"a", b""]).tolist() == [-1, -1]
    assert T.build([b""]).ordinals([b"a", b""]).tolist() == [-1, 0]
    long = [b"q" * 5000, b"q" * 5001]
    assert T.build(long).ordinals([*long, b"q" * 4999]).tolist() == [0, 1, -1]
    with pytest.raises(ValueError):
        T.build([b"b", b"a"])


def brute(rows, least, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, _, terms in docs:
        seen[lang].update(set(terms))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=lambda t: t.encode()) for lang, c in seen.items()}
    for lang, source, terms in docs:
        groups[lang].add(source)
        counts[lang, source].update(t for t in terms if t in set(kept.get(lang, [])))
    out = set()
    for lang, sources in groups.items():
        own = kept.get(lang, [])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(own)) for t in own}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in own), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in own if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])}
    return out


def answers(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["The", "the", "naïve", "GRÜN", "grün", "a", "b", "c", "zz", "日本", "don", "x1y", "_q_"]
    rows = [(" ".join(rng.choice(words[rng.randint(0, 5) :]) for _ in range(rng.randint(0, 15))), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", "S", None, ""])) for _ in range(n)]
    rows += [(None, "en", "s1"), ("", "fr", "only"), ("once", "fr", "other"), ("q" * 100_000, "en", "s2"), ("q" * 100_000 + " b", "en", "s2")]
    rows += [("the the the b", "en\0b", "s1"), ("the", "en\0b", "s2"), ("the", "en\0b", "s2")]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20}, {"shard_bytes": 20, "pass_bytes": 3000, "terms": 3, "sources": 2}])
def test_equals_brute_force(spark, options):
    rows = corpus(4)
    df = spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in rows], "text string, lang string, source string, ordinal int, term string")
    assert answers(D.divergence(df, least=2, top=3, **options)) == brute(rows, 2, 3)


def test_several_passes_are_needed(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = D.kept_terms(D._plain(df, "text", "lang", "source"), 2)
    assert len(D.Vocabulary(kept, 20, 3000).passes) > 1


def test_empty_and_without_terms(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert answers(D.divergence(none)) == set()
    few = [("a", "en", "x"), ("b", "en", "y"), (None, None, None)]
    assert answers(D.divergence(spark.createDataFrame(few, "text string, lang string, source string"))) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_blocks_of_terms_name_a_pair_the_same_way(spark):
    """Two blocks of terms meet the rows of two sources in opposite order (F1)."""
    schema = "lang string, source string, ordinal long, share long, terms long, own int, x int, y int, block long"
    rows = []
    for block, order in ((0, "ab"), (1, "ba")):
        for source in order:
            rows.append(("en", source, -1, 5, 1, 0, 0, 0, block))
            rows.append(("en", source, block, 10 if source == "a" else 30, 0, 0, 0, 0, block))
    got = D._pair_sums(spark.createDataFrame(rows, schema).coalesce(1)).groupBy("a", "b").sum("value").collect()
    assert [tuple(r) for r in got] == [("a", "b", 40)]
