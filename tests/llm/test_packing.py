"""Packing: ids as the tokenizer's, pieces and places by the contract, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from treecut.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, docs, tokenizer, capacity=2048):
    """Rows (doc_id, piece, start, length, crc, sequence, offset) against texts."""
    want = Counter()
    for doc_id, text in docs:
        own = ids(tokenizer, text)
        cuts = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)] if len(own) > capacity else [0, len(own)]
        want.update((doc_id, i, a, b - a, zlib.crc32(own[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(r[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_encoder_equals_the_tokenizer(tokenizer):
    encode = P.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    bits = ["word", "Word", "don't", "I'LL", " ", "  ", "\n", "\n\n", "\t", "\r\n", "12", "3.14", "é", "日本", "🙂", "...", "--", "<|endoftext|>", " ", " ", "\x1c", "\x85", "\0", "ß&&&", "_", "'"]
    texts = ["", " ", "\n", "a\n b", "a \nb", "one two\nthree", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext| >", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500))]
    for text in texts:
        assert encode(text) == ids(tokenizer, text)[:-1].tobytes(), repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = [10, 64, 2048, 2048, 7, 100][seed]
    lengths = rng.integers(1, capacity + 1, [50, 500, 4000, 20, 300, 3000][seed]) if seed % 2 else np.minimum(capacity, 1 + rng.geometric(5 / capacity, [50, 500, 4000, 20, 300, 3000][seed]))
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins = defaultdict(list)
    places = P.plan(counts, capacity)
    for length in np.flatnonzero(counts):
        own = places[places[:, 0] == length]
        for nth in range(counts[length]):
            _, first, per, sequence, offset = own[np.searchsorted(own[:, 1], nth, side="right") - 1]
            bin_, slot = divmod(nth - first, per)
            bins[sequence + bin_].append((offset + slot * length, length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= capacity
    best_fit = []
    for n in sorted(lengths.tolist(), reverse=True):
        room = min((r for r in best_fit if r >= n), default=None)
        if room is None:
            best_fit.append(capacity - n)
        else:
            best_fit[best_fit.index(room)] = room - n
    assert len(bins) <= len(best_fit)


def test_exact_complements_first():
    counts = np.zeros(101, dtype=int)
    counts[[90, 10, 60, 30, 25, 15]] = [3, 3, 2, 2, 2, 2]
    rows, sequences = P.filled(counts, 100, 3)
    # Three times 90 + 10, then 60 + 25 + 15 twice; 30 + 30 is best fit.
    assert sequences == 6
    assert [r for r in rows.tolist() if r[0] in (90, 60)] == [[60, 0, 1, 3, 0], [90, 0, 1, 0, 0]]


def test_rows(spark, tokenizer):
    docs = [(1, None), (2, ""), (4, "a <|endoftext|> b"), (3, "a few words"), (3, "a few words"), (None, "no id"), (5, "long " * 6000), (6, "x" * 20000), (7, " ".join(f"w{i}" for i in range(2047))), (8, "tail  \n\n  x")]
    for n in range(60):
        docs.append((100 + n, "some words here " * (n * 9 % 170)))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, length int, part int").repartition(5)
    rows = [tuple(r) for r in P.pack(d).collect()]
    n = check(rows, docs, tokenizer)
    assert n <= 1 + sum(r[3] for r in rows) / 2048 * 1.05
    assert P.pack(d.limit(0)).count() == 0


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [tuple(r) for r in P.op6_best_fit_packing(spark, sf).collect()]
    assert check(rows, docs, tokenizer) <= 1 + sum(r[3] for r in rows) / 2048 * 1.02


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "date"])
def test_key_types_and_clashing_columns(spark, tokenizer, kind):
    names = ["_text", "part", "nth", "_nth", "length", "before", "sequence_id", "piece"]
    d = spark.createDataFrame([(1, "one two"), (2, "three " * 3000), (None, None)], "n int, text string")
    key = "date_add(date'2020-01-01', n)" if kind == "date" else f"cast(n as {kind})"
    d = d.selectExpr(f"{key} as doc_id", "text", *(f"'x' as `{n}`" for n in names))
    docs = [(r.doc_id, r.text) for r in d.collect()]
    packed = P.pack(d)
    assert dict(packed.dtypes)["doc_id"] == kind
    check([tuple(r) for r in packed.collect()], docs, tokenizer)
