"""Counts against the tokenizer itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers
from treecut.llm import tokencount as C


def tokenizer(pieces):
    t = Tokenizer(models.Unigram(pieces, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def pieces():
    return C.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "x▁y", "Hello, World!\nNext line\t\ttab", "é ü ß 日本語 🙂🙂", "<s> </s> <unk> <0x0A>", "aaaa" * 50, "\r\n\x0b", "ciónñez&&& de%%%", "a" * 5000, "\x00\x7f", "🙂" * 20]


def test_special_texts(pieces):
    counter, t = C.Counter(pieces), tokenizer(pieces)
    for text in TEXTS:
        assert counter.text(text)[1] == len(t.encode(text).ids), text


def test_ties_as_in_the_tokenizer():
    rng = random.Random(4)
    letters = "abc▁"
    for _ in range(60):
        names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 14))}
        pieces = [("<unk>", 0.0), *((p, -float(rng.randrange(1, 4))) for p in sorted(names)), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
        counter, t = C.Counter(pieces), tokenizer(pieces)
        for _ in range(20):
            text = "".join(rng.choice("abcd ▁é") for _ in range(rng.randrange(14)))
            assert counter.text(text)[1] == len(t.encode(text).ids), (pieces, text)


def test_rows(spark):
    d = spark.createDataFrame([(1, "a b", 9), (None, None, 9), (2, "", 9), (1, "a b", 9), (3, "x " * 20000, 9)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_words, r.n_tokens > 0) for r in C.count_tokens(d).collect()}
    assert got == {(1, 2, True), (None, 0, False), (2, 0, False), (3, 20001, True)}
    assert C.count_tokens(d).count() == 5 and C.count_tokens(d.limit(0)).count() == 0


def test_query_equals_the_tokenizer(spark, pieces):
    sf, t = "/root/testdata/sf0.001", tokenizer(pieces)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = C.op9_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode(x).ids) for i, x in docs.items()}
