"""Operator 5, language identification by error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier per bit learns
from character n-gram counts that Spark adds up over all labelled rows; a text
is decoded to the codeword with the smallest weighted logistic loss, and a text
whose best two codewords are close is flagged as ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null label are never learned from; an empty training set predicts
``und`` everywhere; repeated rows are learned from and answered each on their
own; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, once_per_worker, scan

#: Buckets of the hashed n-grams; the model has languages x buckets counts.
BUCKETS = 1 << 13
#: Letters of evidence beyond which a text counts as long.
EVIDENCE = 60.0
#: Gap between the best two scores below which a text is ambiguous.
AMBIGUOUS_GAP = 0.2

UND = "und"


def letters() -> np.ndarray:
    """Whether a code point is a letter (Unicode categories L*)."""
    size = sys.maxunicode + 1
    return once_per_worker("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(size)), dtype=bool, count=size))


def ngrams(text: str | None) -> np.ndarray | None:
    """Hashed 2- and 3-grams of the lower-cased letters, each run of other
    characters as one blank; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.where(is_letter, code, 0)[keep]
    code = np.concatenate(([np.uint32(0)], code, [np.uint32(0)])).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate((two, three))
    both ^= both >> np.uint32(16)
    return (both * np.uint32(0x7FEB352D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codewords(k: int) -> np.ndarray:
    """A +1/-1 codeword for each of ``k`` classes: all two-way splits for up to
    five classes, else the best of seeded random codes by smallest distance."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.int8)
    if k <= 5:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(k)] for split in range(1, 1 << (k - 1))]
        return np.array(bits, dtype=np.int8).reshape(-1, k).T
    n_bits, draw, best, best_gap = 10 * int(np.ceil(np.log2(k))), np.random.default_rng(k), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], dtype=np.int8), size=(k, n_bits))
        code[0, (code == code[0]).all(axis=0)] *= -1
        gap = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class Model:
    """``weights`` has a column of log odds per bit, ``trust`` a weight per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, grams: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity of one text's n-grams."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = np.bincount(grams, minlength=BUCKETS)
        margin = counts @ self.weights / len(grams) * min(len(grams), EVIDENCE)
        loss = np.logaddexp(0.0, -self.code * margin) @ self.trust
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        first, second = np.argsort(-odds, kind="stable")[:2]
        return self.languages[first], float(odds[first]), bool(odds[first] - odds[second] < AMBIGUOUS_GAP)


def learn(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fit on every row of ``docs`` with a label.  Each task adds its n-grams up
    per language; Spark sums the (language, bucket) counts; the driver gets
    languages x BUCKETS numbers, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, body in scan(batches, "lang", "text"):
            grams = ngrams(body)
            if grams is not None:
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang] += np.bincount(grams, minlength=BUCKETS)
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], schema=schema)

    labelled = docs.select(F.col(label).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    at = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[at[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        weights[:, bit] = np.log(share[code[:, bit] > 0].mean(axis=0)) - np.log(share[code[:, bit] < 0].mean(axis=0))
    # A bit is trusted as far as its worst language lies on the right side.
    trust = np.maximum((share @ weights * code).min(axis=0), 1e-6) if languages else np.zeros(0)
    return Model(languages, code, weights, trust / trust.max() if len(trust) else trust)


def identify(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``lang_pred``, ``score`` and ``ambiguous`` for every row; the
    text may be one of the keys."""
    source = docs.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate([*keys, *[text][text in keys :]])))
    own = source.columns[: len(keys)]
    body_at = f"_{keys.index(text) if text in keys else len(keys)}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*own).schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (body,) in scan([batch], body_at):
                grams = ngrams(body) if model.languages else None
                found.append((UND, 0.0, True) if grams is None else model.decode(grams))
            lang, score, ambiguous = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=[*own, "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(predict, f"{fields}, lang_pred string, score double, ambiguous boolean").toDF(*keys, "lang_pred", "score", "ambiguous")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (-1 for a null id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(-1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = learn(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
