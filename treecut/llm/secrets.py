"""Operator 3, secret scanning with a random forest against false positives.

A pattern finds candidates: long runs of the characters that keys are made of.
Each is described by its length, how usual its character transitions are in this
corpus, its mix of characters, how much of it frequent words cover, and how often
its path and its neighbouring words came with a secret among labelled findings.
A random forest trained on labelled findings then tells secrets from the rest.

What the corpus says (transitions, frequent words, path and word priors) is
counted by Spark over all rows; the forest is fitted on at most ``SAMPLE``
labelled findings, the smallest by hash.  Findings come with labels of their own
or, as in the query, with one by rule: whether a name such as ``token`` or
``password`` is assigned the candidate.

Defined cases: null and empty texts have no findings; a null path is a path of
its own; a null key is carried along; repeated rows give their findings each;
labels of one class only make that class certain, and without labels every
probability is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, growing, load, scan, stored, utf8
from .langid import fold

#: Labelled findings that the forest is fitted on.
SAMPLE = 20_000
#: Words of the dictionary have at least this share of the corpus's words.
WORD_SHARE = 2.0**-14
SEED = 3

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_\-]{16,}")
#: Names whose assigned values count as labelled secrets.
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|credential)s?[\"']?\s*(?::=|=>|=|:)\s*[\"']?$")
WORD = re.compile(r"\w+")
#: Characters looked at on either side of a candidate.
AROUND = 48

FEATURES = ["length", "transitions", "rarest", "digits", "upper", "distinct", "changes", "covered"]
PRIORS = ["path", "before", "after"]


def corpus_statistics(docs: DataFrame, text: str) -> tuple[np.ndarray, frozenset[str]]:
    """Log probabilities of a byte after a byte within words, and the frequent
    words: 128 x 128 numbers and at most 1 / WORD_SHARE words."""
    source = docs.select(F.col(text).alias("_text")).where("_text is not null")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(128 * 128, dtype=np.int64), Counter()
        for (body,) in scan(batches, "_text"):
            code = np.frombuffer(utf8(body), np.uint8)
            ok = code < 128
            pair = code[:-1].astype(np.int32) * 128 + code[1:]
            total += np.bincount(pair[ok[:-1] & ok[1:]], minlength=128 * 128)
            words.update(w for w in body.lower().split() if len(w) < 24)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["word", "pair", "n"])
        for w in range(0, len(words), 50_000):
            part = list(words.items())[w : w + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.nulls(len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["word", "pair", "n"])

    counted = stored(source.mapInArrow(pairs, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")), "corpus-counts")
    counts = np.full(128 * 128, 0.5)
    for pair, n in counted.where("word is null").select("pair", "n").collect():  # at most 128 x 128 rows
        counts[pair] += n
    table = counts.reshape(128, 128)
    total = counted.where("word is not null").agg(F.sum("n")).head()[0] or 0
    often = counted.where(F.col("word").isNotNull() & (F.col("n") >= max(2.0, total * WORD_SHARE)))
    return np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r[0] for r in often.select("word").collect() if len(r[0]) > 2)


def described(candidate: str, transitions: np.ndarray, words: frozenset[str]) -> list[float]:
    """The features of a candidate by itself."""
    code = np.frombuffer(candidate.encode("ascii"), np.uint8)
    steps = transitions[code[:-1], code[1:]]
    kind = np.select([(code >= 48) & (code <= 57), (code >= 65) & (code <= 90), code >= 97], [1, 2, 3], 0)
    longest, lower, at, covered = 12, candidate.lower(), 0, 0
    while at < len(lower):
        for n in range(min(longest, len(lower) - at), 2, -1):
            if lower[at : at + n] in words:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return [float(len(code)), float(steps.mean()), float(np.sort(steps)[: len(steps) // 4 + 1].mean()), float((kind == 1).mean()), float((kind == 2).mean()), len(set(candidate)) / min(len(code), 64), float((kind[1:] != kind[:-1]).mean()), covered / len(code)]


def findings(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """Candidates with their place, features, neighbouring words and the label
    by rule."""
    transitions, words = corpus_statistics(docs, text)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"))
    kind = dict(source.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("doc_id", id_type), ("start", pa.int32()), ("candidate", pa.string()), ("path", pa.string()), ("before", pa.string()), ("after", pa.string()), ("features", pa.list_(pa.float64())), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, body, own in scan(batches, "doc_id", "_text", "_path"):
                for m in CANDIDATE.finditer(body or ""):
                    ahead, behind = body[max(0, m.start() - AROUND) : m.start()], body[m.end() : m.end() + AROUND]
                    before, after = WORD.findall(ahead), WORD.search(behind)
                    yield doc_id, m.start(), m.group(), own, before[-1].lower() if before else "", after.group().lower() if after else "", described(m.group(), transitions, words), int(bool(ASSIGNED.search(ahead)))

        yield from emit(rows(), schema)

    return source.mapInArrow(run, f"doc_id {kind}, start int, candidate string, path string, before string, after string, features array<double>, label int")


def with_priors(found: DataFrame, is_training: Column) -> DataFrame:
    """Log odds of a secret for the path and both words among the training
    findings, a finding's own label left out."""
    found = found.withColumn("_train", is_training & F.col("label").isNotNull())
    own, pos = F.col("_train").cast("double"), F.when(F.col("_train"), F.col("label").cast("double")).otherwise(0.0)
    for name in PRIORS:
        seen = stored(found.where("_train").groupBy(name).agg(F.count("*").alias("_n"), F.sum("label").alias("_pos")), f"prior-{name}")
        rest, hits = F.coalesce("_n", F.lit(0)) - own, F.coalesce("_pos", F.lit(0)) - pos
        found = found.join(growing(seen), name, "left").withColumn(f"_{name}", F.log((hits + 0.5) / (rest - hits + 0.5))).drop("_n", "_pos")
    return found.withColumn("_all", F.concat("features", F.array(*(f"_{name}" for name in PRIORS))))


def classify(found: DataFrame, is_training: Column, sample: int = SAMPLE) -> DataFrame:
    """``found`` (see ``findings``) with ``probability`` and ``is_secret``."""
    wide = stored(with_priors(found, is_training), "findings")
    train = wide.where("_train").orderBy(F.xxhash64("candidate", "start", "before", "after"), "candidate").limit(sample)
    train = stored(train.select("_all", F.col("label").cast("double").alias("label")), "sample").withColumn("_features", array_to_vector("_all"))
    classes = sorted(r[0] for r in train.select("label").distinct().collect())
    if len(classes) < 2:
        scored = wide.withColumn("probability", F.lit(float(classes[0]) if classes else 0.0))
    else:
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=30, maxDepth=6, seed=SEED, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(train)
        scored = forest.transform(wide.withColumn("_features", array_to_vector("_all"))).withColumn("probability", F.get(vector_to_array("_probability"), F.lit(1)))
    return scored.withColumn("is_secret", F.col("probability") >= 0.5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates in the documents, judged; the forest learns from those of
    documents whose crc32(doc_id as text) mod 3 is not 1."""
    held_out = fold(F.col("doc_id"), 3) == 1
    judged = classify(findings(load(spark, sf_dir, "documents")), ~held_out)
    end = (F.col("start") + F.length("candidate")).cast("int").alias("end")
    return judged.select("doc_id", "start", end, F.sha2("candidate", 256).alias("sha256"), held_out.alias("held_out"), F.col("label").alias("assigned"), "probability", "is_secret")
