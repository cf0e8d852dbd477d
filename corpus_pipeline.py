"""A training corpus from ``documents``: five stages, each on what the one
before it kept, written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treecut.llm import decontaminate, langid, linededup, neardedup, packing
from treecut.llm.common import load, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` under other names (documents may have columns called like those of
    the operators), and what ``doc_id`` and ``text`` are called there."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain, *(plain.columns[docs.columns.index(name)] for name in ("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain: those without a letter and those
    with two languages about as likely go."""
    model = langid.learn(docs.where(langid.fold(F.col("doc_id"), 3) != 1))
    plain, _, text = _plain(docs)
    found = langid.identify(plain, model, text, tuple(plain.columns))
    return found.where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs of lines; a document of which nothing
    visible is left goes."""
    plain, key, text = _plain(docs)
    done = linededup.dedup_lines(plain, text, key)
    done = done.where((F.col("_n_removed") == 0) | F.col(text).rlike(r"\S"))
    if "n_chars" in docs.columns:
        n_chars = plain.columns[docs.columns.index("n_chars")]
        done = done.withColumn(n_chars, F.when(F.col("_n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return done.select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 %).
    Rows that repeat key and text, told by two hashes, are one document."""
    plain, key, text = _plain(docs)
    kept = neardedup.near_duplicates(plain, text, key).where("kept").select(F.col("row").alias("_row"))
    own = plain.withColumns({"_row": F.xxhash64(key, text), "_more": F.xxhash64(F.lit(1), key, text)})
    return own.join(kept.distinct(), "_row", "left_semi").dropDuplicates(["_row", "_more"]).select(*plain.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    plain, key, text = _plain(docs)
    own = plain.withColumn("_row", F.xxhash64(key, text))
    found = decontaminate.contamination(decontaminate.occurrences(own, load(spark, sf_dir, "benchmark"), text=text, key="_row"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return own.join(bad, "_row", "left_anti").select(*plain.columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Output codes, rolling hashes and BPE are not SQL; tests/llm compares the
#: stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
