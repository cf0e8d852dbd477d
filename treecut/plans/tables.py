"""Loading the driver tables and the stress text used by rule queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.duck import sql_estr
from ..functions.rules import GOLDEN
from ..session import spread

TEXT_TABLES = {
    "documents": (["doc_id"], "text"),
    "conversations": (["conv_id", "turn"], "text"),
    "pages": (["page_id"], "html"),
    "benchmark": (["item_id"], "text"),
}

SNIPPETS = [g[1] for g in GOLDEN]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_text(spark: SparkSession, sf_dir: str, name: str, *extra: str, most: int | None = None) -> DataFrame:
    """Key and text columns of a text table, spread over enough tasks (``most``: bytes of one)."""
    keys, text = TEXT_TABLES[name]
    df = load(spark, sf_dir, name).select(*keys, *extra, F.col(text).alias("text"))
    return spread(df, *keys, most=most)


def stress_text(text: Column, key: Column) -> Column:
    """A golden snippet of number ``key % k`` put behind the text or, in every
    other run of ``k`` keys, in front of it: the tables hold almost no quotes,
    apostrophes, ellipses or ``--``, and no text starts with a quote."""
    k = len(SNIPPETS)
    pick = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.pmod(key, F.lit(k)) + 1).cast("int"))
    front = F.pmod(F.floor(key / F.lit(k)), F.lit(2)) == 1
    return F.when(front, F.concat(pick, F.lit(" "), text)).otherwise(F.concat(text, F.lit(" "), pick))


def stress_text_sql(text: str, key: str) -> str:
    k = len(SNIPPETS)
    pick = "[" + ", ".join(sql_estr(s) for s in SNIPPETS) + f"][({key} % {k}) + 1]"
    return f"(CASE WHEN ({key} // {k}) % 2 = 1 THEN {pick} || ' ' || {text} ELSE {text} || ' ' || {pick} END)"
