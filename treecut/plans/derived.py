"""Text files that Spark derives from the driver tables, for the file operators.

The driver tables are Parquet; the reference reads folders of text files.
``documents_as_files`` writes the documents as text files (16 consecutive
documents per file, each followed by a newline, in ``doc_id`` order) under
the shared checkpoint folder, so the file sources, the large-file reader,
the sink and the stream run on data that grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import load

DOCS_PER_FILE = 16
DOCS_PER_LONG_LINE = 64
#: Tasks that write files, for each that the cluster runs at once, at least: the
#: work goes by the number of files, which Spark does not see in their bytes.
WRITING_FACTOR = 4
_WRITTEN: dict[tuple[str, str], str] = {}


def documents_as_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder ``.../file=<k>/part-*.txt``; file k holds documents 16k .. 16k+15."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _WRITTEN:
        return _WRITTEN[key]
    out = scratch_path(spark, f"documents_as_files/{uuid.uuid4().hex}")
    d = load(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / F.lit(DOCS_PER_FILE)).cast("bigint").alias("file"), "doc_id", "text")
    tasks = max(WRITING_FACTOR * spark.sparkContext.defaultParallelism, d.rdd.getNumPartitions())
    # All rows of a file go to one task, sorted by doc_id there: one part per file.
    (d.repartition(tasks, F.col("file")).sortWithinPartitions("file", "doc_id").select("file", "text")
      .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("file").text(out))
    _WRITTEN[key] = out
    return out


def documents_as_long_lines(spark: SparkSession, sf_dir: str) -> str:
    """Folder ``.../file=<k>/part-*.txt``: the texts of 64 documents with blanks for
    newlines, each followed by a blank, in ``doc_id`` order: a file is one line."""
    out = scratch_path(spark, f"documents_as_long_lines/{uuid.uuid4().hex}")
    d = load(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / F.lit(DOCS_PER_LONG_LINE)).cast("bigint").alias("file"), "doc_id",
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    (d.repartition(F.col("file")).sortWithinPartitions("file", "doc_id").select("file", "text")
      .write.mode("overwrite").option("partitionOverwriteMode", "static").option("lineSep", " ").partitionBy("file").text(out))
    return out


def timing_logs(spark: SparkSession, sf_dir: str) -> str:
    """Folder ``.../lang=<lang>/part-*.txt``: a log per language with a timing line
    for each source, in order of the source, amid lines that are none.

    The seconds are a fixed function of the source's bytes and documents.  Some
    timing lines start with a tab or end with a carriage return; the others that
    start with ``time:`` have too few fields.
    """
    out = scratch_path(spark, f"timing_logs/{uuid.uuid4().hex}")
    d = load(spark, sf_dir, "documents")
    g = d.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    secs = F.format_string("%d.%03d", F.col("n"), F.col("b") % 1000)
    line = F.concat(F.lit("time: "), secs, F.lit(" secs to tokenize "), F.col("b").cast("string"), F.lit("b, "),
                    F.floor(F.col("b") / 1024 / F.col("n")).cast("string"), F.lit("kb/s (tokens:"), F.col("c").cast("string"), F.lit(")."))
    line = F.when(F.col("b") % 3 == 0, F.concat(F.lit("\t "), line)).when(F.col("b") % 3 == 1, F.concat(line, F.lit("\r"))).otherwise(line)
    noise = [F.lit("files: "), F.lit("time: 9.0 secs to\r"), F.lit("time:"), F.lit(" xtime: 1 2 3 4"), F.lit("")]
    lines = g.select("lang", "source", F.posexplode(F.array(*noise[:3], line, *noise[3:])).alias("seq", "line"))
    ordered = lines.repartition("lang").sortWithinPartitions("lang", "source", "seq").select("lang", "line")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").text(out)
    return out


def language(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"lang=([^/]*)", 1)


def file_number(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"file=(\d+)", 1).cast("bigint")


FILE_TEXT_SQL = f"""files AS (
  SELECT (doc_id // {DOCS_PER_FILE})::BIGINT AS file, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
  FROM documents GROUP BY 1)"""

LONG_LINE_SQL = f"""files AS (
  SELECT (doc_id // {DOCS_PER_LONG_LINE})::BIGINT AS file, string_agg(replace(text, chr(10), ' ') || ' ', '' ORDER BY doc_id) AS text
  FROM documents GROUP BY 1)"""
