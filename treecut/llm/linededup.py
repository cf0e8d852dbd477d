"""Operator 2, line deduplication by content-defined chunks of lines.

A hash of the hashes of two neighbouring lines rolls over each document and
chooses the ends of its chunks, so equal passages have equal chunks wherever they
stand.  Chunks of two lines and more that occur elsewhere are removed everywhere
but at their first occurrence (smallest key, then first line), after their bytes
have been compared with those of that occurrence.  What chunks leave, the edges
of repeated passages and those shorter than a chunk, is settled in the same way
with every two neighbouring lines that do not lie in a removed chunk.  Pairs
overlap, so each run of two or more repeated lines goes whole, whatever stands
around it.  (The lines of a removed chunk all stand in pairs that occur before, so
chunks only save pairs.)  DataFrame functions only.

Defined cases: null and empty texts stay as they are; a text may lose all its
lines and is then empty; a repeated line between lines that are not stays, and so
does a pair that overlaps its own first occurrence (the third of three equal
lines); blank lines count like others; rows that repeat both key and text are one
document and keep the same lines; a null key sorts first; other columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import growing, load, stored

#: A chunk ends after about every so many lines.
DIVISOR = 4


def _row(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text)).alias("_row")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The documents of two lines and more with the hashes of their lines."""
    return docs.where(F.col(text).contains("\n")).select(F.col(key).alias("_key"), _row(key, text), F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x)).alias("_h"))


def _chunks(lines: DataFrame) -> DataFrame:
    """A row for each chunk of two lines and more: ``_start`` (from 1), ``_len``,
    two hashes.  A chunk ends where the hash that rolls over two neighbouring line
    hashes is divided by ``DIVISOR``, but for the line after such an end: the end
    depends on these lines alone, not on where the document starts."""
    h, n = F.col("_h"), F.size("_h")
    rolls = lambda i: (i > 1) & (F.pmod(F.xxhash64(F.get(h, i - 2), F.get(h, i - 1)), F.lit(DIVISOR)) == 0)
    ends = F.filter(F.sequence(F.lit(1), n - 1), lambda i: rolls(i) & ~rolls(i - 1))
    cut = lines.withColumn("_ends", F.concat(F.array(F.lit(0)), ends, F.array(n)))
    size = lambda k: F.get("_ends", k) - F.get("_ends", k - 1)
    own = lambda k: F.slice(h, F.get("_ends", k - 1) + 1, size(k))
    chunk = F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), lambda k: F.struct((F.get("_ends", k - 1) + 1).alias("_start"), size(k).alias("_len"), F.xxhash64(own(k)).alias("_c1"), F.xxhash64(F.lit(1), own(k)).alias("_c2")))
    return cut.select("_key", "_row", F.explode(chunk).alias("_p")).select("_key", "_row", "_p.*").where("_len > 1")


def _pairs(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """A row for each two neighbouring lines that do not lie in one settled chunk."""
    h = F.col("_h")
    inside = F.flatten(F.transform("_cuts", lambda c: F.sequence(c["_start"], c["_start"] + c["_len"] - 2)))
    every = F.sequence(F.lit(1), F.size(h) - 1)
    left = F.when(F.col("_cuts").isNull(), every).otherwise(F.array_except(every, inside))
    own = lambda i: (F.get(h, i - 1), F.get(h, i))
    pair = F.transform(left, lambda i: F.struct(i.alias("_start"), F.lit(2).alias("_len"), F.xxhash64(*own(i)).alias("_c1"), F.xxhash64(F.lit(1), *own(i)).alias("_c2")))
    return lines.join(growing(settled), "_row", "left").select("_key", "_row", F.explode(pair).alias("_p")).select("_key", "_row", "_p.*")


def _repeats(docs: DataFrame, text: str, key: str, units: DataFrame, name: str) -> DataFrame:
    """``(_row, _cuts)``: the units (chunks or pairs of lines) of a document that
    occur before, compared byte by byte with their first occurrence."""
    same, at = ["_c1", "_c2"], F.struct("_key", "_row", "_start")
    # Counted on hashes alone; a frequent unit is one row per task here.
    repeated = stored(units.groupBy(*same).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), f"repeated-{name}")
    overlaps = (F.col("_row") == F.col("_first._row")) & (F.col("_start") == F.col("_first._start") + 1)
    marks = units.join(growing(repeated), same).where(~overlaps).withColumn("_is_first", at.eqNullSafe(F.col("_first")))
    marks = marks.groupBy("_row").agg(F.collect_set(F.struct("_start", "_len", *same, "_is_first")).alias("_marks"))
    # Lines travel with their document, and only repeated ones are sent again.
    texts = docs.select(_row(key, text), F.col(text).alias("_text")).where(F.col("_text").contains("\n"))
    marked = texts.join(growing(marks), "_row").select("_row", "_marks", _lines(F.col("_text")).alias("_lines"))
    body = lambda m: F.concat_ws("\n", F.slice("_lines", m["_start"], m["_len"]))
    found = marked.select("_row", F.explode(F.transform("_marks", lambda m: m.withField("_body", body(m)))).alias("_m"))
    found = stored(found.select("_row", "_m.*"), f"bytes-of-{name}")
    kept = stored(found.where("_is_first").groupBy(*same).agg(F.min("_body").alias("_kept_body")), f"kept-{name}")
    equal = found.where("not _is_first").join(growing(kept), same).where(F.col("_body") == F.col("_kept_body"))
    return equal.groupBy("_row").agg(F.collect_set(F.struct("_start", "_len")).alias("_cuts"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated runs of lines cut from ``text``; ``_n_lines`` and
    ``_n_removed`` are added."""
    # Under other names: documents may have columns called like those made here.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text, key = (plain.columns[docs.columns.index(name)] for name in (text, key))
    return _deduped(plain, text, key).toDF(*docs.columns, "_n_lines", "_n_removed")


def _deduped(docs: DataFrame, text: str, key: str) -> DataFrame:
    lines = _hashed(docs, text, key)
    settled = stored(_repeats(docs, text, key, _chunks(lines), "chunks"), "settled-chunks")
    pairs = _repeats(docs, text, key, _pairs(lines, settled), "pairs")
    cuts = settled.unionByName(pairs).groupBy("_row").agg(F.flatten(F.collect_list("_cuts")).alias("_cuts"))

    whole = docs.withColumn("_row", _row(key, text)).join(growing(cuts), "_row", "left")
    cut_lines = F.array_distinct(F.flatten(F.transform("_cuts", lambda c: F.sequence(c["_start"], c["_start"] + c["_len"] - 1))))
    whole = whole.withColumn("_lines", F.when(F.col("_cuts").isNotNull(), _lines(F.col(text))))
    left = F.array_except(F.sequence(F.lit(1), F.size("_lines")), cut_lines)
    shorter = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i - 1)), "\n")
    n_lines = F.coalesce(F.when(F.col(text) == "", 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1), F.lit(0))
    n_removed = F.coalesce(F.size(cut_lines), F.lit(0))
    done = whole.withColumns({"_n_lines": n_lines, "_n_removed": F.when(F.col("_cuts").isNull(), 0).otherwise(n_removed), "_shorter": F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(shorter)})
    return done.select(*(F.col("_shorter").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), "_n_lines", "_n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated runs of lines removed."""
    done = dedup_lines(load(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")
