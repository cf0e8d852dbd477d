"""Speed-up report from timing logs.

A timing log holds, among other output, lines like
``time: <secs> secs to tokenize <bytes>b, <kb>kb/s (tokens:<n>).``.  The
runs were made engine-major (every size for the first engine, then every
size for the next, ...), the baseline engine first; the report divides the
baseline's time by each engine's time at the same size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import line_ordinals, read_lines
from .ordering import with_group_aggregates

# Default labels for a sweep of five engines in run order (baseline first;
# callers pass their own names) and the fixed data sizes in MB of the
# reference's sweep.
ENGINES = ["baseline", "engine_1", "engine_2", "engine_3", "engine_4"]
SIZES_MB = [1, 10, 100, 300, 500, 1000]


def timing_lines(spark: SparkSession, path: str) -> DataFrame:
    """S8 + F3 + F9 + W2: ``(path, k, secs, bytes, tokens)`` per timing line.

    ``k`` numbers the timing lines of each log from 0 in file order (a
    distributed running count, not a per-file window).  A line counts when
    it has at least 5 fields and the first is ``time:``.
    """
    lines = read_lines(spark, path)
    # Fields between runs of white space, those at the line's ends included
    # (a tab before, a carriage return after).
    f = F.array_remove(F.split("line", r"\s+"), "")
    keep = lines.where((F.size(f) >= 5) & (F.get(f, 0) == F.lit("time:")))
    keep = keep.select("path", "block", "lid", "line", f.alias("_f"))
    numbered = line_ordinals(keep.select("path", "block", "lid", "line", "_f"))
    bytes_ = F.regexp_extract("line", r"tokenize (\d+)b", 1)
    toks = F.regexp_extract("line", r"tokens:(\d+)", 1)
    return numbered.select(
        "path",
        F.col("line_no").alias("k"),
        F.get("_f", 1).try_cast("double").alias("secs"),     # a malformed number gives NULL
        F.when(bytes_ != "", bytes_.cast("bigint")).alias("bytes"),
        F.when(toks != "", toks.cast("bigint")).alias("tokens"),
    )


def label_runs(timings: DataFrame, engines: list[str] = ENGINES, sizes_mb: list[int] = SIZES_MB) -> DataFrame:
    """The engine x size matrix, matched to timing lines by position.

    With ``n`` timing lines in a log, each engine owns ``n // len(engines)``
    consecutive lines; line ``k`` is engine ``k // per`` at size index
    ``k % per``.  Lines past ``len(engines) * per`` are dropped, as the
    reference does.  The matrix is two literal arrays indexed by position:
    no cross join.
    """
    t = with_group_aggregates(timings, ["path"], [F.count(F.lit(1)).alias("_n")])
    t = t.withColumn("_per", F.floor(F.col("_n") / F.lit(len(engines))))
    t = t.where((F.col("_per") > 0) & (F.col("k") < F.col("_per") * F.lit(len(engines))))
    e_idx = F.floor(F.col("k") / F.col("_per")).cast("int")
    s_idx = (F.col("k") % F.col("_per")).cast("int")
    return t.select(
        "path",
        F.get(F.array(*[F.lit(e) for e in engines]), e_idx).alias("engine"),
        s_idx.alias("size_idx"),
        F.get(F.array(*[F.lit(s) for s in sizes_mb]), s_idx).alias("size_mb"),
        "secs", "bytes", "tokens",
    )


def speedup(runs: DataFrame, baseline: str = ENGINES[0]) -> DataFrame:
    """``baseline secs / engine secs`` per log, engine and size.

    A self equi-join of the runs on ``(path, size_idx)``.
    """
    base = runs.where(F.col("engine") == baseline).select(
        "path", "size_idx", F.col("secs").alias("baseline_secs"))
    other = runs.where(F.col("engine") != baseline)
    j = other.join(base, ["path", "size_idx"])
    return j.select("path", "engine", "size_idx", "size_mb", "secs", "baseline_secs",
                    F.when(F.col("secs") > 0, F.col("baseline_secs") / F.col("secs")).alias("speedup"))


def speedup_report(spark: SparkSession, log_path: str, engines: list[str] = ENGINES,
                   sizes_mb: list[int] = SIZES_MB) -> DataFrame:
    """The whole report: read logs, label the runs, divide by the baseline."""
    return speedup(label_runs(timing_lines(spark, log_path), engines, sizes_mb), engines[0])
