"""Session helpers: a configured SparkSession, a checkpoint folder and spreading."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "treecut", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is only set when given: on a cluster the submitter decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only when nothing is configured (local runs, tests) a scratch folder is
    made; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        conf_dir = tempfile.mkdtemp(prefix="treecut-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage
    (a reliable checkpoint: it survives the loss of the executors that made it)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: Scans above this size are never spread: their splits are tasks enough.
SPREAD_BELOW_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame, *keys: str, factor: int = 2, most: int | None = None) -> DataFrame:
    """Give a CPU-heavy stage over a small scan enough tasks.

    A small input (one Parquet row group, say) can arrive as a single
    non-empty split, and the tokeniser would then run on one core.  A scan of
    less than ``SPREAD_BELOW_BYTES`` with fewer partitions than ``factor`` x the
    default parallelism is hashed on ``keys`` (round robin when none) over that
    many partitions.  Larger scans are left untouched on a cluster of any size:
    no text is shuffled there.  ``most`` asks for a partition per that many bytes
    (as Spark estimates them) at every size, for work that takes far longer than
    reading and would make a task of every row group.  ``treecut.spread.partitions`` (session conf)
    overrides the target; ``0`` never spreads.
    """
    spark = df.sparkSession
    conf = spark.conf.get("treecut.spread.partitions", None)
    target = int(conf) if conf else max(1, spark.sparkContext.defaultParallelism * factor)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BELOW_BYTES:
        target = 0
    if most and not conf:
        target = max(target, math.ceil(size / most))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
