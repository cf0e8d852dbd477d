"""Session helpers: checkpoint folder from the session, lineage cut, spread."""

import os

from pyspark.sql import functions as F

from treecut.session import cut_lineage, ensure_checkpoint_dir, spread


def test_checkpoint_dir_comes_from_the_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d
    assert ensure_checkpoint_dir(spark) == d          # set once, then reused


def test_cut_lineage_writes_to_the_checkpoint_folder(spark):
    df = spark.range(100).select((F.col("id") * 2).alias("x"))
    cut = cut_lineage(df)
    assert cut.agg(F.sum("x")).first()[0] == 9900
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan or "ExistingRDD" in plan        # no lineage back to range()
    folder = spark.sparkContext.getCheckpointDir().replace("file:", "")
    assert any(os.scandir(folder))


def test_spread_only_when_too_few_partitions(spark):
    small = spark.range(10).coalesce(1)
    assert spread(small).rdd.getNumPartitions() > 1
    wide = spark.range(1000).repartition(64)
    assert spread(wide).rdd.getNumPartitions() == 64
    spark.conf.set("treecut.spread.partitions", "0")
    try:
        assert spread(small).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("treecut.spread.partitions")


def test_spread_bounds_a_task_of_a_large_scan(spark, monkeypatch):
    """A task gets ``most`` bytes of a large scan, whatever its splits are."""
    from treecut import session
    monkeypatch.setattr(session, "SPREAD_BELOW_BYTES", 1000)
    one = spark.range(1_000_000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 1
    cut = spread(one, "id", most=1 << 18)
    assert cut.rdd.getNumPartitions() == 31 and cut.agg(F.sum("id")).first()[0] == 499_999_500_000
    assert spread(spark.range(1000).repartition(64), most=1 << 18).rdd.getNumPartitions() == 64
