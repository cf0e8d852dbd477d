"""Running totals and ordinals in a global order, without a global window.

A window with ``orderBy`` and no ``partitionBy`` sends every row to one
task.  Here the rows are range-partitioned on the order, a window runs
inside each range part, and one row per part (a table of ``n_parts`` rows,
broadcast) gives each part its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


#: Rows of a range part: the parts grow with the data, a part does not.
ROWS_PER_PART = 200_000


def parts_for(rows: int) -> int:
    return 1 + rows // ROWS_PER_PART


def running_total(df: DataFrame, order: list[str], value: str, out: str, rank_out: str = "_rank",
                  n_parts: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` and ``rank_out`` = 0-based
    position, both in ``order`` (which must be unique)."""
    n_parts = n_parts or parts_for(df.count())
    # The part id is materialised once, so every use below sees the same parts.
    parted = cut_lineage(df.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order)
    local = parted.select("*", F.sum(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))
                          .alias("_lsum"), F.row_number().over(w).alias("_lrow"))
    per_part = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_pn"), F.sum(F.col(value)).alias("_ps"))
    wp = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_pn").over(wp), F.lit(0)).alias("_on"),
                              F.coalesce(F.sum("_ps").over(wp), F.lit(0)).alias("_os"))
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(
        *df.columns,
        (F.col("_on") + F.col("_lrow") - 1).cast("bigint").alias(rank_out),
        (F.col("_os") + F.col("_lsum")).cast("bigint").alias(out),
    )


def offsets_within(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
                   n_parts: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the earlier rows of the same group
    (exclusive), in ``order`` - for groups of any size, hot ones included.

    Rows are range-partitioned on (group, order); a group may span many
    parts.  The global exclusive running sum ``B`` never decreases, so the
    start of a row's group is the running *max* of ``B`` over group-first
    rows up to it: inside a part a running window, across parts a carry from
    a table of one row per part (broadcast).  No join on the group key, so
    one huge group is spread over many tasks like any other rows.
    """
    n_parts = n_parts or parts_for(df.count())
    gkey = F.struct(*group)
    parted = cut_lineage(df.repartitionByRange(n_parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*group, *order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = parted.select(
        "*",
        (F.sum(F.col(value)).over(run) - F.col(value)).alias("_lb"),        # exclusive, inside the part
        F.row_number().over(w).alias("_lrow"),
        F.lag(gkey).over(w).alias("_lprev"),
    )
    # Group starts inside the part (its first row is decided with the carry).
    local = local.withColumn("_lmark", F.when((F.col("_lrow") > 1) & (F.col("_lprev") != gkey), F.col("_lb")))
    local = local.withColumn("_lrun", F.max("_lmark").over(run))
    per_part = local.groupBy("_part").agg(
        F.sum(F.col(value)).alias("_ps"), F.min(gkey).alias("_gfirst"), F.max(gkey).alias("_glast"),
        F.max("_lmark").alias("_pmark"))
    wp = Window.orderBy("_part")
    parts = per_part.select(
        "_part", "_pmark", "_gfirst",
        F.coalesce(F.sum("_ps").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_os"),
        F.lag("_glast").over(wp).alias("_prev_last"))
    parts = parts.withColumn("_first_starts", F.col("_prev_last").isNull() | (F.col("_prev_last") != F.col("_gfirst")))
    parts = parts.withColumn("_pstart", F.when(F.col("_pmark").isNotNull(), F.col("_os") + F.col("_pmark"))
                             .when(F.col("_first_starts"), F.col("_os")))
    parts = parts.withColumn("_carry", F.max("_pstart").over(wp.rowsBetween(Window.unboundedPreceding, -1)))
    j = local.join(F.broadcast(parts.select("_part", "_os", "_first_starts", "_carry")), "_part")
    start = F.greatest(F.col("_os") + F.col("_lrun"), F.when(F.col("_first_starts"), F.col("_os")), F.col("_carry"))
    return j.select(*df.columns, (F.col("_os") + F.col("_lb") - start).cast("bigint").alias(out))


def with_group_aggregates(df: DataFrame, group: list[str], aggs: list) -> DataFrame:
    """Add per-group aggregates to every row; NULL keys are a group.

    The rows are materialised once (the aggregate and the join read them), and
    so are the aggregates: both sides of the join are then plain scans, whose
    partitions Spark can split where a group is large.
    """
    rows = cut_lineage(df)
    per_group = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(*aggs)
    per_group = cut_lineage(per_group)
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return rows.join(per_group, same).drop(*[f"_g_{g}" for g in group])
