"""Numbers by position, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_in_order(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in each group by ``order``, without sorting a group in one task.

    ``bucket`` never falls as ``order`` rises. Rows are sorted within buckets; the running
    total of the buckets' sizes, one row a bucket, gives where each bucket starts.
    """
    keys = [f"_{name}_{i}" for i in range(len(group) + 1)]
    rows = rows.withColumns(dict(zip(keys, [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group] + [bucket])))
    before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.join(starts, keys).withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop(*keys, "_start", "_at")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as shuffles have, however few bytes they are: for steps whose work a row is large.

    One task more, as a deal by the same keys over the same number would be left out for the shuffle before it, whose small tasks are merged.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1, *keys)
