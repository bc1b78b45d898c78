"""Numbers and running sizes of rows within groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import work_dir


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], size: Column | None = None) -> DataFrame:
    """``rows`` with ``rank``, from 1 within each group of ``keys`` in ``order``, and with ``size`` given also ``before``, the sizes
    of the group's rows before together.

    No group is one task: rows are dealt by ranges of (keys, order), so that a large group lies in many ranges. Each range counts
    its own rows of a group; a range's counts, a row for a group and range, give what lies before it. The ranges are
    written once, so that both readings see the same. Keys must not be null; rows that ``order`` does not tell apart are numbered as they come.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_dir(spark)}/ranges-{uuid.uuid4().hex}"
    sized = rows if size is None else rows.withColumn("_size", size.cast("long"))
    dealt = sized.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count("*").alias("_rows")] + ([F.sum("_size").alias("_sizes")] if size is not None else [])
    ranges = dealt.groupBy(*keys, "_part").agg(*sums)
    ahead = ranges.select(
        *keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"),
        *([F.coalesce(F.sum("_sizes").over(earlier), F.lit(0)).alias("_ahead_size")] if size is not None else []),
    )
    out = dealt.withColumn("_n", F.row_number().over(own))
    if size is not None:
        out = out.withColumn("_sum", F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(ahead, [*keys, "_part"])
    return out.select(
        *rows.columns, (F.col("_n") + F.col("_ahead")).alias("rank"),
        *([(F.col("_sum") - F.col("_size") + F.col("_ahead_size")).alias("before")] if size is not None else []),
    )
