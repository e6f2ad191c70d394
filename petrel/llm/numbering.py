"""Gapless numbering inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], name: str) -> DataFrame:
    """df with ``name``, a number from 0 without gaps inside each group of ``keys``.

    ``bucket`` spreads a group over tasks: rows are numbered inside (keys, bucket) and
    shifted by the rows of the group's earlier buckets, so no task gathers a hot group.
    df is read twice: pass a stored table.
    """
    each = [*keys, bucket]
    counts = df.groupBy(*each).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(*each, F.coalesce(before, F.lit(0)).alias("_shift"))
    inner = df.withColumn("_inner", F.row_number().over(Window.partitionBy(*each).orderBy(*order)).cast("long") - 1)
    return inner.join(shift, each).withColumn(name, F.col("_inner") + F.col("_shift")).drop("_inner", "_shift")
