"""Operations on loaded tables that follow from their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def slices(df: DataFrame, index: str = "_row_index", rows: int = 1000) -> DataFrame:
    """(slice_index, first_row, row_count): the columnar slices a serial reader would deliver; none for no rows."""
    return df.groupBy(F.expr(f"{index} div {rows}").alias("slice_index")).agg(F.min(index).alias("first_row"), F.count("*").alias("row_count"))


def key_order(df: DataFrame) -> list[Column]:
    """Sort columns by the fields' key metadata: keySequence of Dataset-JSON, sortOrder of SAS (negative: descending)."""
    keys = []
    for f in df.schema.fields:
        k = f.metadata.get("sortOrder") or f.metadata.get("keySequence", -1)
        descending = f.metadata.get("sortOrder", 0) < 0
        if descending or k > 0:
            keys.append((abs(k), F.col(f.name).desc() if descending else F.col(f.name).asc()))
    return [c for _, c in sorted(keys, key=lambda x: x[0])]


def key_ranked(df: DataFrame, path: str, name: str = "key_rank") -> DataFrame:
    """Every row of df with its rank from 1 in key order.

    The sorted rows are stored in the folder ``path``, each partition a range of keys; ranks are places inside
    partitions, shifted by the rows of earlier ones, so no task sees the whole table.
    """
    df.orderBy(*key_order(df)).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path, mode="overwrite")
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + place + 1).drop("_part", "_at", "_shift")


def sort_order(raw: Column) -> Column:
    """A column-name entry's sort byte: 0 none, n the nth key, the high bit a descending one (negative)."""
    byte = raw.bitwiseAND(F.lit(0xFF))
    return F.when(byte >= 128, -(byte.bitwiseAND(F.lit(0x7F)))).otherwise(byte)


def last_named(variables: DataFrame, group: str, name: str = "name", position: str = "index") -> DataFrame:
    """Variables by case-insensitive name: unnamed ones left out, of equal names the last."""
    key = F.lower(F.col(name))
    last = F.row_number().over(Window.partitionBy(group, key).orderBy(F.col(position).desc()))
    return variables.where(F.col(name).isNotNull() & (F.col(name) != "")).withColumn("_last", last).where("_last = 1").drop("_last")


def live_rows(df: DataFrame, mark: str = "_deleted") -> DataFrame:
    """Rows that are not marked deleted."""
    return df.where(~F.col(mark)).drop(mark)


def deleted_count(df: DataFrame, mark: str = "_deleted") -> DataFrame:
    return df.agg(F.count_if(F.col(mark)).alias("deleted"), F.count("*").alias("total"))
