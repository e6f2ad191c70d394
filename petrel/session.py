"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC (naive and offset values share one zone) and register the file sources."""
    from .sources.sas7bdat import Sas7bdatSource
    from .sources.xpt import XptSource

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    for source in (XptSource, Sas7bdatSource):
        spark.dataSource.register(source)
    return spark
