"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Where the setting is absent
(tests, a notebook on one machine) a temporary folder of this process stands in, for a local
master only: on a cluster each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: the session's setting, else, on a local master, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="petrel-"))
    return f"file://{_FALLBACK[0]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder of Parquet tables that cut lineage; a lost executor costs no recomputation of them.

    Tables stay until ``drop`` or the end of the driver: a lazily read result may need them.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of jobs that are over.

        A plan is let go of in two steps, Python's handle and then what the plan itself holds,
        and the cleaner works on its own thread: hence two rounds and the short waits.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.4)

    def _at_exit(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session is gone; a cluster's clean-up of the folder remains
            return


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
