"""Folders of encoded files, written by tasks into the session's shared folder."""

from __future__ import annotations

import atexit
import gzip
import json
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import encoders as E
from ..sources.files import resolve

_LOCAL: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, or, where that is unset and the master local, in a temporary folder of this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="petrel-fixtures-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    atexit.register(lambda: _gone(system, target))
    return path


def _gone(system, target) -> None:
    try:
        system.delete(target, True)
    except Exception:  # the session is over
        return


def write_files(df: DataFrame, path: str, encode: Callable[[pa.Table], bytes], suffix: str) -> str:
    """One file for each partition of df; returns the folder."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            system, to = resolve(f"{path}/{uuid.uuid4().hex}{suffix}")
            with system.open_output_stream(to, compression=None) as out:
                out.write(encode(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n long").count()
    return path


def write_bytes(uri: str, data: bytes) -> str:
    """One small file as it is."""
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def dsj_bytes(columns: list[dict], container: str = "PLAIN", nested: bool = False, name: str = "DATA", records: int | None = None) -> Callable[[pa.Table], bytes]:
    """Encoder of a table to Dataset-JSON; rows are the table's columns in order."""

    def encode(table: pa.Table) -> bytes:
        rows = zip(*(c.to_pylist() for c in table.columns), strict=True)
        meta = {"datasetJSONCreationDateTime": "2025-01-01T00:00:00", "datasetJSONVersion": "1.1.0", "itemGroupOID": f"IG.{name}", "name": name, "label": name, "records": table.num_rows if records is None else records, "columns": columns}
        lines = [json.dumps(list(r)) for r in rows]
        head = json.dumps(meta)
        text = head[:-1] + ', "rows": [' + ",\n".join(lines) + "]}" if nested else "\n".join([head, *lines]) + "\n"
        raw = text.encode()
        return {"PLAIN": raw, "GZIP": gzip.compress(raw, 1) if container == "GZIP" else raw, "ZLIB": zlib.compress(raw, 1) if container == "ZLIB" else raw}[container]

    return encode


def _arrays(table: pa.Table, widths: dict[str, int], number) -> list[tuple[str, np.ndarray, bool]]:
    out = []
    for name in table.column_names:
        column = table.column(name)
        if name in widths:
            out.append((name, E.char_cells(column.to_pylist(), widths[name]), False))
        else:
            out.append((name, number(np.array([np.nan if v is None else v for v in column.to_pylist()], dtype=np.float64)), True))
    return out


def xpt_bytes(widths: dict[str, int], names: dict[str, str], member: str = "DATA", more: list[bytes] | None = None) -> Callable[[pa.Table], bytes]:
    """Encoder to a transport file; names gives each column's name of at most eight characters."""
    return lambda table: E.xpt_file([E.xpt_member(member, [(names.get(n, n), x, numeric) for n, x, numeric in _arrays(table, widths, E.numeric_cells)]), *(more or [])])


def bdat_bytes(widths: dict[str, int], compression: str = "", deleted: Callable[[pa.Table], np.ndarray] | None = None, wide: bool = True, little: bool = True, name: str = "DATA", created: float = 0.0) -> Callable[[pa.Table], bytes]:
    """Encoder to SAS7BDAT; deleted picks the rows that are marked."""

    def encode(table: pa.Table) -> bytes:
        found = _arrays(table, widths, lambda v: E.float_cells(v, little))
        columns = [{"name": n, "numeric": numeric, "label": n} for n, _, numeric in found]
        return E.sas7bdat_file(columns, [x for _, x, _ in found], name=name, compression=compression, deleted=deleted(table) if deleted else None, wide=wide, little=little, created=created)

    return encode
