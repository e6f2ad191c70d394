"""Metadata of files as DataFrames.  All come from headers; rows are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sources import dsj, sas7bdat, xpt
from .sources.files import listed


def dsj_tables(spark: SparkSession, path: str) -> DataFrame:
    kind = "path string, container string, nested boolean, creation string, version string, item_group_oid string, name string, label string, records long, column_count int, source_system struct<name: string, version: string>, dbLastModifiedDateTime string, fileOID string, metaDataRef string, metaDataVersionOID string, originator string, studyOID string"
    rows = []
    for p in listed(path, "json"):
        t = dsj.read_head(p)
        system = (str(t.source_system["name"]), str(t.source_system["version"])) if t.source_system else None
        rows.append((p, t.container, t.nested, t.creation, t.version, t.item_group_oid, t.name, t.label, t.records, len(t.columns), system, *(None if v is None else str(v) for v in t.optional.values())))
    return spark.createDataFrame(rows, kind)


def dsj_columns(spark: SparkSession, path: str) -> DataFrame:
    kind = "table string, index int, item_oid string, name string, label string, data_type string, target_type string, display_format string, length int, key_sequence int"
    rows = [(t.name, c.index, c.item_oid, c.name, c.label, c.data_type, c.target_type, c.display_format, c.length, c.key_sequence) for t in map(dsj.read_head, listed(path, "json")) for c in t.columns]
    return spark.createDataFrame(rows, kind)


def xpt_library(spark: SparkSession, path: str) -> DataFrame:
    rows = [(p, lib.version, lib.os, xpt.stamp(lib.created), xpt.stamp(lib.modified), len(lib.members)) for p in listed(path, ".xpt") for lib in [xpt.parse_library(p)]]
    return spark.createDataFrame(rows, "path string, version string, os string, created timestamp_ntz, modified timestamp_ntz, members int")


def xpt_members(spark: SparkSession, path: str) -> DataFrame:
    """Row counts are not in the format and null here."""
    rows = [(p, m.name, m.label, m.type, m.version, m.os, xpt.stamp(m.created), xpt.stamp(m.modified), len(m.variables), m.descriptor, m.first, None) for p in listed(path, ".xpt") for m in xpt.parse_library(p).members]
    return spark.createDataFrame(rows, "path string, name string, label string, type string, version string, os string, created timestamp_ntz, modified timestamp_ntz, variables int, descriptor int, first_byte long, row_count long")


def xpt_variables(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for p in listed(path, ".xpt"):
        for m in xpt.parse_library(p).members:
            rows += [(m.name, v.number, v.name, v.label, "NUMERIC" if v.numeric else "CHARACTER", v.length, v.position, v.name_hash, *v.format, *v.informat) for v in m.variables]
    return spark.createDataFrame(rows, "member string, number int, name string, label string, type string, length int, position int, name_hash int, format string, format_length int, format_decimals int, justify int, informat string, informat_length int, informat_decimals int")


def bdat_datasets(spark: SparkSession, path: str) -> DataFrame:
    kind = "path string, name string, label string, platform string, little_endian boolean, bits int, encoding int, charset string, file_type string, created timestamp_ntz, modified timestamp_ntz, header_size int, page_size int, page_count long, row_length long, row_count long, deleted_count long, column_count long, compression string, creator_process string, creator_software string, release string, server string, os_version string, os_vendor string, os_name string"
    rows = []
    for p in listed(path, ".sas7bdat"):
        h = sas7bdat.parse_dataset(p)
        rows.append((p, h.name, h.label, h.platform, h.little, 64 if h.wide else 32, h.encoding, h.charset, h.file_type, h.created, h.modified, h.header_size, h.page_size, h.page_count, h.row_length, h.row_count, h.deleted, h.column_count, h.compression, h.process, h.creator, h.release, h.server, h.os_version, h.os_vendor, h.os_name))
    return spark.createDataFrame(rows, kind)


def bdat_variables(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for p in listed(path, ".sas7bdat"):
        h = sas7bdat.parse_dataset(p)
        rows += [(h.name, i, c.name, c.label, c.format, c.offset, c.width, "NUMERIC" if c.numeric else "CHARACTER", c.sort_order) for i, c in enumerate(h.columns)]
    return spark.createDataFrame(rows, "dataset string, index int, name string, label string, format string, offset long, width int, type string, sort_order int")


def bdat_library(spark: SparkSession, path: str) -> DataFrame:
    """Of a folder of members the earliest creation and the latest change."""
    return bdat_datasets(spark, path).agg(F.min("created").alias("created"), F.max("modified").alias("modified"), F.count("*").alias("members"))
