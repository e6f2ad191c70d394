"""Which value mapping a Dataset-JSON column asks for by its data type and target data type."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import numeric, temporal

LOG = logging.getLogger(__name__)
#: The data types and target data types by name, unknown names degrade to OTHER.
DATA_TYPES = ("string", "integer", "decimal", "float", "double", "boolean", "datetime", "date", "time", "uri")
TARGET_TYPES = ("integer", "decimal")


def parse_type(text: str | None, names: tuple[str, ...] = DATA_TYPES) -> str:
    """The type's lower-case name, whatever the text's case; ``unknown`` for none, ``other`` for what is not listed."""
    if text is None:
        return "unknown"
    return text.lower() if text.lower() in names else "other"


def type_name(text: Column, names: tuple[str, ...] = DATA_TYPES) -> Column:
    """Column form of parse_type."""
    low = F.lower(text)
    return F.when(text.isNull(), "unknown").when(low.isin(*names), low).otherwise("other")


def _same(x: Column) -> Column:
    return x


def target_mapper(data_type: str | None, target: str | None) -> Callable[[Column], Column]:
    """Text to the target's number; the identity where no target asks for one."""
    kind, goal = parse_type(data_type), parse_type(target, TARGET_TYPES)
    if goal == "unknown":
        return _same
    if goal == "other":
        LOG.warning("unknown target data type %r: values stay as they are", target)
        return _same
    if goal == "integer":
        found = {"datetime": temporal.sas_datetime, "date": temporal.sas_date, "time": temporal.sas_time}.get(kind)
        if found:
            return found
        LOG.warning("target integer for data type %r: read as a decimal", data_type)
    elif kind != "decimal":
        LOG.warning("target decimal for data type %r", data_type)
    return numeric.decimal_value


def inverse_mapper(data_type: str | None, target: str | None) -> Callable[[Column], Column]:
    """The target's number back to text."""
    kind, goal = parse_type(data_type), parse_type(target, TARGET_TYPES)
    if goal == "integer":
        return {"datetime": temporal.iso_from_sas_datetime, "date": temporal.iso_from_sas_date, "time": temporal.iso_from_sas_time}.get(kind, _same)
    return _same


def unix_inverse_mapper(data_type: str | None) -> Callable[[Column], Column]:
    return {"date": temporal.iso_from_unix_date, "datetime": temporal.iso_from_unix_datetime}.get(parse_type(data_type), _same)


def container(head: Column) -> Column:
    """PLAIN, GZIP, ZLIB or UNKNOWN by a file's first two bytes (binary)."""
    h = F.hex(F.substring(head, 1, 2))
    return F.when(F.length(h) < 4, "UNKNOWN").when(h == "1F8B", "GZIP").when(F.substring(h, 1, 2) == "78", "ZLIB").when(F.substring(h, 1, 2) == "7B", "PLAIN").otherwise("UNKNOWN")
