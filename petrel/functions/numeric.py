"""Numbers as clinical files write them: thousands separators, decimals, IBM hexadecimal floats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GROUPED = r"^[\x00-\x20]*[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(?![0-9])[^,]*\z"
#: Not a number to a Java reader, though Spark's cast takes them.
_FOREIGN = r"(?i)^[\x00-\x20]*[+-]?(inf|infinity|nan)[\x00-\x20]*$"
_NAMED = r"^[\x00-\x20]*[+-]?(Infinity|NaN)[\x00-\x20]*$"
NAN = "NaN"


def without_thousands(text: Column) -> Column:
    """Text without its thousands separators; null where commas are anything else; without a comma as it is."""
    return F.when(F.instr(text, ",") == 0, text).when(text.rlike(GROUPED), F.replace(text, F.lit(","), F.lit("")))


def strict_double(text: Column) -> Column:
    """Double by the Java grammar: suffixes d and f, ``.5``, ``1.``, NaN and Infinity by their exact names; else null."""
    return F.when(text.rlike(_FOREIGN) & ~text.rlike(_NAMED), F.lit(None).cast("double")).otherwise(text.try_cast("double"))


def decimal_value(text: Column) -> Column:
    """Decimal text to a double; null and what is no number become NaN."""
    return F.coalesce(strict_double(without_thousands(text)), F.lit(NAN).cast("double"))


def ibm_double(raw: Column) -> Column:
    """IBM hexadecimal float of up to eight bytes (right-padded with zeros) to a double, low bits cut off.

    A zero mantissa under ``.``, ``_`` or A-Z is a missing value (null), under 00 or 80 a signed
    zero; under any other lead byte it is an error.
    """
    digits = F.rpad(F.hex(raw), 16, "0")
    lead = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
    m = F.conv(F.substring(digits, 3, 14), 16, 10).cast("long")
    cut = F.when(m >= 1 << 55, 3).when(m >= 1 << 54, 2).when(m >= 1 << 53, 1).otherwise(0)
    kept = F.call_function("shiftleft", F.call_function("shiftright", m, cut), cut).cast("double")
    sign = F.when(lead >= 128, -1.0).otherwise(1.0)
    value = sign * kept * F.pow(F.lit(16.0), (lead % 128 - 64).cast("double")) / F.lit(float(1 << 56))
    missing = (lead == 0x2E) | (lead == 0x5F) | lead.between(0x41, 0x5A)
    zero = F.when(missing, F.lit(None).cast("double")).when(lead == 0, F.lit(0.0)).when(lead == 128, F.lit(-0.0)).otherwise(F.raise_error(F.concat(F.lit("zero mantissa under lead byte "), lead.cast("string"))).cast("double"))
    return F.when(raw.isNull(), F.lit(None).cast("double")).when(m == 0, zero).otherwise(value)


def missing_tag(raw: Column) -> Column:
    """The tag of a missing value (``.``, ``_``, A to Z), else null."""
    digits = F.hex(raw)
    lead = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
    tag = (lead == 0x2E) | (lead == 0x5F) | lead.between(0x41, 0x5A)
    return F.when(tag & F.substring(digits, 3, 14).rlike("^0*$"), F.chr(lead))
