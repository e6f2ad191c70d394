"""SAS encoding ids and the character sets they stand for."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession

#: Character set by encoding id.
CHARSETS = {
    0x14: "UTF-8", 0x1C: "US-ASCII", 0x1D: "ISO-8859-1", 0x1E: "ISO-8859-2", 0x1F: "ISO-8859-3", 0x20: "ISO-8859-4", 0x21: "ISO-8859-5",
    0x22: "ISO-8859-6", 0x23: "ISO-8859-7", 0x24: "ISO-8859-8", 0x25: "ISO-8859-9", 0x27: "x-iso-8859-11", 0x28: "ISO-8859-15", 0x2B: "IBM437",
    0x2C: "IBM850", 0x2D: "IBM852", 0x2E: "IBM00858", 0x2F: "IBM862", 0x33: "IBM866", 0x3A: "IBM857", 0x3C: "windows-1250", 0x3D: "windows-1251",
    0x3E: "windows-1252", 0x3F: "windows-1253", 0x40: "windows-1254", 0x41: "windows-1255", 0x42: "windows-1256", 0x43: "windows-1257",
    0x44: "windows-1258", 0x45: "x-MacRoman", 0x46: "x-MacArabic", 0x47: "x-MacHebrew", 0x48: "x-MacGreek", 0x49: "x-MacThai", 0x4B: "x-MacTurkish",
    0x4C: "x-MacUkraine", 0x4E: "IBM037", 0x57: "IBM424", 0x58: "IBM500", 0x59: "IBM-Thai", 0x5A: "IBM870", 0x5B: "x-IBM875", 0x5F: "x-IBM1025",
    0x62: "x-IBM1112", 0x63: "x-IBM1122", 0x66: "IBM424", 0x67: "IBM-Thai", 0x68: "IBM870", 0x69: "x-IBM875", 0x6C: "x-IBM1025", 0x6D: "IBM1026",
    0x6E: "IBM1047", 0x6F: "x-IBM1112", 0x70: "x-IBM1122", 0x75: "x-IBM937", 0x76: "x-windows-950", 0x77: "x-EUC-TW", 0x7B: "Big5", 0x7C: "x-IBM935",
    0x7D: "GBK", 0x7E: "x-mswin-936", 0x80: "x-IBM1381", 0x81: "x-IBM939", 0x82: "x-IBM930", 0x86: "EUC-JP", 0x88: "x-windows-iso2022jp",
    0x89: "x-IBM942", 0x8A: "Shift_JIS", 0x8B: "x-IBM933", 0x8C: "EUC-KR", 0x8D: "x-windows-949", 0x8E: "x-IBM949", 0xA3: "x-MacIceland",
    0xA7: "ISO-2022-JP", 0xA8: "ISO-2022-KR", 0xA9: "x-ISO2022-CN-GB", 0xAC: "x-ISO2022-CN-CNS", 0xAD: "IBM037", 0xB7: "IBM01140", 0xB8: "IBM01141",
    0xB9: "IBM01142", 0xBA: "IBM01143", 0xBB: "IBM01144", 0xBC: "IBM01145", 0xBD: "IBM01146", 0xBE: "IBM01147", 0xBF: "IBM01148", 0xC0: "IBM01140",
    0xC1: "IBM01141", 0xC2: "IBM01142", 0xC3: "IBM01143", 0xC4: "IBM01144", 0xC5: "IBM01145", 0xC6: "IBM01146", 0xC7: "IBM01147", 0xC8: "IBM01148",
    0xCD: "GB18030", 0xCF: "x-IBM1097", 0xD0: "x-IBM1097", 0xD3: "IBM01149", 0xD4: "IBM01149", 0xEA: "x-IBM930", 0xEB: "x-IBM933", 0xEC: "x-IBM935",
    0xED: "x-IBM937", 0xEE: "x-IBM939", 0xF2: "ISO-8859-13", 0xF5: "x-MacCroatian", 0xF6: "x-MacCyrillic", 0xF7: "x-MacRomania", 0xF8: "JIS_X0201",
}

#: Python's names where renaming by rule does not find them.
PYTHON_NAMES = {"x-MacRomania": "mac_romanian", "x-mswin-936": "cp936", "x-windows-949": "cp949", "x-windows-950": "cp950", "x-windows-iso2022jp": "iso2022_jp", "x-MacUkraine": "mac_cyrillic", "IBM00858": "cp858"}


def signed(code: int) -> int:
    """The id as a signed byte."""
    return code - 256 if code > 127 else code


def charset_of(code: int) -> str | None:
    """Character set of an encoding id (signed or unsigned)."""
    return CHARSETS.get(code & 0xFF)


def code_of(name: str) -> int | None:
    """Encoding id of a character set in any case; of several the least as a signed byte."""
    found = [c for c, n in CHARSETS.items() if n.lower() == name.lower()]
    return min(found, key=signed) if found else None


def python_codec(name: str) -> str:
    """Python's codec of a character set; one that Python does not have is an error, never another set."""
    low = name.lower()
    for candidate in (PYTHON_NAMES.get(name), name, low.removeprefix("x-"), low.removeprefix("x-").replace("mac", "mac_", 1), low.replace("x-ibm", "cp").replace("ibm0", "cp").replace("ibm", "cp"), low.replace("ibm0", "cp").replace("x-iso-", "iso-")):
        if candidate:
            try:
                return codecs.lookup(candidate).name
            except LookupError:
                continue
    raise LookupError(f"no codec for character set {name!r}")


def encodings(spark: SparkSession) -> DataFrame:
    """(code, charset, preferred): preferred marks the id that a name maps back to."""
    rows = [(c, n, code_of(n) == c) for c, n in CHARSETS.items()]
    return spark.createDataFrame(rows, "code int, charset string, preferred boolean")
