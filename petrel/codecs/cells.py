"""Character cells of fixed width to texts, in bulk."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PADDING = " \0"


@functools.cache
def _keeps_ascii(encoding: str) -> bool:
    """Whether bytes below 128 stand for themselves, alone and in any order."""
    ascii_bytes = bytes(range(128))
    try:
        return ascii_bytes.decode(encoding) == ascii_bytes.decode("ascii") and not encoding.startswith("iso2022")
    except UnicodeDecodeError:
        return False


def texts(cells: np.ndarray, encoding: str, trim: bool = True) -> pa.Array:
    """Decode rows of bytes; ``trim`` drops blanks and NULs at their ends.  ASCII and UTF-8 cells are cast without a loop."""
    n, width = cells.shape
    if n and width and (cells.max() < 128 and _keeps_ascii(encoding) or encoding == "utf-8"):
        raw = np.ascontiguousarray(cells)
        ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)) if n * width < 1 << 31 else None
        if ends is not None:
            found = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(raw)]).cast(pa.string())
            return pc.utf8_rtrim(found, characters=PADDING) if trim else found
    rows = [bytes(c) for c in cells]
    return pa.array([(c.rstrip(b" \0") if trim else c).decode(encoding) for c in rows], pa.string())
