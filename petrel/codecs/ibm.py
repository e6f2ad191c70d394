"""IBM hexadecimal floats in bulk."""

from __future__ import annotations

import numpy as np

TAGS = frozenset(b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, which of them are missing, and lead bytes, of rows of one to eight bytes (n, width)."""
    n, width = raw.shape
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = raw
    bits = full.view(">u8").reshape(-1).astype(np.uint64)
    lead = full[:, 0]
    m = bits & np.uint64((1 << 56) - 1)
    cut = (m >= np.uint64(1 << 53)).astype(np.uint64) + (m >= np.uint64(1 << 54)) + (m >= np.uint64(1 << 55))
    value = np.ldexp(((m >> cut) << cut).astype(np.float64), 4 * ((lead & 0x7F).astype(np.int64) - 64) - 56)
    value = np.where(lead >= 0x80, -value, value)
    empty = m == 0
    missing = empty & np.isin(lead, list(TAGS))
    odd = empty & ~missing & (lead != 0) & (lead != 0x80)
    if odd.any():
        raise ValueError(f"zero mantissa under lead byte {int(lead[odd][0]):#04x}")
    return value, missing, lead


def encode(values: np.ndarray) -> np.ndarray:
    """Eight bytes of each value; NaN becomes the missing value ``.``."""
    out = np.zeros((len(values), 8), np.uint8)
    real = ~np.isnan(values)
    v = np.where(real, np.abs(values), 0.0)
    fraction, power = np.frexp(v)
    hexes = -(-power // 4)
    m = np.ldexp(fraction, power - 4 * hexes + 56).astype(np.uint64)
    m = np.where(v == 0, 0, m).astype(np.uint64)
    lead = np.where(v == 0, 0, hexes + 64).astype(np.uint64) | np.where(np.signbit(values) & real, 0x80, 0).astype(np.uint64)
    out[:] = (m | lead << np.uint64(56)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[~real] = [0x2E, 0, 0, 0, 0, 0, 0, 0]
    return out
