"""Run-length compression of SAS7BDAT rows (SASYZCRL)."""

from __future__ import annotations


def decompress(data: bytes, length: int) -> bytes:
    """The row of ``length`` bytes that data stands for; a stream that makes more or less is an error."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        op, low = data[at] >> 4, data[at] & 15
        at += 1
        if op in (2, 3):
            raise ValueError(f"reserved RLE control byte at {at - 1}")
        if op in (0, 1, 4, 5, 6, 7):
            if at >= end:
                raise ValueError("RLE stream ends in a control byte")
            wide, at = low * 256 + data[at], at + 1
        if op < 2 or 8 <= op <= 11:  # literal bytes
            n = wide + 64 + 4096 * op if op < 2 else low + 1 + 16 * (op - 8)
            if at + n > end:
                raise ValueError("RLE literal reaches beyond its stream")
            out += data[at : at + n]
            at += n
        elif op in (4, 12):  # a byte repeated
            if at >= end:
                raise ValueError("RLE run without its byte")
            out += data[at : at + 1] * (wide + 18 if op == 4 else low + 3)
            at += 1
        else:  # 40, 20 or 00 repeated
            fill = (b"@", b" ", b"\0")[op - 5 if op < 8 else op - 13]
            out += fill * (wide + 17 if op < 8 else low + 2)
    if len(out) != length:
        raise ValueError(f"RLE row of {len(out)} bytes, {length} expected")
    return bytes(out)
