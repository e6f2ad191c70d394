"""Ross data compression of SAS7BDAT rows (SASYZCR2)."""

from __future__ import annotations


def decompress(data: bytes, length: int) -> bytes:
    """The row of ``length`` bytes that data stands for; a stream that makes more or less is an error."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        if at + 2 > end:
            break  # a lone filler byte
        bits, at = data[at] << 8 | data[at + 1], at + 2
        for k in range(15, -1, -1):
            if at >= end:
                break
            if not bits >> k & 1:
                out.append(data[at])
                at += 1
                continue
            command, count = data[at] >> 4, data[at] & 15
            need = {0: 2, 1: 3, 2: 3}.get(command, 2)
            if at + need > end:
                raise ValueError("RDC stream ends inside a command")
            if command == 0:
                out += data[at + 1 : at + 2] * (count + 3)
            elif command == 1:
                out += data[at + 2 : at + 3] * (count + (data[at + 1] << 4) + 19)
            else:
                back = count + 3 + (data[at + 1] << 4)
                n = data[at + 2] + 16 if command == 2 else command
                if back > len(out):
                    raise ValueError("RDC reference before the row")
                for _ in range(n):
                    out.append(out[-back])
            at += need
    if len(out) != length:
        raise ValueError(f"RDC row of {len(out)} bytes, {length} expected")
    return bytes(out)
