"""Content-defined chunking (FastCDC with a gear hash) as a vectorised kernel.

A boundary lies where the low bits of a rolling hash are zero: more bits before the average length is reached (fewer cuts), fewer after. Only the last
``bits`` bytes can show in those bits, so the hash of every position is a sum of shifted table lookups, computed for the whole input at once. The gear
table comes from a rule (or is given); ids are SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gear_table(seed: bytes = b"tessella gear") -> np.ndarray:
    """256 numbers of 64 bits: the first eight bytes of SHA-256 over the seed and the index."""
    return np.array([int.from_bytes(hashlib.sha256(seed + bytes([k])).digest()[:8], "little") for k in range(256)], np.uint64)


def round_log2(n: int) -> int:
    """The binary logarithm of ``n``, rounded: the larger exponent from the geometric middle of two powers on."""
    low = n.bit_length() - 1
    return low + (n * n >= 1 << (2 * low + 1))


def boundaries(data: bytes, low: int, average: int, high: int, table: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of ``data``: each of ``low`` to ``high`` bytes but for the last."""
    if not 0 < low <= average <= high:
        raise ValueError("0 < min <= average <= max")
    table = gear_table() if table is None else table
    bits = round_log2(average)
    strict, loose = (1 << (bits + 2)) - 1, (1 << max(0, bits - 2)) - 1
    n, span = len(data), bits + 2
    if n <= low:
        return [n] if n else []
    gear = table[np.frombuffer(data, "u1")]
    rolled = np.zeros(n, np.uint64)
    for k in range(min(span, n)):  # rolled[i] sums the last `span` bytes up to i, each shifted by its age
        rolled[k:] += gear[:n - k] << np.uint64(k)
    zero_strict, zero_loose = np.flatnonzero((rolled & np.uint64(strict)) == 0), np.flatnonzero((rolled & np.uint64(loose)) == 0)
    out, start = [], 0
    while n - start > low:
        stop = min(start + high, n)
        cut = stop
        middle = min(start + average, stop)
        # The hash of a chunk begins at its minimum length, so the first `span` positions see fewer bytes than the table of sums holds.
        warm = min(start + low + span, stop)
        h = 0
        found = None
        for i in range(start + low, warm):
            h = ((h << 1) + int(gear[i])) & 0xFFFFFFFFFFFFFFFF
            if not h & (strict if i < middle else loose):
                found = i
                break
        if found is None:
            k = int(np.searchsorted(zero_strict, warm))
            if k < len(zero_strict) and zero_strict[k] < middle:
                found = int(zero_strict[k])
            else:
                k = int(np.searchsorted(zero_loose, max(warm, middle)))
                if k < len(zero_loose) and zero_loose[k] < stop:
                    found = int(zero_loose[k])
        if found is not None:
            cut = found + 1
        out.append(cut)
        start = cut
    if start < n:
        out.append(n)
    return out


def fastcdc(content: Column, low: int = 64, average: int = 256, high: int = 1024) -> Column:
    """array<struct<seq,offset,length,id>> of each row's bytes; null or empty content has no chunks."""
    table = gear_table()

    @F.pandas_udf("array<struct<seq:int,offset:bigint,length:bigint,id:binary>>")
    def run(column: pd.Series) -> pd.Series:
        def one(data):
            at, rows = 0, []
            for k, end in enumerate(boundaries(data or b"", low, average, high, table)):
                rows.append({"seq": k, "offset": at, "length": end - at, "id": hashlib.sha256(data[at:end]).digest()})
                at = end
            return rows

        return column.map(one)

    return run(content)
