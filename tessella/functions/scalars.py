"""Scalar functions: hex ids, object keys, snapshot names, sizes, durations and display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def parse_id(text: Column) -> Column:
    """32 bytes from 64 hex digits, null for anything else."""
    return F.when(text.rlike(r"\A[0-9a-fA-F]{64}\z"), F.unhex(text))


def object_key(kind: Column, ident: Column) -> Column:
    """``<kind>/<hex id>``; packs lie one level deeper, by their first two digits."""
    return F.when(kind == "packs", F.concat(F.lit("packs/"), F.substring(ident, 1, 2), F.lit("/"), ident)).otherwise(F.concat(kind, F.lit("/"), ident))


def name_from_key(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def is_replica(key: Column) -> Column:
    return key.endswith(".r1")


def strip_replica(key: Column) -> Column:
    return F.regexp_replace(key, r"\.r1$", "")


def time_name(time_ns: Column) -> Column:
    """``YYYYMMDDTHHMMSSnnnnnnnnnZ`` in UTC (the session's time zone must be UTC)."""
    secs = _div(time_ns, 1_000_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(secs), "yyyyMMdd'T'HHmmss"), F.lpad(F.pmod(time_ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def _div(x: Column, by: int) -> Column:
    """Floor division that stays in whole numbers."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("bigint")


def parse_time_name(name: Column) -> Column:
    """Back to nanoseconds; null where the form is another."""
    secs = F.unix_timestamp(F.substring(name, 1, 15), "yyyyMMdd'T'HHmmss")
    return F.when(name.rlike(r"\A[0-9]{8}T[0-9]{6}[0-9]{9}Z\z"), secs * 1_000_000_000 + F.substring(name, 16, 9).cast("bigint"))


def snapshot_time(key: Column) -> Column:
    """The time part of ``snapshots/<client>/<time>``."""
    return name_from_key(strip_replica(key))


def snapshot_client(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -2)


def short_id(key: Column, digits: int = 8) -> Column:
    return F.concat(F.substring(snapshot_client(key), 1, digits), F.lit("/"), snapshot_time(key))


def lossy_text(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def human_bytes(n: Column, last: str = "PiB") -> Column:
    """Binary units with one decimal from a KiB on, as of a double; what is exactly a half goes to the even digit. Null stays null."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    units = units[: units.index(last) + 1]
    n = n.cast("bigint")
    # The double as a whole number; the largest ones would round to 2**63.
    d = F.least(n.cast("double"), F.lit(float(2**63 - 1024))).cast("bigint")
    out = F.when(n.isNotNull(), F.format_string("%d B", n))
    for k, u in enumerate(units[1:], 1):
        unit = 1024**k
        tenths = d.bitwiseAND(F.lit(unit - 1)) * 10
        digit, over = F.shiftright(tenths, 10 * k), tenths.bitwiseAND(F.lit(unit - 1))
        digit += ((over > unit // 2) | ((over == unit // 2) & (digit % 2 == 1))).cast("bigint")
        whole = F.shiftright(d, 10 * k) + (digit == 10).cast("bigint")
        out = F.when(n >= unit, F.format_string(f"%d.%d {u}", whole, digit % 10)).otherwise(out)
    return out


def below_percent(live: Column, total: Column, percent: int) -> Column:
    """live/total < percent, in whole numbers wide enough not to overflow; never for an empty total."""
    wide = "decimal(38,0)"
    return (total > 0) & (live.cast(wide) * 100 < total.cast(wide) * percent)


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_SIZES = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_duration(text: str) -> int:
    """Seconds from a whole number and one of s, m, h, d, w."""
    m = re.fullmatch(r"([0-9]+)([smhdw])", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    n = int(m[1]) * _UNITS[m[2]]
    if n >= 1 << 64:
        raise ValueError(f"duration too long: {text!r}")
    return n


def parse_size(text: str) -> int:
    """Bytes from a whole number and, if any, one of k, m, g, t (base 1024)."""
    m = re.fullmatch(r"([0-9]+)([kmgtKMGT]?)", text.strip())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    n = int(m[1]) * _SIZES[m[2].lower()]
    if n >= 1 << 64:
        raise ValueError(f"size too large: {text!r}")
    return n
