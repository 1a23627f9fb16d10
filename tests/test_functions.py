import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import scalars as S
from tessella.functions.cron import Schedule


def test_durations_and_sizes():
    assert [S.parse_duration(x) for x in ("5s", "2m", "3h", "1d", "2w")] == [5, 120, 10800, 86400, 1209600]
    assert [S.parse_size(x) for x in ("7", "1k", "2M", "3g", "1t")] == [7, 1024, 2 << 20, 3 << 30, 1 << 40]
    for bad in ("", "5", "1.5h", "h", "-1s", "99999999999999999999w"):
        with pytest.raises(ValueError):
            S.parse_duration(bad)
    for bad in ("", "k", "1p", "99999999999999999999t"):
        with pytest.raises(ValueError):
            S.parse_size(bad)


def test_schedules():
    at = datetime(2026, 1, 31, 23, 59, 30)
    assert Schedule("0 3 * * *").next_after(at) == datetime(2026, 2, 1, 3)
    assert Schedule("*/15 * * * *").next_after(datetime(2026, 1, 1, 0, 15)) == datetime(2026, 1, 1, 0, 30)
    assert Schedule("30 0 0 29 feb *").next_after(at) == datetime(2028, 2, 29, 0, 0, 30)
    assert Schedule("0 0 1 * mon").next_after(datetime(2026, 1, 1)) == datetime(2026, 1, 5)
    assert Schedule("0 0 30 2 *").next_after(at) is None
    for bad in ("* * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            Schedule(bad)


def test_scalars(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789,), (0,), (-1,)], "ns long")
    got = [tuple(r) for r in df.select(S.time_name(F.col("ns")), S.parse_time_name(S.time_name(F.col("ns")))).collect()]
    assert got == [("20231114T221320123456789Z", 1_700_000_000_123_456_789), ("19700101T000000000000000Z", 0), ("19691231T235959999999999Z", -1)]
    r = spark.sql("SELECT unhex(repeat('AB', 32)) AS i, 'snapshots/abcdef0123/20231114T221320123456789Z.r1' AS k, CAST(9e18 AS BIGINT) AS big")
    row = r.select(S.hex_id(F.col("i")), S.parse_id(S.hex_id(F.col("i"))) == F.col("i"), S.parse_id(F.lit("zz")), S.snapshot_time(F.col("k")), S.snapshot_client(F.col("k")), S.short_id(F.col("k"), 4),
                   S.below_percent(F.col("big"), F.col("big"), 50), S.below_percent(F.lit(0), F.lit(0), 50), S.object_key(F.lit("packs"), F.lit("abcd")), S.human_bytes(F.lit(1536)), S.lossy_text(F.unhex(F.lit("61FF")))).first()
    assert list(row) == ["ab" * 32, True, None, "20231114T221320123456789Z", "abcdef0123", "abcd/20231114T221320123456789Z", False, False, "packs/ab/abcd", "1.5 KiB", "a�"]


def test_sizes_round_as_printf_does(spark):
    near = int(4096.15 * 2**40)  # as a double a little below the half that its shortest digits show
    ns = [1023, 1024, 1280, 1792, 2047, 2**20 - 1, 1126 * 2**40 + 1, near, near * 37, 2**60 + 2**57 + 12345, 2**63 - 1]
    got = [list(r) for r in spark.createDataFrame([(n,) for n in ns], "n long").select(S.human_bytes(F.col("n"), "TiB"), S.human_bytes(F.col("n"))).collect()]
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]

    def plain(n, last):
        k = max(j for j in range(last + 1) if n >= 1024**j)
        return "%.1f %s" % (float(n) / 1024**k, units[k]) if k else f"{n} B"

    assert got == [[plain(n, 4), plain(n, 5)] for n in ns]


def _segment(p: str, s: str) -> bool:
    """A segment pattern against a name, by recursion."""
    if not p:
        return not s
    if p[0] == "*":
        return _segment(p[1:], s) or bool(s) and _segment(p, s[1:])
    if p[0] == "[":
        end = p.index("]", 2)
        body = p[1:end]
        neg = body[0] in "!^"
        body = body[1:] if neg else body
        members, i = set(), 0
        while i < len(body):
            if body[i + 1:i + 2] == "-" and i + 2 < len(body):
                members |= {chr(c) for c in range(ord(body[i]), ord(body[i + 2]) + 1)}
                i += 3
            else:
                members.add(body[i])
                i += 1
        return bool(s) and (s[0] in members) != neg and _segment(p[end + 1:], s[1:])
    if p[0] == "\\":
        return bool(s) and s[0] == p[1] and _segment(p[2:], s[1:])
    return bool(s) and (p[0] == "?" or p[0] == s[0]) and _segment(p[1:], s[1:])


def _matches(pattern: str, parts: list[str]) -> bool:
    body = pattern.removeprefix("!")
    anchored = body.startswith("/")
    want = body.strip("/").split("/")

    def go(w, x):
        if not w:
            return not x
        if w[0] == "**":
            return any(go(w[1:], x[k:]) for k in range(len(x) + 1))
        return bool(x) and _segment(w[0], x[0]) and go(w[1:], x[1:])

    return go(want, parts) if anchored else any(go(want, parts[k:]) for k in range(len(parts)))


SEGMENTS = st.lists(st.sampled_from(["a", "b", "ä", "Ä", "中", "*", "?", "[ab]", "[!a]", "[a-c]", "\\*", ".", "+"]), min_size=1, max_size=3).map("".join).filter(lambda s: s not in (".", "..") and "**" not in s)
PATTERNS = st.builds(lambda neg, anchor, segs: neg + anchor + "/".join(segs), st.sampled_from(["", "!"]), st.sampled_from(["", "/"]), st.lists(st.one_of(SEGMENTS, st.just("**")), min_size=1, max_size=3))
NAMES = st.lists(st.text("ab*äÄ中c.+", min_size=1, max_size=3), min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(PATTERNS, NAMES)
def test_patterns_against_recursion(pattern, parts):
    compiled = P.compile_pattern(pattern)
    got = re.compile(compiled.regex.replace(r"\z", r"\Z")).match("/" + "/".join(parts)) is not None
    assert got == _matches(pattern, parts)


def test_patterns_in_spark(spark):
    patterns = ["/a/**/c", "*.o", "!keep.o", "[!a]?", "b*"]
    names = ["/a/c", "/a/x/y/c", "/x.o", "/d/keep.o", "/d/keep.o/z", "/bc/q", "/ab", "/zz"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    f = P.PathFilter(patterns)
    got = {r["path"]: r["d"] for r in df.select("path", f.decision(F.col("path")).alias("d")).collect()}
    for n in names:
        want = None
        for p in patterns:
            if _matches(p, n[1:].split("/")):
                want = not p.startswith("!")
        assert got[n] == want
    for bad in ("", "!", "/", "a//b", "a/..", ".", "[a", "[z-a]", "a\\", "a**b"):
        with pytest.raises(P.PatternError):
            P.compile_pattern(bad)


def test_exclusion_inheritance_and_components(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/k/c",), ("/d",)], "path string")
    f = P.PathFilter(["/a", "!/a/k"])
    assert [r[0] for r in df.select(f.excluded(F.col("path"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(f.inherited(F.col("path"), False)).collect()] == [True, False, False]
    assert [r[0] for r in df.select(f.topmost_excluded(F.col("path"))).collect()] == [False, False, False]
    with pytest.raises(P.PatternError):
        P.select(F.col("path"), P.PathFilter(["!a"]), None)
    row = spark.sql("SELECT 's3://bucket//a/./../b' AS p").select(P.components(F.col("p")), *[P.valid_child_name(F.lit(x)) for x in ("a", "", "..", "a/b")]).first()
    assert list(row) == [["bucket", "a", "__parent__", "b"], True, False, False, False]
