import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import check, chunking, diff, gc, index, kernels, reach, restore, retention, snapshots, trees


def test_retention_against_a_loop(spark):
    r, rows = random.Random(1), []
    for g in range(12):
        for k in range(r.randint(1, 40)):
            rows.append((g * 1000 + k, g, datetime(2026, 1, 1) + timedelta(minutes=r.randint(0, 60 * 24 * 500))))
    policy = retention.Policy(last=3, within_seconds=7 * 86400, hourly=2, daily=3, weekly=2, monthly=4, yearly=2)
    df = spark.createDataFrame(rows, "key long, client long, ts timestamp")
    got = {x["key"]: x["reasons"] for x in retention.apply_policy(df, policy, ["client"]).collect()}
    names = {"hourly": lambda t: (t.date(), t.hour), "daily": lambda t: t.date(), "weekly": lambda t: t.isocalendar()[:2], "monthly": lambda t: (t.year, t.month), "yearly": lambda t: t.year}
    for g in range(12):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]), reverse=True)
        seen = {n: [] for n in names}
        for k, (key, _, t) in enumerate(own):
            want = (["last"] if k < 3 else []) + (["within"] if t >= own[0][2] - timedelta(days=7) else [])
            for n, f in names.items():
                if f(t) not in seen[n]:
                    seen[n].append(f(t))
                    if len(seen[n]) <= getattr(policy, n):
                        want.append(n)
            assert got[key] == want
    for bad in ({}, {"last": 0}, {"within_seconds": 0}):
        with pytest.raises(ValueError):
            retention.Policy(**bad)


def test_canonical_holder_against_a_loop(spark):
    r = random.Random(0x5EED)
    for _ in range(6):
        held = [(c, p, r.randint(0, 9), r.randint(1, 50)) for p in range(6) for c in range(30) if r.random() < 1 / 3 for _ in range(r.randint(1, 3))]
        marks, gone = {p for p in range(6) if r.random() < 1 / 3}, {p for p in range(6) if r.random() < 1 / 4}
        r.shuffle(held)
        df = spark.createDataFrame(held, "chunk long, pack long, offset long, length long")
        got = {x["chunk"]: (x["pack"], x["offset"]) for x in index.canonical_holders(df, spark.createDataFrame([(m,) for m in marks], "id long"), spark.createDataFrame([(g,) for g in gone], "pack long")).collect()}
        want = {}
        for c, p, o, _ in held:
            if p not in gone:
                want[c] = min(want.get(c, (True, 99, 99)), (p in marks, p, o))
        assert got == {c: w[1:] for c, w in want.items()}


def test_merge_and_blobs(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "chunk long, pack string, n long")
    new = spark.createDataFrame([(2, "b", None), (3, "b", 8)], "chunk long, pack string, n long")
    assert sorted(map(tuple, index.merge_new_wins(old, new).collect())) == [(1, "a", 5), (2, "b", None), (3, "b", 8)]
    blobs = spark.createDataFrame([(1, [("p", 9, [(7, 8, 50, 40)])], []), (2, [("q", 9, [(7, 8, 50, 40)])], [1]), (3, [], [99])], "blob long, packs array<struct<pack:string,size:long,entries:array<struct<chunk:long,offset:long,length:long,raw_len:long>>>>, supersedes array<long>")
    assert sorted(r["blob"] for r in index.effective_blobs(blobs).collect()) == [2, 3]
    assert [(r["pack"], r["chunk"]) for r in index.holders(blobs).collect()] == [("q", 7)]


def test_collection_never_deletes_what_a_snapshot_needs(spark):
    """Random rounds of backup, forget and collection: every chunk of every snapshot has a pack afterwards."""
    r, now = random.Random(7), datetime(2026, 1, 1)
    packs, snaps, marks, n = {}, {}, {}, 0  # pack: (chunks, modified); snapshot: (client, time, chunks)
    for _ in range(7):
        now += timedelta(hours=r.randint(1, 119))
        act = r.choice(["backup", "backup", "forget", "collect", "collect"])
        if act == "backup":
            want = {r.randint(0, 12) for _ in range(4)}
            good = {c for p, (cs, _) in packs.items() if p not in marks for c in cs}
            if want - good:
                packs[n] = (want - good, now)
                n += 1
            snaps[n + 1000] = (r.randint(0, 1), now, want)
            n += 1
        elif act == "forget" and snaps:
            snaps.pop(r.choice(list(snaps)))
        else:
            o = gc.Options(now=now)
            held = spark.createDataFrame([(c, p, c, 10) for p, (cs, _) in packs.items() for c in cs], "chunk long, pack long, offset long, length long")
            refs = spark.createDataFrame(sorted({(c,) for _, _, cs in snaps.values() for c in cs}), "chunk long")
            m = spark.createDataFrame(list(marks.items()), "id long, modified timestamp")
            live = gc.live_bytes(refs, held, m)
            listed = spark.createDataFrame([("pack", p, 10, t) for p, (_, t) in packs.items()], "kind string, id long, size long, modified timestamp")
            objects = listed.join(live, F.col("id") == F.col("pack"), "left").select("kind", "id", "size", "modified", (F.coalesce("live", F.lit(0)) > 0).alias("live"))
            s = spark.createDataFrame([(c, t) for c, t, _ in snaps.values()], "client long, ts timestamp")
            for a in gc.plan(objects, m, s, o).collect():
                if a["action"] == "delete":
                    packs.pop(a["id"])
                    marks.pop(a["id"])
                elif a["action"] == "unmark":
                    marks.pop(a["id"])
                else:
                    marks[a["id"]] = now
        there = {c for cs, _ in packs.values() for c in cs}
        assert all(cs <= there for _, _, cs in snaps.values())


def test_decisions_at_equal_times(spark):
    now = datetime(2026, 3, 1)
    o = gc.Options(now=now)
    grace = timedelta(seconds=o.grace_seconds)
    objects = spark.createDataFrame([("pack", 1, 5, now, False), ("tree", 2, 5, now - grace, False), ("pack", 3, 5, now, True), ("tree", 3, 1, now, False), ("pack", 5, 5, now - grace, False), ("pack", 6, 5, now - grace + timedelta(seconds=1), False), ("pack", 7, 5, now - 2 * grace, False)],
                                    "kind string, id long, size long, modified timestamp, live boolean")
    marks = spark.createDataFrame([(1, now - grace), (2, now - grace), (3, now), (4, now), (7, now - grace)], "id long, modified timestamp")
    none = spark.createDataFrame([], "client long, ts timestamp")
    touches = spark.createDataFrame([(7, now - grace)], "id long, modified timestamp")
    got = {r["id"]: r["decision"] for r in gc.mark_decisions(objects, marks, none, o, touches).collect()}
    assert got == {1: "delete", 2: "revive", 3: "revive", 4: "stale", 7: "revive"}
    early = spark.createDataFrame([(1, now - grace + timedelta(hours=1))], "client long, ts timestamp")
    assert {r["id"]: r["decision"] for r in gc.mark_decisions(objects, marks, early, o).collect()}[1] == "blocked"
    assert [r["id"] for r in gc.new_marks(objects, marks, o).collect()] == [5]


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 9), (4, 1)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["depth"]) for r in reach.reachable(roots, edges).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert {r["node"] for r in reach.reachable(roots, edges, keep=lambda f: f.where("node <> 2")).collect()} == {1, 3, 4, 5}
    with pytest.raises(reach.TooDeep):
        reach.reachable(roots, edges, max_depth=2)
    assert reach.reachable(roots.where("node < 0"), edges).count() == 0
    snap = spark.createDataFrame([([("/", 1)],)], "roots array<struct<path:string,tree:long>>")
    entries = spark.createDataFrame([(1, 2, [7, 8]), (2, None, [8, 9]), (3, None, [1]), (1, 4, None)], "tree long, subtree long, chunks array<long>")
    live, chunks, missing = reach.walk(snap, entries)
    assert {r["node"] for r in live.collect()} == {1, 2, 4} and {r["chunk"] for r in chunks.collect()} == {7, 8, 9} and [r["node"] for r in missing.collect()] == [4]


def test_entries(spark):
    cols = "n binary, t int, mk int, size long, target binary, ct int, chunks array<binary>, subtree binary, mode long, uid long, gid long, mtime_ns long, ctime_ns long, dev long, ino long, nlink long, xattrs map<binary,binary>, etag binary, vern binary"
    blank = {c.split()[0]: None for c in cols.replace("map<binary,binary>", "map").split(", ")}
    posix = {"mk": 0, "mode": 0o100644, "uid": 0, "gid": 0, "mtime_ns": 1}
    cases = [({"n": b"a", "t": 0, "size": 3, **posix}, None), ({"n": b"a", "t": 0, **posix}, "file without a size"), ({"n": b"..", "t": 0, "size": 3, **posix}, "name"), ({"n": b"a", "t": 1, **posix}, "directory"), ({"n": b"a", "t": 1, "subtree": b"x", **posix}, None),
             ({"n": b"a", "t": 2, "target": b"", **posix}, "symlink without a target"), ({"n": b"a", "t": 0, "size": 1, **posix, "uid": None}, "posix metadata"), ({"n": b"a", "t": 0, "size": 1, "mk": 2, "etag": b"e"}, None), ({"n": b"a", "t": 0, "size": 1, "mk": 2, "etag": b"e" * 1025}, "s3 metadata too long"), ({"n": b"a", "t": 0, "size": 1, "mk": 1}, "sftp metadata"), ({"n": b"a", "t": 7, "size": 1, "mk": 3}, "type")]
    df = spark.createDataFrame([tuple((blank | c).values()) for c, _ in cases], cols)
    assert [r[0] for r in df.select(check.entry_problem()).collect()] == [w for _, w in cases]


def test_reuse(spark):
    meta = "struct<mk:int,size:long,mtime_ns:long,ctime_ns:long,ino:long,etag:string>"
    rows = [((0, 5, 10, 11, 3, None), (0, 5, 10, 11, 3, None)), ((0, 5, 10, 11, 3, None), (0, 5, 10, None, None, None)), ((0, 5, 10, None, 3, None), (0, 5, 10, 11, 3, None)), ((0, 5, 100, 11, 3, None), (0, 5, 100, 11, 3, None)), ((2, 5, None, None, None, "e"), (2, 5, None, None, None, "e")), ((1, 5, 10, None, None, None), (1, 5, 10, None, None, None)), ((2, 5, 10, None, None, "e"), (0, 5, 10, None, None, None))]
    df = spark.createDataFrame(rows, f"cur {meta}, prev {meta}")
    assert [r[0] for r in df.select(diff.reusable("cur", "prev", F.lit(100), F.lit(True))).collect()] == [True, True, False, False, True, False, False]


def test_restore_plan(spark):
    e = spark.createDataFrame([("/a", "dir"), ("/a/b", "dir"), ("/a/b/x.txt", "file"), ("/a/y.log", "file"), ("/c", "dir"), ("/c/z.txt", "file")], "path string, kind string")
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(restore.plan(e, ["*.txt"])) == ["/a", "/a/b", "/a/b/x.txt", "/c", "/c/z.txt"]
    assert names(restore.plan(e, ["*.txt"], ["/c"])) == ["/a", "/a/b", "/a/b/x.txt"]
    assert names(restore.plan(e, subtree="/a/b")) == ["/a/b", "/a/b/x.txt"]
    for bad in ("/nowhere", "/a/y.log"):
        with pytest.raises(LookupError):
            restore.plan(e, subtree=bad)
    lists = spark.createDataFrame([("L", ["p", "q"])], "list string, chunks array<string>")
    files = spark.createDataFrame([("f", 1, ["L"]), ("g", 0, ["r", "s"])], "file string, content int, chunks array<string>")
    assert sorted(map(tuple, restore.chunk_lists(files, lists).collect())) == [("f", 0, "p"), ("f", 1, "q"), ("g", 0, "r"), ("g", 1, "s")]


def _slow_boundaries(data, low, average, high, table):
    bits = chunking.round_log2(average)
    strict, loose = (1 << (bits + 2)) - 1, (1 << max(0, bits - 2)) - 1
    out, start = [], 0
    while len(data) - start > low:
        stop, cut, h = min(start + high, len(data)), min(start + high, len(data)), 0
        for i in range(start + low, stop):
            h = ((h << 1) + int(table[data[i]])) & (2**64 - 1)
            if not h & (strict if i < min(start + average, stop) else loose):
                cut = i + 1
                break
        out.append(cut)
        start = cut
    return out + ([len(data)] if start < len(data) else [])


def test_chunking():
    r, table = random.Random(3), chunking.gear_table()
    for n in (0, 1, 64, 65, 1000, 30000):
        for data in (r.randbytes(n), bytes(n), b"abc" * (n // 3)):
            for sizes in ((64, 256, 1024), (16, 64, 256)):
                got = chunking.boundaries(data, *sizes)
                assert got == _slow_boundaries(data, *sizes, table)
                assert not data and not got or got[-1] == len(data)
    data = r.randbytes(20000)
    cut = lambda d: {d[a:b] for a, b in zip([0, *chunking.boundaries(d, 64, 256, 1024)], chunking.boundaries(d, 64, 256, 1024))}
    assert len(cut(data) & cut(b"some bytes in front" + data)) > 0.8 * len(cut(data))


def test_parity_and_compression():
    r = random.Random(5)
    for n in (0, 1, 15, 16, 17, 5000):
        data = r.randbytes(n)
        for m in (1, 2, 8):
            p = kernels.parity_of(data, m)
            assert kernels.repair_bytes(data, p) == data
            size = p["shard_len"]
            for _ in range(3):
                bad = bytearray(data)
                for k in r.sample(range(16), m):
                    bad[k * size:(k + 1) * size] = bytes(x ^ 1 for x in bad[k * size:(k + 1) * size])
                assert kernels.repair_bytes(bytes(bad), p) == data
        if n > 100:
            bad = bytes(x ^ 1 for x in data)
            with pytest.raises(ValueError):
                kernels.repair_bytes(bad, kernels.parity_of(data, 2))
    with pytest.raises(ValueError):
        kernels.parity_of(b"x", 9)
    assert kernels.compress_bytes(b"a" * 1000)[:1] == kernels.ZSTD and kernels.compress_bytes(r.randbytes(1000))[:1] == kernels.STORED
    assert kernels.decompress_bytes(kernels.compress_bytes(b"a" * 1000), 1000) == b"a" * 1000
    for bad in (kernels.compress_bytes(b"a" * 1000), b"\x07x", b""):
        with pytest.raises(ValueError):
            kernels.decompress_bytes(bad, 999)


def test_packs_are_filled(spark):
    df = spark.range(100).select(F.col("id").alias("chunk"), F.lit(30).cast("long").alias("length")).repartition(3)
    got = kernels.fill_packs(df, 100, ["chunk"]).groupBy("pack").agg(F.sum("length").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r["c"] for r in got) == 100 and all(r["n"] <= 120 for r in got) and sum(r["n"] < 100 for r in got) <= 3


def test_segments_and_chains(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("d"), "id")
    assert sorted(map(tuple, trees.segments(df, ["d"], ["id"], 5).where("d = 0").collect())) == [(0, 0, 5), (0, 1, 5), (0, 2, 0)]
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "segment string, prev string")
    heads = spark.createDataFrame([("t", "c")], "tree string, segment string")
    assert [r["segment"] for r in trees.flatten(chain, heads).orderBy("seg_no").collect()] == ["a", "b", "c"]
    with pytest.raises(RuntimeError):
        trees.flatten(chain.union(spark.createDataFrame([("x", "x")], "segment string, prev string")), spark.createDataFrame([("t", "x")], "tree string, segment string"), max_links=5)


def test_resolve(spark):
    s = spark.createDataFrame([("snapshots/c/2024a", "2024a", 1), ("snapshots/c/2024b", "2024b", 2)], "key string, name string, ts long")
    assert snapshots.resolve(s, "latest").endswith("b") and snapshots.resolve(s, "2024a").endswith("a") and snapshots.resolve(s, "c/2024b").endswith("b")
    for bad in ("2024", "1999"):
        with pytest.raises(LookupError):
            snapshots.resolve(s, bad)


def test_exclusion(spark):
    from tessella.operators import exclude

    rows = [("/a", "/", "a", "dir", 0, 1, None), ("/a/CACHEDIR.TAG", "/a", "CACHEDIR.TAG", "file", 50, 1, exclude.CACHE_SIGNATURE + b"\n"), ("/a/x", "/a", "x", "file", 5, 1, None), ("/a/sub", "/a", "sub", "dir", 0, 1, None), ("/a/sub/y", "/a/sub", "y", "file", 5, 1, None),
            ("/b", "/", "b", "dir", 0, 1, None), ("/b/CACHEDIR.TAG", "/b", "CACHEDIR.TAG", "file", 5, 1, b"no"), ("/b/big", "/b", "big", "file", 100, 1, None), ("/b/even", "/b", "even", "file", 99, 1, None), ("/mnt", "/", "mnt", "dir", 0, 2, None), ("/mnt/z", "/mnt", "z", "file", 1, 2, None), ("/b/named.o", "/b", "named.o", "file", 1, 1, None), ("/b/other.o", "/b", "other.o", "file", 1, 1, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, dir string, name string, kind string, size long, dev int, head binary, root_dev int")
    rules = exclude.Rules(patterns=["*.o"], larger_than=99, markers={exclude.CACHE_TAG: exclude.CACHE_SIGNATURE}, one_file_system=True)
    got = {r["path"]: (r["taken"], r["topmost"]) for r in exclude.walk(df, rules, spark.createDataFrame([("/b/named.o",)], "path string")).collect()}
    assert {p for p, (t, _) in got.items() if t} == {"/a", "/a/CACHEDIR.TAG", "/b", "/b/CACHEDIR.TAG", "/b/even", "/mnt", "/b/named.o"}
    assert {p for p, (_, t) in got.items() if t} == {"/a/x", "/a/sub", "/b/big", "/b/other.o"}


def test_rounded_logarithm_at_the_geometric_middle():
    from tessella.operators import chunking

    assert [chunking.round_log2(n) for n in (2, 3, 5, 6, 11, 12, 22, 23, 45, 46, 90, 91, 92681, 92682)] == [1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 16, 17]
