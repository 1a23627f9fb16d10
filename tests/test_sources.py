import os

import pytest
from pyspark.sql.types import StructType

from tessella import schemas
from tessella.functions.paths import PatternError
from tessella.sources import lists, local, objects
from tessella.streaming.refresh import IndexTable


def test_locations():
    assert objects.parse_location("s3://b/x") == ("s3", "b/x") and objects.parse_location("/srv/x") == ("local", "/srv/x") and objects.parse_location("sftp://h/x") == ("sftp", "h/x")
    for bad in ("", "ftp://x", "s3://"):
        with pytest.raises(ValueError):
            objects.parse_location(bad)


def test_listing(spark, tmp_path):
    names = ["trees/" + "ab" * 32, "trees/" + "ab" * 32 + ".r1", "gc/" + "cd" * 32, "gc/bad", "snapshots/" + "ef" * 16 + "/20240101T000000000000000Z"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    listed = objects.listing(spark, str(tmp_path))
    assert {(r["key"], r["size"]) for r in listed.collect()} == {(n, len(n)) for n in names}
    good, bad = objects.objects(listed)
    assert sorted((r["kind"], r["replica"]) for r in good.collect()) == [("gc", False), ("trees", False), ("trees", True)]
    assert "gc/bad" in {r["key"] for r in bad.collect()}
    assert [r["name"] for r in objects.snapshot_keys(listed).collect()] == ["20240101T000000000000000Z"]


def test_replicas(spark):
    a = spark.sql("SELECT unhex(sha2('x', 256)) AS id, CAST('x' AS BINARY) AS content UNION ALL SELECT unhex(sha2('y', 256)), CAST('broken' AS BINARY)")
    b = spark.sql("SELECT unhex(sha2('y', 256)) AS id, CAST('y' AS BINARY) AS content UNION ALL SELECT unhex(sha2('z', 256)), CAST('no' AS BINARY)")
    got = {r["source"]: bytes(r["content"]) if r["content"] is not None else None for r in objects.with_replicas(a, b, digest=True).collect()}
    assert got == {"primary": b"x", "replica": b"y", "corrupt": None}


def test_local_tree(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f.txt").write_text("hello")
    (tmp_path / "top").write_text("x")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/in").write_text("x")
    os.symlink("top", tmp_path / "link")
    os.mkfifo(tmp_path / "d/pipe")
    local.register(spark)
    rows = spark.read.format("tessella_local").option("path", str(tmp_path)).option("prune", "skip").load().collect()
    got = {r["path"].removeprefix(str(tmp_path)): (r["t"], r["size"], r["problem"]) for r in rows}
    assert got["/d/e/f.txt"] == (0, 5, None) and got["/d"][0] == 1 and got["/link"][0] == 2 and got["/d/pipe"][2] == "not a regular file"
    assert "/skip" in got and "/skip/in" not in got
    one = spark.read.format("tessella_local").option("path", str(tmp_path / "top")).load().collect()
    assert [r["size"] for r in one] == [1]


def test_lists(spark, tmp_path):
    (tmp_path / "l").write_bytes("﻿a\r\n # c\n\n b \n".encode())
    names = lambda m: [r["name"] for r in lists.files_from(spark, str(tmp_path / "l"), m).collect()]
    assert names("plain") == ["a", "b"] and names("verbatim") == ["a", " # c", " b "]
    (tmp_path / "r").write_bytes(b"a\nb\0c\0")
    assert [r["name"] for r in lists.files_from(spark, str(tmp_path / "r"), "raw").collect()] == ["a\nb", "c"]
    assert [p.text for p in lists.patterns("# x\n*.o\n\n!k\n")] == ["*.o", "!k"]
    with pytest.raises(PatternError, match="line 2"):
        lists.patterns("a\n[b")
    assert lists.as_json(spark.sql("SELECT 1 AS a, unhex('AB') AS b, CAST(NULL AS INT) AS c")).first()[0] == '{"a":1,"b":"ab"}'


def _blob(spark, folder, ident, packs, supersedes=()):
    b = lambda k: bytes([k]) * 32
    row = (b(ident), [(b(p), 100, [(b(c), 8, 50, 40)]) for p, c in packs], [b(s) for s in supersedes])
    spark.createDataFrame([row], schemas.INDEX_BLOBS).coalesce(1).write.mode("append").parquet(folder)


def test_index_refresh(spark, tmp_path):
    blobs, table = str(tmp_path / "blobs"), IndexTable(spark, str(tmp_path / "index"))
    show = lambda: {(r["chunk"][0], r["pack"][0]) for r in table.read().collect()}
    _blob(spark, blobs, 1, [(10, 1), (10, 2)])
    table.refresh(blobs, str(tmp_path / "cp"))
    assert show() == {(1, 10), (2, 10)}
    _blob(spark, blobs, 2, [(11, 2), (11, 3)])
    table.refresh(blobs, str(tmp_path / "cp"))
    assert show() == {(1, 10), (2, 11), (3, 11)}
    _blob(spark, blobs, 3, [(12, 1)], supersedes=[1])
    table.refresh(blobs, str(tmp_path / "cp"))
    assert show() == {(1, 12), (2, 11), (3, 11)}
    before = table._version()
    table.refresh(blobs, str(tmp_path / "cp"))
    assert table._version() == before


def test_schemas(spark):
    for name in ("OBJECTS", "SNAPSHOTS", "TREE_ENTRIES", "PACK_ENTRIES", "INDEX_BLOBS", "MARKS", "PARITY", "JOBS"):
        assert StructType.fromDDL(getattr(schemas, name)).fieldNames()


def test_config():
    from tessella.sources import config

    c = config.load('[repository]\nlocation = "s3://b/x"\n[backup]\nsources = ["/srv"]\nexclude = ["*.o"]\nexclude_larger_than = "2m"\nschedule = "0 3 * * *"\n[forget]\nlast = 2\nwithin = "3d"\n[prune]\ngrace = "1d"\n')
    assert c.location == ("s3", "b/x") and c.larger_than == 2 << 20 and c.policy.within_seconds == 3 * 86400 and c.grace_seconds == 86400 and set(c.jobs) == {"backup"}
    for bad in ("[other]\nx = 1", "[backup]\nsources = []", '[repository]\nlocation = "s3://b"\n[backup]\nsources = ["a"]\ncolour = 1', '[repository]\nlocation = "s3://b"\n[backup]\nsources = ["a"]\nexclude = ["[a"]', '[repository]\nlocation = ""\n[backup]\nsources = ["a"]', '[repository]\nlocation = "s3://b"\n[backup]\nsources = ["a"]\n[forget]\nlast = 0'):
        with pytest.raises(config.ConfigError):
            config.load(bad)
    assert config.state_name("") == "cbf29ce484222325" and config.state_name("a") == "af63dc4c8601ec8c"


def test_pack_trailers(spark):
    body = b"x" * 30
    good, cut = body + b"t" * 5 + (30).to_bytes(8, "big") + (5).to_bytes(8, "big"), body + (30).to_bytes(8, "big") + (5).to_bytes(8, "big")
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(cut))], "key string, content binary")
    assert [(r["key"], int(r["trailer_offset"]), int(r["trailer_length"]), r["complete"]) for r in objects.pack_trailers(df).orderBy("key").collect()] == [("a", 30, 5, True), ("b", 30, 5, False)]


def test_lists_as_they_are_written_elsewhere(spark, tmp_path):
    """A mark only at the front, white space of any kind, line ends other than LF within names, and names that end wrongly."""
    (tmp_path / "l").write_bytes("﻿\t a　\n﻿b\nc d\x0be\x85\n".encode())
    names = lambda f, m: [r["name"] for r in lists.files_from(spark, str(tmp_path / f), m).collect()]
    assert names("l", "plain") == ["a", "﻿b", "c d\x0be"] and names("l", "verbatim") == ["\t a　", "﻿b", "c d\x0be\x85"]
    for k, bad in enumerate((b"a\0b", b"a\0\0b\0", b"\0")):
        (tmp_path / f"r{k}").write_bytes(bad)
        with pytest.raises(Exception, match="NUL|empty name"):
            names(f"r{k}", "raw")
    (tmp_path / "none").write_bytes(b"")
    assert names("none", "raw") == []
    assert [p.text for p in lists.patterns("a\x0bb\n c　\r\n")] == ["a\x0bb", "c"]


def test_locations_that_are_none():
    assert objects.parse_location("rclone:x") == ("local", "rclone:x")
    for bad in ("file:///x", "s3:///x", "rclone://"):
        with pytest.raises(ValueError):
            objects.parse_location(bad)


def test_vanished_blobs_take_their_entries_along(spark, tmp_path):
    import shutil

    blobs, kept, table = tmp_path / "blobs", tmp_path / "kept", IndexTable(spark, str(tmp_path / "index"))
    _blob(spark, str(blobs), 1, [(10, 1), (10, 2)])
    shutil.copytree(blobs, kept)
    _blob(spark, str(blobs), 2, [(11, 2), (11, 3)])
    every = lambda at: spark.read.schema(schemas.INDEX_BLOBS).parquet(str(at))
    table.merge(every(blobs), every(blobs))
    assert {r["chunk"][0] for r in table.read().collect()} == {1, 2, 3}
    none = every(blobs).limit(0)
    table.merge(none, every(kept))  # blob 2 is gone, and nothing new has come
    assert {(r["chunk"][0], r["pack"][0]) for r in table.read().collect()} == {(1, 10), (2, 10)}
    at = table._version()
    table.merge(none, every(kept))
    assert table._version() == at
