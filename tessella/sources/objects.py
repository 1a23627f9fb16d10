"""Object listings and repository tables: from any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S


def parse_location(text: str) -> tuple[str, str]:
    """(scheme, path): ``s3://``, ``sftp://``, ``rclone://`` or, without ``://``, a local path; an empty one, another scheme or no bucket or host is an error."""
    if not text:
        raise ValueError("an empty location")
    scheme, sep, rest = text.partition("://")
    if not sep:
        return "local", text
    if scheme not in ("s3", "sftp", "rclone"):
        raise ValueError(f"unknown scheme {scheme!r}")
    if not rest.partition("/")[0]:
        raise ValueError(f"nothing after {scheme}://")
    return scheme, rest


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(key, size, modified): metadata only, no content is read; times in whole seconds. Order is unspecified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/") + "/"
    key = F.substring_index(F.col("path"), base, -1)
    return files.select(key.alias("key"), F.col("length").alias("size"), F.date_trunc("second", "modificationTime").alias("modified"))


def objects(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, id, key, size, modified, replica) of well-formed keys ``<kind>/.../<64 hex digits>[.r1]``, and the other rows."""
    bare = S.strip_replica(F.col("key"))
    name = S.name_from_key(bare)
    ok = name.rlike(r"\A[0-9a-f]{64}\z")
    good = listed.where(ok).select(F.substring_index("key", "/", 1).alias("kind"), S.parse_id(name).alias("id"), "key", "size", "modified", S.is_replica(F.col("key")).alias("replica"))
    return good, listed.where(~ok)


def snapshot_keys(listed: DataFrame) -> DataFrame:
    """(key, client, name) of snapshots, replicas left out, by time and then key."""
    keys = listed.where(F.col("key").startswith("snapshots/") & ~S.is_replica(F.col("key")))
    return keys.select("key", S.snapshot_client(F.col("key")).alias("client"), S.snapshot_time(F.col("key")).alias("name")).orderBy("name", "key")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A model table with its fixed schema; nothing is inferred or merged."""
    return spark.read.schema(getattr(schemas, name.upper())).option("mergeSchema", "false").parquet(f"{path.rstrip('/')}/{name}")


def with_replicas(primary: DataFrame, replica: DataFrame, ident: str = "id", digest: bool = False) -> DataFrame:
    """(id, content, source): the primary's content, else the replica's. ``digest``: content must hash (SHA-256) to the id to count."""
    good = (lambda c: F.when(F.sha2(c, 256) == F.lower(F.hex(ident)), c)) if digest else (lambda c: c)
    both = primary.select(ident, F.col("content").alias("__a")).join(replica.select(ident, F.col("content").alias("__b")), ident, "full_outer")
    a, b = good(F.col("__a")), good(F.col("__b"))
    return both.select(ident, F.coalesce(a, b).alias("content"), F.when(a.isNotNull(), "primary").when(b.isNotNull(), "replica").otherwise("corrupt").alias("source"))


def pack_trailers(packs: DataFrame) -> DataFrame:
    """(key, trailer_offset, trailer_length, complete) from the last 16 bytes of each pack's content: offset and length, big-endian."""
    tail = F.expr("substring(content, length(content) - 15, 16)")
    number = lambda at: F.conv(F.hex(F.substring(tail, at, 8)), 16, 10).cast("decimal(20,0)")
    out = packs.select("key", number(1).alias("trailer_offset"), number(9).alias("trailer_length"), F.octet_length("content").alias("__n"))
    return out.select("key", "trailer_offset", "trailer_length", (F.col("trailer_offset") + F.col("trailer_length") + 16 == F.col("__n")).alias("complete"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Appends snapshot rows: the last write of a backup, and its commit."""
    df.write.mode("append").partitionBy("client").parquet(f"{path.rstrip('/')}/snapshots")
