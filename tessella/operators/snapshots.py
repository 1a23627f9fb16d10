"""Listing and naming snapshots: order, latest, pages, prefixes, and the parent of a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(snapshots: DataFrame, time: str = "ts", key: str = "key") -> DataFrame:
    return snapshots.orderBy(time, key)


def page(snapshots: DataFrame, offset: int, limit: int, time: str = "ts", key: str = "key") -> DataFrame:
    return listing(snapshots, time, key).offset(offset).limit(limit)


def latest(snapshots: DataFrame, by: list[str], time: str = "ts", key: str = "key") -> DataFrame:
    """(by, time, key) of the newest snapshot of each group; an aggregation, no window."""
    return snapshots.groupBy(*by).agg(F.max(F.struct(F.col(time), F.col(key))).alias("m")).select(*by, f"m.{time}", f"m.{key}")


def parents(roots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each (client, root_paths) to be backed up: the client's latest snapshot, if it has the same roots in the same order; null otherwise."""
    newest = snapshots.groupBy("client").agg(F.max(F.struct("ts", "key", "root_paths")).alias("m")).select("client", F.col("m.key").alias("parent"), F.col("m.root_paths").alias("__roots"))
    out = roots.join(newest, "client", "left")
    return out.select(*roots.columns, F.when(F.col("root_paths") == F.col("__roots"), F.col("parent")).alias("parent"))


def resolve_prefixes(names: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, matches, name, status): a time prefix names a snapshot if exactly one name begins with it.

    Equality on cut names, one round for each distinct length of a spec, so that no pairwise comparison is made.
    """
    lengths = [r["n"] for r in specs.select(F.length("spec").alias("n")).distinct().orderBy("n").collect()]  # at most the length of a name
    out = None
    for n in lengths:
        ours = specs.where(F.length("spec") == n)
        cut = names.groupBy(F.substring("name", 1, n).alias("spec")).agg(F.count("*").alias("matches"), F.min("name").alias("name"))
        got = ours.join(cut, "spec", "left")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = specs.select("spec", F.lit(None).cast("bigint").alias("matches"), F.lit(None).cast("string").alias("name"))
    n = F.coalesce("matches", F.lit(0)).cast("bigint")
    return out.select("spec", n.alias("matches"), F.when(n == 1, F.col("name")).alias("name"), F.when(n == 0, "not found").when(n == 1, "unique").otherwise("ambiguous").alias("status"))


def resolve(snapshots: DataFrame, spec: str, key: str = "key", name: str = "name", time: str = "ts") -> str:
    """The key that ``latest``, a full key, or a unique prefix of a name stands for."""
    if spec == "latest":
        row = snapshots.agg(F.max_by(key, F.struct(time, key)).alias("k")).first()
        if row["k"] is None:
            raise LookupError("no snapshots")
        return row["k"]
    found = snapshots.where((F.col(key) == spec) | F.col(key).endswith("/" + spec) | F.col(name).startswith(spec)).select(key).limit(2).collect()
    if not found:
        raise LookupError(f"no snapshot {spec!r}")
    if len(found) > 1:
        raise LookupError(f"{spec!r} names more than one snapshot")
    return found[0][0]
