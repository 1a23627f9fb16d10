"""What a backup leaves out: patterns, sizes, marker files, other file systems; and what is named by itself and so never left out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import PathFilter, prefixes

#: The first bytes of a cache directory's tag file.
CACHE_TAG, CACHE_SIGNATURE = "CACHEDIR.TAG", b"Signature: 8a477f597d28d172789f06886806bc55"


@dataclass
class Rules:
    patterns: list[str] = field(default_factory=list)
    fold: list[str] = field(default_factory=list)
    larger_than: int | None = None
    #: Marker file names, each with the bytes that its content must begin with (empty: any).
    markers: dict[str, bytes] = field(default_factory=dict)
    one_file_system: bool = False


def marked_directories(entries: DataFrame, markers: dict[str, bytes]) -> DataFrame:
    """(dir, marker): directories with a file of a marker's name whose ``head`` begins as the marker says; a head that can't be read is no marker."""
    hit = F.lit(False)
    for name, head in markers.items():
        hit = hit | ((F.col("name") == name) & (F.lit(True) if not head else F.coalesce(F.substring("head", 1, len(head)) == F.lit(bytearray(head)), F.lit(False))))
    return entries.where((F.col("kind") == "file") & hit).select("dir", F.col("name").alias("marker")).distinct()


def own_reason(entries: DataFrame, rules: Rules, named: DataFrame | None = None) -> DataFrame:
    """``entries`` (path, dir, name, kind, size, dev, head, root_dev) with ``reason``: why this very entry is left out, or null."""
    out = entries
    if rules.markers:
        found = marked_directories(entries, rules.markers).groupBy("dir").agg(F.collect_set("marker").alias("__markers"))
        out = out.join(found, "dir", "left")
    else:
        out = out.withColumn("__markers", F.lit(None).cast("array<string>"))
    beside = F.col("__markers").isNotNull() & ~F.array_contains(F.coalesce("__markers", F.array().cast("array<string>")), F.col("name"))
    reason: Column = F.lit(None).cast("string")
    if rules.one_file_system:
        reason = F.when((F.col("kind") == "file") & (F.col("dev") != F.col("root_dev")), "other file system")
    if rules.markers:
        reason = F.coalesce(F.when(beside, "beside a marker"), reason)
    if rules.larger_than is not None:
        reason = F.coalesce(F.when((F.col("kind") == "file") & (F.col("size") > rules.larger_than), "too large"), reason)
    f = PathFilter(rules.patterns, rules.fold)
    if f.patterns:
        reason = F.coalesce(F.when(F.coalesce(f.decision(F.col("path")), F.lit(False)), "pattern"), reason)
    out = out.withColumn("reason", reason)
    if named is not None:
        out = out.join(named.select("path", F.lit(True).alias("__named")).distinct(), "path", "left").withColumn("reason", F.when(F.col("__named").isNull(), F.col("reason")))
    return out.select(*entries.columns, "reason")


def walk(entries: DataFrame, rules: Rules, named: DataFrame | None = None) -> DataFrame:
    """Entries with ``taken`` and ``topmost``. An excluded directory isn't entered, so nothing below it is taken or counted; ``topmost`` marks what
    counts as excluded. A directory on another file system is kept, but what lies in it isn't."""
    own = own_reason(entries, rules, named)
    stop = own.where((F.col("kind") == "dir") & F.col("reason").isNotNull()).select(F.col("path").alias("up"))
    if rules.one_file_system:
        stop = stop.union(own.where((F.col("kind") == "dir") & (F.col("dev") != F.col("root_dev"))).select(F.col("path").alias("up")))
    parts = prefixes(F.col("path"))
    above = own.select("path", F.explode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("up"))
    below = above.join(stop.distinct(), "up", "left_semi").select("path").distinct().withColumn("__below", F.lit(True))
    out = own.join(below, "path", "left")
    hidden = F.col("__below").isNotNull()
    return out.select(*entries.columns, "reason", (~hidden & F.col("reason").isNull()).alias("taken"), (~hidden & F.col("reason").isNotNull()).alias("topmost"))
