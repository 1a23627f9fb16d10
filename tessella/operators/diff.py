"""Change detection between the present entries and a parent snapshot's, reuse of unchanged files, and the counts of a backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["root", "path"]


def compare(current: DataFrame, previous: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, cur struct, prev struct): an outer join of the two listings, one shuffle for each side on the same key."""
    key = key or KEY
    a = current.select(*key, F.struct(*[c for c in current.columns if c not in key]).alias("cur"))
    b = previous.select(*key, F.struct(*[c for c in previous.columns if c not in key]).alias("prev"))
    return a.join(b, key, "full_outer")


def status(same: Column) -> Column:
    return F.when(F.col("prev").isNull(), "new").when(F.col("cur").isNull(), "removed").when(same, "same").otherwise("changed")


def unchanged(cur: str, prev: str, parent_start_ns: Column) -> Column:
    """POSIX fast path: size and mtime equal, ctime and inode equal where the parent has them, and all times before the parent began (what was
    written while it ran can't be told from what it read)."""
    c, p = lambda n: F.col(f"{cur}.{n}"), lambda n: F.col(f"{prev}.{n}")
    agrees = lambda n: p(n).isNull() | F.coalesce(c(n) == p(n), F.lit(False))
    return F.coalesce(
        (c("size") == p("size")) & (c("mtime_ns") == p("mtime_ns")) & agrees("ctime_ns") & agrees("ino")
        & (c("mtime_ns") < parent_start_ns) & (p("ctime_ns").isNull() | (c("ctime_ns") < parent_start_ns)), F.lit(False))


def reusable(cur: str, prev: str, parent_start_ns: Column, chunks_held: Column) -> Column:
    """By kind of metadata: POSIX as above, S3 by etag and size, others never; a change of kind never; and all chunks in unmarked packs."""
    c, p = lambda n: F.col(f"{cur}.{n}"), lambda n: F.col(f"{prev}.{n}")
    s3 = F.coalesce((c("etag") == p("etag")) & (c("size") == p("size")), F.lit(False))
    by_kind = F.when(c("mk") == 0, unchanged(cur, prev, parent_start_ns)).when(c("mk") == 2, s3).otherwise(F.lit(False))
    return F.coalesce((c("mk") == p("mk")) & by_kind & chunks_held, F.lit(False))


def chunks_held(refs: DataFrame, index: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, held): whether every chunk of each file is indexed in a pack without a mark."""
    good = index.join(marks.select(F.col("id").alias("pack")).distinct(), "pack", "left_anti").select("chunk").distinct().withColumn("__ok", F.lit(True))
    return refs.join(good, "chunk", "left").groupBy(*by).agg(F.bool_and(F.col("__ok").isNotNull()).alias("held"))


def snapshot_stats(entries: DataFrame) -> DataFrame:
    """One row (files, dirs, symlinks, bytes): names are counted each; of hard-linked files (nlink above 1) the bytes once for each (dev, ino).
    ``entries`` (t, dev, ino, nlink, size, root boolean)."""
    linked = (F.col("t") == 0) & (F.coalesce("nlink", F.lit(1)) > 1) & F.col("dev").isNotNull() & F.col("ino").isNotNull()
    # Links of one inode meet by an aggregation with a partial step; other files stay out of the shuffle by key.
    own = entries.where((F.col("t") == 0) & ~linked).agg(F.sum("size").alias("b"))
    once = entries.where(linked).groupBy("dev", "ino").agg(F.max("size").alias("size")).agg(F.sum("size").alias("b"))
    counts = entries.agg(F.count_if(F.col("t") == 0).alias("files"), F.count_if((F.col("t") == 1) & ~F.coalesce("root", F.lit(False))).alias("dirs"), F.count_if(F.col("t") == 2).alias("symlinks"))
    rows = counts.unionByName(own, allowMissingColumns=True).unionByName(once, allowMissingColumns=True)  # one row each
    return rows.agg(*[F.sum(c).alias(c) for c in ("files", "dirs", "symlinks")], F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"))


def hard_link_leaders(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries with ``leader``: the first path of the same inode, in ``order`` (its own path if it isn't linked)."""
    linked = (F.coalesce("nlink", F.lit(1)) > 1) & F.col("dev").isNotNull() & F.col("ino").isNotNull()
    lead = entries.where(linked).groupBy("dev", "ino").agg(F.min_by("path", F.struct(*order)).alias("__lead"))
    out = entries.join(lead, ["dev", "ino"], "left")
    return out.select(*entries.columns, F.when(linked, F.col("__lead")).otherwise(F.col("path")).alias("leader"))


def backup_report(rows: DataFrame) -> DataFrame:
    """One row of counters from chunk rows (new, reused, revived, raw_len): bytes stored are those of new chunks before compression."""
    return rows.agg(F.count_if("new").alias("chunks_new"), F.count_if("reused").alias("chunks_read"), F.count_if("revived").alias("packs_revived"),
                    F.coalesce(F.sum(F.when(F.col("new"), F.col("raw_len"))), F.lit(0)).cast("bigint").alias("bytes_stored"))


def kept_roots(roots: DataFrame) -> DataFrame:
    """Of (path) roots those that no other root contains: ancestors by equality on exploded prefixes."""
    from ..functions.paths import prefixes

    above = F.slice(prefixes(F.col("path")), 1, F.greatest(F.size(prefixes(F.col("path"))) - 1, F.lit(0)))
    nested = roots.select("path", F.explode(above).alias("up")).join(roots.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return roots.select("path").distinct().join(nested, "path", "left_anti")


def commit_gate(reused: DataFrame, packs: DataFrame, marks: DataFrame, now, grace_seconds: int) -> DataFrame:
    """(chunk, pack, why) of reused chunks whose pack is gone or whose mark has run out; rows forbid the commit. ``reused`` (chunk, pack)."""
    out = reused.join(packs.select("pack", F.lit(True).alias("__there")), "pack", "left").join(marks.select(F.col("id").alias("pack"), F.col("modified").alias("__mark")), "pack", "left")
    ended = F.col("__mark") + F.make_dt_interval(secs=F.lit(grace_seconds)) <= F.lit(now)
    why = F.when(F.col("__there").isNull(), "pack is gone").when(F.coalesce(ended, F.lit(False)), "mark has run out")
    return out.where(why.isNotNull()).select("chunk", "pack", why.alias("why"))


def beside_marker(entries: DataFrame, marker: str) -> DataFrame:
    """Entries with ``beside``: a file named ``marker`` stands in the same directory (the marker itself stays)."""
    dirs = entries.where(F.col("name") == marker).select("dir").distinct().withColumn("__m", F.lit(True))
    return entries.join(dirs, "dir", "left").select(*entries.columns, (F.col("__m").isNotNull() & (F.col("name") != marker)).alias("beside"))


def recent(rows: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The newest ``n`` rows of each group."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def commit_gate_trees(reached: DataFrame, marks: DataFrame, trees: DataFrame, touches: DataFrame) -> DataFrame:
    """(tree, why) of reached trees (node) that carry a mark and are gone, or weren't touched since; rows forbid the commit."""
    marked = reached.select(F.col("node").alias("id")).join(marks.groupBy("id").agg(F.max("modified").alias("marked")), "id")
    out = marked.join(trees.select("id", F.lit(True).alias("__there")).distinct(), "id", "left").join(touches.groupBy("id").agg(F.max("modified").alias("touched")), "id", "left")
    why = F.when(F.col("__there").isNull(), "tree is gone").when(F.coalesce(F.col("touched") < F.col("marked"), F.lit(True)), "not touched since its mark")
    return out.where(why.isNotNull()).select(F.col("id").alias("tree"), why.alias("why"))
