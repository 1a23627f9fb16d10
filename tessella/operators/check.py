"""Consistency checks. Each returns findings (severity, code, id, detail); ``check`` is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The smallest and largest sealed chunk.
MIN_LENGTH, MAX_LENGTH = 41, (64 << 20) + 41
FIRST_OFFSET = 8


def _finding(severity: str, code, ident: Column, detail: Column | None = None) -> list[Column]:
    code = F.lit(code) if isinstance(code, str) else code
    return [F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), code.alias("code"), ident.cast("string").alias("id"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")]


def packs(indexed: DataFrame, listed: DataFrame) -> DataFrame:
    """Indexed packs (pack, size) against the listing (pack, size): missing, size differs, or listed and not indexed (a warning)."""
    a, b = indexed.select("pack", F.col("size").alias("want")), listed.select(F.col("pack").alias("there"), F.col("size").alias("got"))
    both = a.join(b, F.col("pack") == F.col("there"), "full_outer")
    code = F.when(F.col("there").isNull(), "missing").when(F.col("pack").isNull(), "unreferenced").when(F.col("want") != F.col("got"), "size")
    severity = F.when(F.col("pack").isNull(), "warning").otherwise("error")
    return both.where(code.isNotNull()).select(*_finding(severity, code, F.coalesce("pack", "there"), F.concat_ws("/", F.col("want").cast("string"), F.col("got").cast("string"))))


def trailers(entries: DataFrame, indexed: DataFrame) -> DataFrame:
    """A pack's own entries (pack, chunk, offset, length) against the index's: another place, extra or missing.
    An entry that the index has in another pack is no error."""
    key = ["pack", "chunk"]
    a = entries.select(*key, F.struct("offset", "length").alias("own"))
    b = indexed.select(*key, F.struct("offset", "length").alias("said"))
    both = a.join(b, key, "full_outer")
    known = indexed.select("chunk").distinct().withColumn("__known", F.lit(True))
    both = both.join(known, "chunk", "left")
    code = F.when(F.col("own").isNull(), "missing entry").when(F.col("said").isNull() & F.col("__known").isNull(), "extra entry").when(F.col("own") != F.col("said"), "place differs")
    return both.where(code.isNotNull()).select(*_finding("error", code, F.col("pack"), F.col("chunk")))


def contiguity(entries: DataFrame, first: int = FIRST_OFFSET, low: int = MIN_LENGTH, high: int = MAX_LENGTH, end: DataFrame | None = None) -> DataFrame:
    """Entries lie end to end from ``first`` on, no chunk stands twice in a pack, lengths are within bounds, the last ends at ``end`` (pack, data_end)."""
    w = Window.partitionBy("pack").orderBy("offset", "chunk")
    out = entries.withColumn("__prev", F.lag(F.col("offset") + F.col("length")).over(w)).withColumn("__times", F.count("*").over(Window.partitionBy("pack", "chunk")))
    code = (
        F.when(F.coalesce("__prev", F.lit(first)) != F.col("offset"), "gap")
        .when(F.col("__times") > 1, "chunk twice")
        .when(~F.col("length").between(low, high), "length")
    )
    found = out.where(code.isNotNull()).select(*_finding("error", code, F.col("pack"), F.col("chunk")))
    if end is not None:
        last = entries.groupBy("pack").agg(F.max(F.col("offset") + F.col("length")).alias("stop")).join(end, "pack")
        found = found.unionByName(last.where("stop <> data_end").select(*_finding("error", "end", F.col("pack"), F.col("stop"))))
    return found


def strictly_increasing(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows (in ``order``) whose ``name`` isn't above that of the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__before", F.lag(name).over(w)).where(F.col("__before") >= F.col(name)).drop("__before")


def file_sizes(files: DataFrame, refs: DataFrame, index: DataFrame) -> DataFrame:
    """(file, size, total) where the sizes of all of a file's chunks are known and don't add up. ``refs`` (file, chunk), ``index`` (chunk, raw_len)."""
    sums = refs.join(index.select("chunk", "raw_len"), "chunk", "left").groupBy("file").agg(F.sum("raw_len").alias("total"), F.bool_and(F.col("raw_len").isNotNull()).alias("known"))
    out = files.join(sums, "file", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("bigint"))
    return out.where(F.coalesce("known", F.lit(True)) & (F.col("size") != F.col("total"))).select("file", "size", "total")


def missing_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.select("chunk").distinct().join(index.select("chunk"), "chunk", "left_anti").select(*_finding("error", "missing chunk", F.col("chunk")))


def entry_problem() -> Column:
    """A tree entry's first problem, or null: which fields each kind of node and of metadata has and hasn't."""
    c = F.col
    has = lambda *names: reduce(lambda a, b: a | b, [c(n).isNotNull() for n in names])
    lacks = lambda *names: reduce(lambda a, b: a | b, [c(n).isNull() for n in names])
    kind, meta = c("t"), c("mk")
    return (
        F.when(c("n").isNull() | (F.octet_length("n") == 0) | c("n").cast("string").isin(".", "..") | c("n").cast("string").contains("/") | (F.instr(F.hex("n"), "00") % 2 == 1), "name")
        .when(~kind.isin(0, 1, 2), "type")
        .when((kind == 0) & has("target", "subtree"), "file with a target or subtree")
        .when((kind == 0) & lacks("size"), "file without a size")
        .when((kind == 1) & (c("subtree").isNull() | has("target", "chunks")), "directory")
        .when((kind == 2) & (F.coalesce(F.octet_length("target"), F.lit(0)) == 0), "symlink without a target")
        .when((kind == 2) & has("subtree", "chunks"), "symlink")
        .when((kind == 0) & (c("ct") == 0) & (F.size("chunks") > 256), "too many direct chunks")
        .when((meta == 0) & (lacks("mode", "uid", "gid", "mtime_ns") | has("etag", "vern")), "posix metadata")
        .when((meta == 1) & (lacks("mtime_ns") | has("ctime_ns", "dev", "ino", "nlink", "xattrs", "etag", "vern")), "sftp metadata")
        .when((meta == 2) & has("mode", "uid", "gid", "ctime_ns", "dev", "ino", "nlink", "xattrs"), "s3 metadata")
        .when((meta == 2) & ((F.coalesce(F.octet_length("etag"), F.lit(0)) > 1024) | (F.coalesce(F.octet_length("vern"), F.lit(0)) > 1024)), "s3 metadata too long")
        .when((meta == 3) & has("mode", "uid", "gid", "ctime_ns", "dev", "ino", "nlink", "xattrs", "etag", "vern"), "generic metadata")
        .when(~meta.isin(0, 1, 2, 3), "metadata kind")
    )


def regular_file() -> Column:
    """POSIX mode says regular file; without a mode it isn't known to be anything else."""
    return F.coalesce(F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o100000, F.lit(True))


def check(indexed_packs: DataFrame, listed: DataFrame, refs: DataFrame, index: DataFrame, files: DataFrame, file_refs: DataFrame) -> DataFrame:
    sizes = file_sizes(files, file_refs, index)
    return (packs(indexed_packs, listed).unionByName(missing_chunks(refs, index))
            .unionByName(sizes.select(*_finding("error", "file size", F.col("file"), F.concat_ws("/", F.col("size").cast("string"), F.col("total").cast("string"))))))


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"))
