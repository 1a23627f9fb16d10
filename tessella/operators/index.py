"""The chunk index: effective blobs, holders, the canonical holder of each chunk, merging and lookup.

All of it is declarative: anti-joins for what is superseded or gone, one hash aggregation with a partial step on the map side for
the canonical holder (so a chunk that a third of all packs hold is one row for each task before it is shuffled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More effective blobs than this are worth rewriting into one.
COMPACT_ABOVE = 64


def superseded(blobs: DataFrame) -> DataFrame:
    """(blob): every id that some blob supersedes."""
    return blobs.select(F.explode("supersedes").alias("blob")).distinct()


def effective_blobs(blobs: DataFrame) -> DataFrame:
    return blobs.join(superseded(blobs), "blob", "left_anti")


def holders(blobs: DataFrame) -> DataFrame:
    """(blob, pack, size, chunk, offset, length, raw_len) of all effective blobs; a chunk may have many."""
    packs = effective_blobs(blobs).select("blob", F.explode("packs").alias("p"))
    return packs.select("blob", "p.pack", "p.size", F.explode("p.entries").alias("e")).select("blob", "pack", "size", "e.*")


def phantom_packs(held: DataFrame, listed: DataFrame) -> DataFrame:
    """(pack): indexed, but not in the listing."""
    return held.select("pack").distinct().join(listed.select("pack"), "pack", "left_anti")


def canonical_holders(held: DataFrame, marks: DataFrame | None = None, phantoms: DataFrame | None = None) -> DataFrame:
    """(chunk, pack, offset, length, ...): of a chunk's holders the one in an unmarked pack, then of the smallest pack id, then offset.

    ``marks`` (id) and ``phantoms`` (pack) are joined by pack; the choice doesn't depend on the order of rows.
    """
    rest = [c for c in held.columns if c not in ("chunk", "pack", "offset")]
    out = held
    if phantoms is not None:
        out = out.join(phantoms.select("pack"), "pack", "left_anti")
    if marks is not None:
        out = out.join(marks.select(F.col("id").alias("pack"), F.lit(True).alias("__marked")).distinct(), "pack", "left")
    else:
        out = out.withColumn("__marked", F.lit(None).cast("boolean"))
    best = F.min(F.struct(F.coalesce("__marked", F.lit(False)).alias("marked"), "pack", "offset", *rest)).alias("b")
    return out.groupBy("chunk").agg(best).select("chunk", "b.pack", "b.offset", *[f"b.{c}" for c in rest])


def merge_new_wins(old: DataFrame, new: DataFrame, key: str = "chunk") -> DataFrame:
    """The records of both, one for each key; where both have one, the new one."""
    a, b = old.alias("old"), new.alias("new")
    cols = [c for c in old.columns if c != key]
    has_new = F.col(f"new.{key}").isNotNull()
    picked = [F.when(has_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in cols]
    return a.join(b, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(F.coalesce(f"new.{key}", f"old.{key}").alias(key), *picked)


def resolve_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """``chunks`` with the index's columns, null where the chunk isn't known (which is what a backup has to store)."""
    return chunks.join(index, "chunk", "left")


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return chunks.join(index.select("chunk").distinct(), "chunk", "left_anti")


def distinct_chunks(held: DataFrame) -> DataFrame:
    return held.agg(F.count_distinct("chunk").alias("chunks"))


def compaction_due(blobs: DataFrame, limit: int = COMPACT_ABOVE) -> DataFrame:
    return effective_blobs(blobs).agg(F.count("*").alias("effective")).select("effective", (F.col("effective") > limit).alias("due"))


def rebuild_index(pack_entries: DataFrame, existing: DataFrame, sizes: DataFrame | None = None):
    """(entries, supersedes): what one new blob would hold, and the ids of all blobs that it replaces."""
    entries = pack_entries.select("pack", "chunk", "offset", "length", "raw_len")
    return entries, existing.select("blob").distinct()


def rebuild_summary(pack_entries: DataFrame, existing: DataFrame) -> DataFrame:
    entries, old = rebuild_index(pack_entries, existing)
    zero = F.lit(0).cast("bigint")
    counted = entries.agg(F.count_distinct("pack").alias("packs"), F.count("*").alias("chunks")).withColumn("superseded", zero)
    both = counted.unionByName(old.agg(F.count("*").alias("superseded")).select(zero.alias("packs"), zero.alias("chunks"), "superseded"))
    return both.agg(*[F.sum(c).alias(c) for c in ("packs", "chunks", "superseded")])
