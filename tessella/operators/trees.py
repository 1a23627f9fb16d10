"""Directory trees: cutting long directories into segments, and putting the segments together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 10_000


def segments(entries: DataFrame, by: list[str], order: list[str], size: int = SEGMENT) -> DataFrame:
    """(by, segment, n): entries in order, ``size`` to a segment; an exact multiple is followed by an empty segment."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    numbered = entries.select(*by, F.floor((n - 1) / size).cast("bigint").alias("segment"))
    full = numbered.groupBy(*by, "segment").agg(F.count("*").alias("n"))
    last = full.groupBy(*by).agg(F.max(F.struct("segment", "n")).alias("m")).where(F.col("m.n") == size)
    return full.unionByName(last.select(*by, (F.col("m.segment") + 1).alias("segment"), F.lit(0).cast("bigint").alias("n")))


def flatten(segments_: DataFrame, heads: DataFrame, max_links: int = 10_000) -> DataFrame:
    """(tree, seg_no, segment): chains of (segment, prev) followed from each head (tree, segment), oldest first. A loop is an error."""
    chain = heads.select("tree", "segment", F.lit(0).alias("back"))
    front, step = chain, 0
    while True:
        front = front.join(segments_.where("prev is not null").select("segment", "prev"), "segment").select("tree", F.col("prev").alias("segment"), (F.col("back") + 1).alias("back"))
        if front.isEmpty():
            break
        step += 1
        if step > max_links:
            raise RuntimeError("a chain of segments doesn't end")
        chain = chain.unionByName(front)
    if not chain.groupBy("tree", "segment").count().where("count > 1").isEmpty():
        raise RuntimeError("a chain of segments has a loop")
    return chain.withColumn("seg_no", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("back").desc())) - 1).select("tree", "seg_no", "segment")
