"""Connected components over a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round's links are a table in the shared folder, so lineage stays short and a lost executor costs one round at most. Nothing but
a count and a checksum of each round comes to the driver. Rounds grow with the logarithm of the largest component. A round is some eight
stages, and the driver keeps what it knows of each of their tasks; so links that are no more than ``ONE_TASK``, at the start or after a round, are
joined in one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links that one task joins: some 50 MB of its memory.
ONE_TASK = 400_000


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return root


def _at_once(batches):
    """All links of a table to the stars of its components."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(c) for c in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = stars(len(nodes), at[:len(a)], at[len(a):])
        tied = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["a", "b"])


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links(a, b)`` in any direction to (a, b): b is the smallest node of a's component; smallest nodes themselves have no row."""
    now = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _state(now)
    for _ in range(max_rounds):
        if seen["n"] <= ONE_TASK:
            out = written(now.select("a", "b").coalesce(1).mapInArrow(_at_once, "a long, b long"), "links")
            discard(now)
            return out
        both = _both_ways(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(lower, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        after = written(small.union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        state = _state(after)
        discard(now)
        now = after
        if state == seen:
            return now
        seen = state
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
