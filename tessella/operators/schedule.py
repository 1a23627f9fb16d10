"""Which job runs next, and what is remembered of the last runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of jobs due at one time the first of these runs first.
ORDER = ("backup", "forget", "prune")


def next_due(due: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(repo, job, at): of each repository's (job, at) the earliest, ties by ``order``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("job")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return due.groupBy("repo").agg(F.min(F.struct("at", rank.alias("rank"), "job")).alias("m")).select("repo", "m.job", "m.at")


def latest_state(states: DataFrame) -> DataFrame:
    """(repo, job, at): of appended states the latest of each."""
    return states.groupBy("repo", "job").agg(F.max("at").alias("at"))
