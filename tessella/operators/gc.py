"""Two-phase garbage collection as a pure plan over (objects, marks, touches, snapshots, now).

An object nobody needs is marked first, and deleted only when its mark has aged by the grace period and every active client has made a newer
snapshot. Times are timestamps; ``now`` is always given. Of equal times, those win that keep data.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import below_percent
from .index import canonical_holders, phantom_packs

#: An id of several kinds counts as the first of these.
KINDS = ("pack", "tree", "index")


@dataclass(frozen=True)
class Options:
    now: datetime
    grace_seconds: int = 72 * 3600
    inactive_seconds: int = 30 * 86400
    skew_seconds: int = 3600
    repack_below_percent: int = 50


def _secs(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def live_bytes(refs: DataFrame, held: DataFrame, marks: DataFrame | None = None, phantoms: DataFrame | None = None) -> DataFrame:
    """(pack, live, total): total over the distinct chunks of a pack, live over the referenced chunks whose canonical pack it is.
    ``refs`` (chunk) is distinct."""
    usable = held.join(phantoms.select("pack"), "pack", "left_anti") if phantoms is not None else held
    once = usable.groupBy("pack", "chunk").agg(F.min(F.struct("offset", "length"))["length"].alias("length"))
    total = once.groupBy("pack").agg(F.sum("length").alias("total"))
    canonical = canonical_holders(usable, marks)
    live = canonical.join(refs.select("chunk"), "chunk", "left_semi").groupBy("pack").agg(F.sum("length").alias("live"))
    return total.join(live, "pack", "left").select("pack", F.coalesce("live", F.lit(0)).cast("bigint").alias("live"), F.col("total").cast("bigint").alias("total"))


def missing_refs(refs: DataFrame, held: DataFrame, phantoms: DataFrame) -> DataFrame:
    """(chunk): referenced, but no pack that exists holds it. A plan must not run while this has rows."""
    there = held.join(phantoms.select("pack"), "pack", "left_anti").select("chunk").distinct()
    return refs.select("chunk").distinct().join(there, "chunk", "left_anti")


def active_floor(snapshots: DataFrame, o: Options) -> DataFrame:
    """One row (floor): the earliest of the active clients' latest snapshots, less the allowed clock skew; null if none is active."""
    last = snapshots.groupBy("client").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts") >= F.lit(o.now) - _secs(o.inactive_seconds)).agg(F.min(F.col("ts") - _secs(o.skew_seconds)).alias("floor"))


def _floor_value(snapshots: DataFrame, o: Options) -> Column:
    return F.lit(active_floor(snapshots, o).first()["floor"])  # one value


def objects_once(objects: DataFrame) -> DataFrame:
    """(kind, id, size, modified, live) with one row for each id, of its first kind."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    first = F.min_by(F.struct("kind", "size", "modified", "live"), rank).alias("o")
    return objects.groupBy("id").agg(first).select("id", "o.*")


def mark_decisions(objects: DataFrame, marks: DataFrame, snapshots: DataFrame, o: Options, touches: DataFrame | None = None) -> DataFrame:
    """(id, kind, decision, size) for each mark: stale, revive, waiting, blocked or delete.

    ``objects``: (kind, id, size, modified, live). ``touches`` (id, modified) revive what would be deleted if not older than the mark.
    """
    mark = marks.select(F.col("id"), F.col("modified").alias("marked"))
    out = mark.join(objects_once(objects), "id", "left")
    revived = (F.col("modified") >= F.col("marked")) & (F.col("kind") == "tree")
    if touches is not None:
        last = touches.groupBy("id").agg(F.max("modified").alias("touched"))
        out = out.join(last, "id", "left")
        revived = revived | F.coalesce(F.col("touched") >= F.col("marked"), F.lit(False))
    floor = _floor_value(snapshots, o)
    decision = (
        F.when(F.col("kind").isNull(), "stale")
        .when(F.col("live"), "revive")
        .when(F.col("marked") + _secs(o.grace_seconds) > F.lit(o.now), "waiting")
        .when(F.coalesce(F.col("marked") >= floor, F.lit(False)), "blocked")
        .when(F.coalesce(revived, F.lit(False)), "revive")
        .otherwise("delete")
    )
    return out.select("id", "kind", decision.alias("decision"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def settled(modified: Column, o: Options) -> Column:
    """Old enough to be marked or repacked."""
    return modified + _secs(o.grace_seconds) <= F.lit(o.now)


def new_marks(objects: DataFrame, marks: DataFrame, o: Options) -> DataFrame:
    """(kind, id, size): not live, not marked yet, and older than the grace period."""
    idle = objects_once(objects).where(~F.col("live")).join(marks.select("id").distinct(), "id", "left_anti")
    return idle.where(settled(F.col("modified"), o)).select("kind", "id", "size")


def repack_candidates(packs: DataFrame, live: DataFrame, marks: DataFrame, o: Options) -> DataFrame:
    """(pack, live, total): listed, unmarked, settled packs of which less than the percentage is live, and something is."""
    if not o.repack_below_percent:
        return live.where(F.lit(False))
    out = live.where((F.col("live") > 0) & below_percent(F.col("live"), F.col("total"), o.repack_below_percent))
    old = packs.where(settled(F.col("modified"), o)).select("pack")
    return out.join(old, "pack", "left_semi").join(marks.select(F.col("id").alias("pack")).distinct(), "pack", "left_anti")


def orphans(parity: DataFrame, packs: DataFrame, touches: DataFrame, trees: DataFrame, replicas: DataFrame, live_trees: DataFrame) -> DataFrame:
    """(what, id): parity without its pack, a touch or a replica without its tree (a replica is only reported), a live tree without a replica."""
    def left(a, b, what):
        return a.select("id").distinct().join(b.select("id"), "id", "left_anti").select(F.lit(what).alias("what"), "id")

    return (left(parity, packs, "parity").unionByName(left(touches, trees, "touch")).unionByName(left(replicas, trees, "replica")).unionByName(left(live_trees, replicas, "unreplicated")))


def plan(objects: DataFrame, marks: DataFrame, snapshots: DataFrame, o: Options, touches: DataFrame | None = None) -> DataFrame:
    """(step, kind, id, action, size) in the order in which it is safe to carry out: deletions, then removal of marks, then new marks; each by kind and id."""
    decided = mark_decisions(objects, marks, snapshots, o, touches)
    step = F.when(F.col("action") == "delete", 1).when(F.col("action") == "unmark", 2).otherwise(3)
    acts = decided.where(F.col("decision").isin("delete", "stale", "revive")).select("kind", "id", F.when(F.col("decision") == "delete", "delete").otherwise("unmark").alias("action"), "size")
    fresh = new_marks(objects, marks, o).select("kind", "id", F.lit("mark").alias("action"), F.col("size").cast("bigint").alias("size"))
    return acts.unionByName(fresh).select(step.alias("step"), "kind", "id", "action", "size").orderBy("step", "kind", "id")


def report(actions: DataFrame) -> DataFrame:
    """(kind, action, n, bytes)."""
    return actions.groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))


__all__ = ["Options", "active_floor", "live_bytes", "mark_decisions", "missing_refs", "new_marks", "objects_once", "orphans", "phantom_packs", "plan", "repack_candidates", "report", "settled"]
