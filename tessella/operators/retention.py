"""Which snapshots to keep: counts of the newest, a span of time, and calendar buckets, for each group of snapshots.

A group is a client and its root paths. Every rule is a window over the group in one order, newest first, so one shuffle and one sort
serve them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons in their order.
BUCKETS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


@dataclass(frozen=True)
class Policy:
    last: int | None = None
    within_seconds: int | None = None
    hourly: int | None = None
    daily: int | None = None
    weekly: int | None = None
    monthly: int | None = None
    yearly: int | None = None

    def __post_init__(self):
        given = {k: v for k, v in vars(self).items() if v is not None}
        if not given:
            raise ValueError("a policy keeps something")
        if bad := [k for k, v in given.items() if v <= 0]:
            raise ValueError(f"{', '.join(bad)}: must be above 0")


def apply_policy(snapshots: DataFrame, policy: Policy, group: list[str], time: str = "ts", key: str = "key") -> DataFrame:
    """``snapshots`` with ``reasons`` (array of the rules that keep it; empty: it goes). Newest first, ties by the larger key. Weeks begin on Monday, all in UTC."""
    newest = [F.col(time).desc(), F.col(key).desc()]
    over = Window.partitionBy(*group)
    out, reasons = snapshots, []

    def reason(name: str, holds: Column):
        reasons.append(F.when(holds, F.lit(name)))

    if policy.last:
        out = out.withColumn("__last", F.row_number().over(over.orderBy(*newest)))
        reason("last", F.col("__last") <= policy.last)
    if policy.within_seconds:
        out = out.withColumn("__top", F.max(time).over(over))
        reason("within", F.col(time) >= F.col("__top") - F.make_dt_interval(secs=F.lit(policy.within_seconds)))
    units = {name: unit for name, unit in BUCKETS.items() if getattr(policy, name)}
    ordered = over.orderBy(*newest)
    # Newest first, a bucket's rows stand together: its first row is the one that follows another bucket, and its rank is how many such rows there
    # have been. So one order serves every rule.
    out = out.withColumns({f"__{n}": F.date_trunc(u, F.col(time)) for n, u in units.items()})
    out = out.withColumns({f"__{n}_before": F.lag(f"__{n}").over(ordered) for n in units})
    out = out.withColumns({f"__{n}_first": F.col(f"__{n}_before").isNull() | (F.col(f"__{n}_before") != F.col(f"__{n}")) for n in units})
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({f"__{n}_rank": F.count_if(F.col(f"__{n}_first")).over(running) for n in units})
    for name in units:
        reason(name, F.col(f"__{name}_first") & (F.col(f"__{name}_rank") <= getattr(policy, name)))
    return out.withColumn("reasons", F.array_compact(F.array(*reasons))).select(*snapshots.columns, "reasons")


def forget(snapshots: DataFrame, policy: Policy | None, group: list[str], explicit: DataFrame | None = None, time: str = "ts", key: str = "key") -> DataFrame:
    """(all columns, action keep/remove, reasons). Snapshots named in ``explicit`` (a column ``key``) go, and don't take part in the ranking."""
    named = snapshots.join(explicit.select(F.col("key").alias(key)).distinct(), key, "left_semi") if explicit is not None else None
    rest = snapshots.join(explicit.select(F.col("key").alias(key)).distinct(), key, "left_anti") if explicit is not None else snapshots
    none = F.array().cast("array<string>")
    kept = apply_policy(rest, policy, group, time, key) if policy else rest.withColumn("reasons", F.array(F.lit("unnamed")))
    out = kept.withColumn("action", F.when(F.size("reasons") > 0, "keep").otherwise("remove"))
    if named is not None:
        out = out.unionByName(named.withColumn("reasons", none).withColumn("action", F.lit("remove")))
    return out
