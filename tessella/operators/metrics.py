"""Operational metrics of jobs, as rows and as OpenMetrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(jobs: DataFrame) -> DataFrame:
    """(job, status, n)."""
    return jobs.groupBy("job", "status").agg(F.count("*").alias("n"))


def summary(jobs: DataFrame) -> DataFrame:
    """(job, n_ok, n_failed, last_started, last_duration): the last by start, ties by the longer one."""
    return jobs.groupBy("job").agg(
        F.count_if(F.col("status") == "success").alias("n_ok"), F.count_if(F.col("status") != "success").alias("n_failed"),
        F.max(F.struct("started", "duration_secs")).alias("m")).select("job", "n_ok", "n_failed", F.col("m.started").alias("last_started"), F.col("m.duration_secs").alias("last_duration"))


def last_success(jobs: DataFrame) -> DataFrame:
    """(job, repo, started): the last full success of each job and repository."""
    return jobs.where("status = 'success'").groupBy("job", "repo").agg(F.max("started").alias("started"))


def detail(jobs: DataFrame, path: str, kind: str = "bigint") -> DataFrame:
    """(job, repo, value) from the JSON detail of each job's newest run that has it."""
    value = F.get_json_object("detail", path).try_cast(kind)
    return jobs.withColumn("__v", value).where(F.col("__v").isNotNull()).groupBy("job", "repo").agg(F.max_by("__v", "started").alias("value"))


def open_metrics(rows: DataFrame, name: str, labels: list[str], value: str, help_text: str) -> DataFrame:
    """(line): text exposition of a counter or gauge, header first."""
    escape = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels])
    body = rows.select(F.lit(1).alias("o"), F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}"), (0, f"# TYPE {name} gauge")], "o int, line string")
    return head.unionByName(body).orderBy("o", "line").select("line")
