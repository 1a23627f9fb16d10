"""The test tables as the model's tables. The same views, as SQL, stand in ``VIEWS`` for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def snapshots(self) -> DataFrame:
        """(key, client, path, ts): events."""
        return self.raw("events").select(F.col("event_id").alias("key"), F.col("user_id").alias("client"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))

    def order_snapshots(self) -> DataFrame:
        """(key, client, ts) over years: orders."""
        return self.raw("orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 16).alias("client"), F.col("o_orderdate").cast("timestamp").alias("ts"))

    def holders(self) -> DataFrame:
        """(chunk, pack, offset, length): lineitem."""
        return self.raw("lineitem").select(F.col("l_partkey").alias("chunk"), F.col("l_orderkey").alias("pack"), F.col("l_linenumber").cast("bigint").alias("offset"), F.col("l_quantity").cast("bigint").alias("length"))

    def listed(self) -> DataFrame:
        """(pack, size, modified): orders but each 37th key."""
        return self.raw("orders").where(F.col("o_orderkey") % 37 != 0).select(F.col("o_orderkey").alias("pack"), F.floor("o_totalprice").cast("bigint").alias("size"), F.col("o_orderdate").cast("timestamp").alias("modified"))

    def marks(self) -> DataFrame:
        return self.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("modified"))

    def refs(self) -> DataFrame:
        return self.raw("lineitem").where("l_returnflag = 'R' AND l_partkey % 3 = 0").select(F.col("l_partkey").alias("chunk")).distinct()

    def blobs(self) -> DataFrame:
        """(blob, supersedes): each fifth order supersedes the one before."""
        none = F.array().cast("array<bigint>")
        return self.raw("orders").select(F.col("o_orderkey").alias("blob"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.col("o_orderkey") - 1)).otherwise(none).alias("supersedes"))

    def objects(self) -> DataFrame:
        """(kind, id, size, modified, live): orders as packs, documents as trees, events as index blobs."""
        packs = self.listed().select(F.lit("pack").alias("kind"), F.col("pack").alias("id"), "size", "modified", (F.col("pack") % 3 == 0).alias("live"))
        trees = self.raw("documents").select(F.lit("tree").alias("kind"), (F.col("doc_id") * 7).alias("id"), F.col("n_chars").alias("size"), F.lit("1998-01-01").cast("timestamp").alias("modified"), (F.col("doc_id") % 2 == 0).alias("live"))
        index = self.raw("events").select(F.lit("index").alias("kind"), (F.col("event_id") * 11).alias("id"), F.lit(100).cast("bigint").alias("size"), F.col("ts").cast("timestamp").alias("modified"), (F.col("event_id") % 3 == 0).alias("live"))
        return packs.unionByName(trees).unionByName(index)

    def touches(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 5 AS int) - 2)")).alias("modified"))

    def edges(self) -> DataFrame:
        return self.raw("documents").select(F.floor(F.col("doc_id") / 2).cast("bigint").alias("parent"), F.col("doc_id").alias("child"))

    def jobs(self) -> DataFrame:
        """(job, repo, status, started, duration_secs, detail): events."""
        return self.raw("events").select(
            F.col("event_type").alias("job"), (F.col("user_id") % 4).alias("repo"), F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 11 == 0, "partial").otherwise("success").alias("status"),
            F.col("ts").cast("timestamp").alias("started"), F.col("value").alias("duration_secs"), F.col("props").alias("detail"), F.col("event_id").alias("id"))


#: The same for the oracle.
VIEWS = {
    "snap": "SELECT event_id AS key, user_id AS client, event_type AS path, ts FROM events",
    "osnap": "SELECT o_orderkey AS key, o_custkey % 16 AS client, o_orderdate AS ts FROM orders",
    "holder": "SELECT l_partkey AS chunk, l_orderkey AS pack, CAST(l_linenumber AS BIGINT) AS offs, CAST(l_quantity AS BIGINT) AS len FROM lineitem",
    "listed": "SELECT o_orderkey AS pack, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS modified FROM orders WHERE o_orderkey % 37 <> 0",
    "mark": "SELECT o_orderkey AS id, o_orderdate AS modified FROM orders WHERE o_orderstatus = 'F'",
    "ref": "SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 = 0",
    "phantom": "SELECT DISTINCT pack FROM holder WHERE pack NOT IN (SELECT pack FROM listed)",
    "blob": "SELECT o_orderkey AS blob, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS old FROM orders",
    "effective": "SELECT blob FROM blob WHERE blob NOT IN (SELECT old FROM blob WHERE old IS NOT NULL)",
    "obj_all": "SELECT 0 AS r, 'pack' AS kind, pack AS id, size, modified, pack % 3 = 0 AS live FROM listed UNION ALL SELECT 1, 'tree', doc_id * 7, n_chars, TIMESTAMP '1998-01-01', doc_id % 2 = 0 FROM documents UNION ALL SELECT 2, 'index', event_id * 11, 100, ts, event_id % 3 = 0 FROM events",
    "obj": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS n FROM obj_all) WHERE n = 1",
    "touch": "SELECT o_orderkey AS id, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER) - 2) AS modified FROM orders WHERE o_orderkey % 10 = 0",
    "edge": "SELECT doc_id // 2 AS parent, doc_id AS child FROM documents",
    "canonical": "SELECT chunk, b.pack AS pack, b.offs AS offs, b.len AS len FROM (SELECT chunk, min({'m': m.id IS NOT NULL, 'pack': h.pack, 'offs': offs, 'len': len}) AS b FROM holder h LEFT JOIN mark m ON m.id = h.pack WHERE h.pack NOT IN (SELECT pack FROM phantom) GROUP BY chunk)",
    "job": "SELECT event_type AS job, user_id % 4 AS repo, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'partial' ELSE 'success' END AS status, ts AS started, value AS duration_secs, props AS detail, event_id AS id FROM events",
}


def with_views(sql: str) -> str:
    """The views that ``sql`` names, and those they name, before it."""
    import re

    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                need.append(v)
                todo.append(VIEWS[v])
    ordered = [v for v in VIEWS if v in need]  # each is defined after those it uses
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    body = sql.strip()
    if not head:
        return body
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {m[1] or ''}{head}, {body[m.end():]}" if m else f"WITH {head} {body}"
