"""The reference operators over the test tables: each query with its DuckDB text, where SQL can express it."""

from __future__ import annotations

from datetime import datetime


from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import check, chunking, diff, exclude, gc, index, kernels, metrics, reach, restore, retention, schedule, snapshots, trees
from .catalog import Tables, with_views

QUERIES: dict = {}
ORACLES: dict = {}
NOW = datetime(1998, 8, 2)
GC = gc.Options(now=NOW)
GRACE, NOW_SQL = "INTERVAL 72 HOUR", "TIMESTAMP '1998-08-02'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


# --- retention ---------------------------------------------------------------------------------------------------------

POLICY = retention.Policy(last=2, within_seconds=5 * 86400, hourly=3, daily=4, weekly=2, monthly=1, yearly=1)
ORDER_POLICY = retention.Policy(last=1, daily=2, weekly=3, monthly=6, yearly=4)


def _retention_sql(source: str, group: str, policy: retention.Policy) -> str:
    """Ranks of the rules as columns, then the names of those that hold, in order."""
    cols, names = [f"row_number() OVER (PARTITION BY {group} ORDER BY ts DESC, key DESC) AS r_last", f"max(ts) OVER (PARTITION BY {group}) AS top"], []
    if policy.last:
        names.append(f"CASE WHEN r_last <= {policy.last} THEN 'last' END")
    if policy.within_seconds:
        names.append(f"CASE WHEN ts >= top - to_seconds({policy.within_seconds}) THEN 'within' END")
    for name, unit in retention.BUCKETS.items():
        if n := getattr(policy, name):
            cols.append(f"row_number() OVER (PARTITION BY {group}, date_trunc('{unit}', ts) ORDER BY ts DESC, key DESC) AS f_{name}")
            cols.append(f"dense_rank() OVER (PARTITION BY {group} ORDER BY date_trunc('{unit}', ts) DESC) AS d_{name}")
            names.append(f"CASE WHEN f_{name} = 1 AND d_{name} <= {n} THEN '{name}' END")
    return f"SELECT *, concat_ws(',', {', '.join(names)}) AS reasons FROM (SELECT *, {', '.join(cols)} FROM {source})"


@query("retention_keep", f"SELECT key, client, path FROM ({_retention_sql('snap', 'client, path', POLICY)}) WHERE reasons <> ''")
def _(t):
    return retention.apply_policy(t.snapshots(), POLICY, ["client", "path"]).where(F.size("reasons") > 0).select("key", "client", "path")


@query("retention_reasons", f"SELECT key, client, path, reasons FROM ({_retention_sql('snap', 'client, path', POLICY)}) WHERE reasons <> ''")
def _(t):
    out = retention.apply_policy(t.snapshots(), POLICY, ["client", "path"]).where(F.size("reasons") > 0)
    return out.select("key", "client", "path", F.array_join("reasons", ",").alias("reasons"))


@query("retention_years", f"SELECT key, client, reasons FROM ({_retention_sql('osnap', 'client', ORDER_POLICY)})")
def _(t):
    return retention.apply_policy(t.order_snapshots(), ORDER_POLICY, ["client"]).select("key", "client", F.array_join("reasons", ",").alias("reasons"))


@query("retention_drop_counts", f"SELECT client, count(*) FILTER (reasons <> '') AS n_kept, count(*) FILTER (reasons = '') AS n_removed FROM ({_retention_sql('snap', 'client, path', POLICY)}) GROUP BY client")
def _(t):
    out = retention.apply_policy(t.snapshots(), POLICY, ["client", "path"])
    return out.groupBy("client").agg(F.count_if(F.size("reasons") > 0).alias("n_kept"), F.count_if(F.size("reasons") == 0).alias("n_removed"))


@query("retention_forget", f"""
WITH rest AS (SELECT * FROM snap WHERE key % 13 <> 0), ranked AS ({_retention_sql('rest', 'client, path', POLICY)})
SELECT key, CASE WHEN reasons <> '' THEN 'keep' ELSE 'remove' END AS action, reasons FROM ranked UNION ALL SELECT key, 'remove', '' FROM snap WHERE key % 13 = 0""")
def _(t):
    snap = t.snapshots()
    out = retention.forget(snap, POLICY, ["client", "path"], explicit=snap.where("key % 13 = 0").select("key"))
    return out.select("key", "action", F.array_join("reasons", ",").alias("reasons"))


# --- snapshots ---------------------------------------------------------------------------------------------------------

_NAME = "strftime(ts, '%Y%m%dT%H%M%S') || printf('%09d', (epoch_us(ts) % 1000000) * 1000) || 'Z'"


def _named(t):
    return t.snapshots().withColumn("name", S.time_name(F.unix_micros("ts") * 1000))


@query("snapshots_latest", "SELECT client, max_by(key, {'t': ts, 'k': key}) AS key FROM snap GROUP BY client")
def _(t):
    return snapshots.latest(t.snapshots(), ["client"]).select("client", "key")


@query("snapshots_list_page", "SELECT key, client FROM snap ORDER BY ts, key LIMIT 50 OFFSET 100")
def _(t):
    return snapshots.page(t.snapshots(), 100, 50).select("key", "client")


@query("snapshots_names", f"SELECT key, {_NAME} AS name, epoch_us(ts) * 1000 AS back FROM snap")
def _(t):
    return _named(t).select("key", "name", S.parse_time_name(F.col("name")).alias("back"))


@query("snapshots_resolve_prefix", f"""
WITH n AS (SELECT key, {_NAME} AS name FROM snap),
spec AS (SELECT DISTINCT substr(name, 1, CAST(9 + (key % 4) * 3 AS INTEGER)) AS spec FROM n WHERE key % 17 = 0 UNION SELECT '1999'),
m AS (SELECT spec, count(name) AS matches, min(name) AS name FROM spec LEFT JOIN n ON starts_with(name, spec) GROUP BY spec)
SELECT spec, matches, CASE WHEN matches = 1 THEN name END AS name, CASE matches WHEN 0 THEN 'not found' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM m""")
def _(t):
    named = _named(t)
    specs = named.where("key % 17 = 0").select(F.substr("name", F.lit(1), (9 + (F.col("key") % 4) * 3).cast("int")).alias("spec")).union(t.spark.createDataFrame([("1999",)], "spec string")).distinct()
    return snapshots.resolve_prefixes(named.select("name"), specs)


@query("snapshots_parent", """
WITH r AS (SELECT client, list_sort(list(DISTINCT path)) AS roots FROM snap GROUP BY client),
s AS (SELECT client, arg_max(key, {'t': ts, 'k': key}) AS key, CASE WHEN client % 3 = 0 THEN list_sort(list(DISTINCT path)) ELSE ['view'] END AS roots FROM snap GROUP BY client)
SELECT r.client, CASE WHEN r.roots = s.roots THEN s.key END AS parent FROM r LEFT JOIN s USING (client)""")
def _(t):
    some = t.snapshots()
    paths = some.groupBy("client").agg(F.array_sort(F.collect_set("path")).alias("root_paths"))
    new = snapshots.latest(some, ["client"]).join(paths, "client").withColumn("root_paths", F.when(F.col("client") % 3 == 0, F.col("root_paths")).otherwise(F.array(F.lit("view"))))
    return snapshots.parents(paths, new).select("client", "parent")


# --- index ----------------------------------------------------------------------------------------------------------------


@query("index_effective_blobs", "SELECT blob FROM effective")
def _(t):
    return index.effective_blobs(t.blobs()).select("blob")


@query("index_compaction_due", "SELECT count(*) AS effective, count(*) > 64 AS due FROM effective")
def _(t):
    return index.compaction_due(t.blobs())


@query("index_canonical_holder", "SELECT chunk, pack, offs AS \"offset\", len AS length FROM canonical")
def _(t):
    held = t.holders()
    return index.canonical_holders(held, t.marks(), index.phantom_packs(held, t.listed()))


@query("index_merge_new_wins", """
WITH a AS (SELECT chunk, min({'p': pack, 'o': offs}) AS b FROM holder WHERE pack % 2 = 0 GROUP BY chunk), n AS (SELECT chunk, min({'p': pack, 'o': offs}) AS b FROM holder WHERE pack % 2 = 1 AND chunk % 3 = 0 GROUP BY chunk)
SELECT coalesce(n.chunk, a.chunk) AS chunk, coalesce(n.b.p, a.b.p) AS pack, coalesce(n.b.o, a.b.o) AS "offset" FROM a FULL JOIN n USING (chunk)""")
def _(t):
    held = t.holders().drop("length")
    return index.merge_new_wins(index.canonical_holders(held.where("pack % 2 = 0")), index.canonical_holders(held.where("pack % 2 = 1 AND chunk % 3 = 0")))


@query("index_distinct_chunks", "SELECT count(DISTINCT chunk) AS chunks FROM holder")
def _(t):
    return index.distinct_chunks(t.holders())


@query("index_new_chunks", "SELECT p_partkey AS chunk FROM part WHERE p_partkey NOT IN (SELECT chunk FROM holder WHERE pack % 4 = 0)")
def _(t):
    return index.new_chunks(t.raw("part").select(F.col("p_partkey").alias("chunk")), t.holders().where("pack % 4 = 0"))


@query("index_rebuild", "SELECT (SELECT count(DISTINCT pack) FROM holder) AS packs, (SELECT count(*) FROM holder) AS chunks, (SELECT count(DISTINCT blob) FROM blob) AS superseded")
def _(t):
    return index.rebuild_summary(t.holders().withColumn("raw_len", F.col("length")), t.blobs())


# --- garbage collection --------------------------------------------------------------------------------------------------

_LIVE = """WITH once AS (SELECT pack, chunk, min({'o': offs, 'l': len}).l AS len FROM holder WHERE pack NOT IN (SELECT pack FROM phantom) GROUP BY pack, chunk),
tot AS (SELECT pack, CAST(sum(len) AS BIGINT) AS total FROM once GROUP BY pack),
liv AS (SELECT pack, CAST(sum(len) AS BIGINT) AS live FROM canonical WHERE chunk IN (SELECT chunk FROM ref) GROUP BY pack),
lb AS (SELECT pack, coalesce(live, 0) AS live, total FROM tot LEFT JOIN liv USING (pack))"""
_FLOOR = f"(SELECT min(t) - INTERVAL 1 HOUR FROM (SELECT client, max(ts) AS t FROM osnap WHERE ts < {NOW_SQL} GROUP BY client) WHERE t >= {NOW_SQL} - INTERVAL 30 DAY)"
_DECIDED = f"""WITH decided AS (SELECT m.id, o.kind, CASE WHEN o.kind IS NULL THEN 'stale' WHEN o.live THEN 'revive' WHEN m.modified + {GRACE} > {NOW_SQL} THEN 'waiting' WHEN coalesce(m.modified >= {_FLOOR}, false) THEN 'blocked'
WHEN coalesce(o.kind = 'tree' AND o.modified >= m.modified, false) OR coalesce(t.modified >= m.modified, false) THEN 'revive' ELSE 'delete' END AS decision, CAST(coalesce(o.size, 0) AS BIGINT) AS size
FROM mark m LEFT JOIN obj o USING (id) LEFT JOIN touch t ON t.id = m.id),
fresh AS (SELECT kind, id, size FROM obj WHERE NOT live AND id NOT IN (SELECT id FROM mark) AND modified + {GRACE} <= {NOW_SQL}),
acts AS (SELECT CASE WHEN decision = 'delete' THEN 1 ELSE 2 END AS step, kind, id, CASE WHEN decision = 'delete' THEN 'delete' ELSE 'unmark' END AS action, size FROM decided WHERE decision IN ('delete', 'stale', 'revive') UNION ALL SELECT 3, kind, id, 'mark', CAST(size AS BIGINT) FROM fresh)"""


def _old_snapshots(t):
    return t.order_snapshots().where(F.col("ts") < F.lit(NOW))


@query("gc_phantom_packs", "SELECT pack FROM phantom")
def _(t):
    return index.phantom_packs(t.holders(), t.listed())


@query("gc_missing_refs", "SELECT p_partkey AS chunk FROM part WHERE p_partkey NOT IN (SELECT chunk FROM holder WHERE pack % 7 = 0 AND pack NOT IN (SELECT pack FROM phantom))")
def _(t):
    held = t.holders()
    return gc.missing_refs(t.raw("part").select(F.col("p_partkey").alias("chunk")), held.where("pack % 7 = 0"), index.phantom_packs(held, t.listed()))


@query("gc_live_bytes", f"{_LIVE} SELECT pack, live, total FROM lb")
def _(t):
    held = t.holders()
    return gc.live_bytes(t.refs(), held, t.marks(), index.phantom_packs(held, t.listed()))


@query("gc_repack_candidates", f"{_LIVE} SELECT pack, live, total FROM lb JOIN listed l USING (pack) WHERE live > 0 AND live * 100 < total * 50 AND l.modified + {GRACE} <= {NOW_SQL} AND pack NOT IN (SELECT id FROM mark)")
def _(t):
    held = t.holders()
    live = gc.live_bytes(t.refs(), held, t.marks(), index.phantom_packs(held, t.listed()))
    return gc.repack_candidates(t.listed(), live, t.marks(), GC)


@query("gc_active_floor", f"SELECT {_FLOOR} AS floor FROM osnap LIMIT 1")
def _(t):
    return gc.active_floor(_old_snapshots(t), GC)


@query("gc_mark_decisions", f"{_DECIDED} SELECT id, kind, decision, size FROM decided")
def _(t):
    return gc.mark_decisions(t.objects(), t.marks(), _old_snapshots(t), GC, t.touches())


@query("gc_new_marks", f"{_DECIDED} SELECT kind, id, size FROM fresh")
def _(t):
    return gc.new_marks(t.objects(), t.marks(), GC)


@query("gc_plan", f"{_DECIDED} SELECT step, kind, id, action, size FROM acts")
def _(t):
    return gc.plan(t.objects(), t.marks(), _old_snapshots(t), GC, t.touches())


@query("gc_report", f"{_DECIDED} SELECT kind, action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM acts GROUP BY kind, action")
def _(t):
    return gc.report(gc.plan(t.objects(), t.marks(), _old_snapshots(t), GC, t.touches()))


@query("gc_orphans", """
SELECT 'parity' AS what, o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey NOT IN (SELECT pack FROM listed) UNION ALL
SELECT 'touch', id FROM touch WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL
SELECT 'replica', o_orderkey FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey NOT IN (SELECT doc_id FROM documents) UNION ALL
SELECT 'unreplicated', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0)""")
def _(t):
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    orders, docs = t.raw("orders"), t.raw("documents")
    return gc.orphans(ids(orders.where("o_orderkey % 5 = 0"), "o_orderkey"), ids(t.listed(), "pack"), t.touches(), ids(docs, "doc_id"), ids(orders.where("o_orderkey % 6 = 0"), "o_orderkey"), ids(docs.where("doc_id % 2 = 0"), "doc_id"))


# --- reachability ----------------------------------------------------------------------------------------------------------

_REACH = "WITH RECURSIVE up(node) AS (SELECT CAST(v AS BIGINT) FROM (VALUES (3), (5)) x(v) UNION SELECT child FROM up JOIN edge ON parent = node WHERE child <> parent)"


def _roots(t):
    return t.spark.createDataFrame([(3,), (5,)], "node long")


@query("reach_closure", f"{_REACH} SELECT node, CAST(floor(log2(node)) - CASE WHEN node // CAST(pow(2, floor(log2(node)) - 1) AS BIGINT) = 3 THEN 1 ELSE 2 END AS INTEGER) AS depth FROM up")
def _(t):
    return reach.reachable(_roots(t), t.edges())


@query("reach_unreachable", f"{_REACH} SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT node FROM up)")
def _(t):
    return reach.unreachable(t.raw("documents").select(F.col("doc_id").alias("node")), _roots(t), t.edges())


# --- checks ------------------------------------------------------------------------------------------------------------------


@query("check_pack_outer_join", """
WITH i AS (SELECT pack, CAST(sum(len) * 100 AS BIGINT) AS want FROM holder WHERE pack % 3 <> 0 GROUP BY pack), l AS (SELECT pack AS there, size // 100 * 100 AS got FROM listed)
SELECT CASE WHEN pack IS NULL THEN 'warning' ELSE 'error' END AS severity, CASE WHEN there IS NULL THEN 'missing' WHEN pack IS NULL THEN 'unreferenced' ELSE 'size' END AS code, CAST(coalesce(pack, there) AS VARCHAR) AS id, concat_ws('/', want, got) AS detail
FROM i FULL JOIN l ON pack = there WHERE there IS NULL OR pack IS NULL OR want <> got""")
def _(t):
    indexed = t.holders().where("pack % 3 <> 0").groupBy("pack").agg((F.sum("length") * 100).cast("bigint").alias("size"))
    return check.packs(indexed, t.listed().select("pack", (F.floor(F.col("size") / 100) * 100).cast("bigint").alias("size")))


@query("check_trailers", """
WITH e AS (SELECT pack, chunk, min({'o': offs, 'l': len}) AS own FROM holder GROUP BY pack, chunk),
i AS (SELECT pack, chunk, CASE WHEN chunk % 5 = 0 THEN {'o': own.o + 1, 'l': own.l} ELSE own END AS said FROM e WHERE (pack + chunk) % 11 <> 0 AND chunk % 9 <> 0 UNION ALL SELECT pack, chunk + 1000000, own FROM e WHERE pack % 50 = 0),
k AS (SELECT DISTINCT chunk FROM i)
SELECT 'error' AS severity, CASE WHEN own IS NULL THEN 'missing entry' WHEN said IS NULL THEN 'extra entry' ELSE 'place differs' END AS code, CAST(coalesce(e.pack, i.pack) AS VARCHAR) AS id, CAST(coalesce(e.chunk, i.chunk) AS VARCHAR) AS detail
FROM e FULL JOIN i ON e.pack = i.pack AND e.chunk = i.chunk WHERE own IS NULL OR (said IS NULL AND e.chunk NOT IN (SELECT chunk FROM k)) OR own <> said""")
def _(t):
    own = t.holders().groupBy("pack", "chunk").agg(F.min(F.struct("offset", "length")).alias("e")).select("pack", "chunk", "e.offset", "e.length")
    kept = own.where("(pack + chunk) % 11 <> 0 AND chunk % 9 <> 0").withColumn("offset", F.when(F.col("chunk") % 5 == 0, F.col("offset") + 1).otherwise(F.col("offset")))
    return check.trailers(own, kept.unionByName(own.where("pack % 50 = 0").withColumn("chunk", F.col("chunk") + 1000000)))


@query("check_size_sum", """
WITH f AS (SELECT o_orderkey AS file, CAST(o_orderkey % 200 AS BIGINT) AS size FROM orders), s AS (SELECT l_orderkey AS file, CAST(sum(r.raw) AS BIGINT) AS total, bool_and(r.raw IS NOT NULL) AS known FROM lineitem LEFT JOIN (SELECT p_partkey, p_size AS raw FROM part WHERE p_partkey % 10 <> 0) r ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT file, size, coalesce(total, 0) AS total FROM f LEFT JOIN s USING (file) WHERE coalesce(known, true) AND size <> coalesce(total, 0)""")
def _(t):
    files = t.raw("orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 200).alias("size"))
    refs = t.raw("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("chunk"))
    return check.file_sizes(files, refs, t.raw("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("chunk"), F.col("p_size").alias("raw_len")))


@query("check_missing_refs", "SELECT 'error' AS severity, 'missing chunk' AS code, CAST(chunk AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail FROM ref WHERE chunk NOT IN (SELECT chunk FROM holder WHERE pack % 6 = 0)")
def _(t):
    return check.missing_chunks(t.refs(), t.holders().where("pack % 6 = 0").select("chunk").distinct())


@query("check_contiguity", """
WITH e AS (SELECT pack, chunk, offs, CASE WHEN chunk % 40 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS len FROM holder), w AS (SELECT *, lag(offs + len) OVER (PARTITION BY pack ORDER BY offs, chunk) AS prev, count(*) OVER (PARTITION BY pack, chunk) AS times FROM e)
SELECT 'error' AS severity, CASE WHEN coalesce(prev, 1) <> offs THEN 'gap' WHEN times > 1 THEN 'chunk twice' ELSE 'length' END AS code, CAST(pack AS VARCHAR) AS id, CAST(chunk AS VARCHAR) AS detail FROM w WHERE coalesce(prev, 1) <> offs OR times > 1 OR len > 1""")
def _(t):
    e = t.holders().withColumn("length", F.when(F.col("chunk") % 40 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint"))
    return check.contiguity(e, first=1, low=1, high=1)


@query("check_sorted_unique", "SELECT key, client FROM (SELECT *, lag(path) OVER (PARTITION BY client ORDER BY ts, key) AS b FROM snap) WHERE b >= path")
def _(t):
    return check.strictly_increasing(t.snapshots(), ["client"], ["ts", "key"], "path").select("key", "client")


@query("check_report", """
WITH f AS (SELECT CASE WHEN there IS NULL THEN 'error' WHEN pack IS NULL THEN 'warning' ELSE 'error' END AS severity, CASE WHEN there IS NULL THEN 'missing' WHEN pack IS NULL THEN 'unreferenced' ELSE 'size' END AS code
FROM (SELECT pack, CAST(sum(len) AS BIGINT) AS want FROM holder WHERE pack % 3 <> 0 GROUP BY pack) i FULL JOIN (SELECT pack AS there, size AS got FROM listed) l ON pack = there WHERE there IS NULL OR pack IS NULL OR want <> got
UNION ALL SELECT 'error', 'missing chunk' FROM ref WHERE chunk NOT IN (SELECT chunk FROM holder WHERE pack % 6 = 0)) SELECT severity, code, count(*) AS n FROM f GROUP BY ALL""")
def _(t):
    indexed = t.holders().where("pack % 3 <> 0").groupBy("pack").agg(F.sum("length").cast("bigint").alias("size"))
    idx = t.holders().where("pack % 6 = 0").select("chunk", F.col("length").alias("raw_len")).dropDuplicates(["chunk"])
    none = t.raw("orders").where(F.lit(False)).select(F.col("o_orderkey").alias("file"), F.lit(0).cast("bigint").alias("size"))
    return check.report(check.check(indexed, t.listed(), t.refs(), idx, none, none.select("file", F.col("file").alias("chunk"))))


# --- change detection ------------------------------------------------------------------------------------------------------

_PAIR = """c AS (SELECT o_custkey % 8 AS root, o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, epoch_us(o_orderdate) * 1000 AS mtime, epoch_us(o_orderdate) * 1000 + 5 AS ctime, o_orderkey * 3 AS ino FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT o_custkey % 8 AS root, o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size, epoch_us(o_orderdate) * 1000 AS mtime, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate) * 1000 + 5 END AS ctime, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 3 + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END END AS ino FROM orders WHERE o_orderkey % 13 <> 0)"""
START_NS = 901065600 * 10**9  # 1998-07-22


def _listings(t):
    o = t.raw("orders")
    key = F.col("o_orderkey")
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    size = F.floor("o_totalprice").cast("bigint")
    base = [(F.col("o_custkey") % 8).alias("root"), key.alias("path")]
    cur = o.where(key % 11 != 0).select(*base, size.alias("size"), ns.alias("mtime_ns"), (ns + 5).alias("ctime_ns"), (key * 3).alias("ino"))
    prev = o.where(key % 13 != 0).select(*base, (size + F.when(key % 5 == 0, 1).otherwise(0)).alias("size"), ns.alias("mtime_ns"), F.when(key % 3 != 0, ns + 5).alias("ctime_ns"), F.when(key % 4 != 0, key * 3 + F.when(key % 50 == 1, 1).otherwise(0)).alias("ino"))
    return cur, prev


@query("diff_change_detection", f"WITH {_PAIR} SELECT coalesce(c.root, p.root) AS root, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' WHEN c.size = p.size AND c.mtime = p.mtime THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM c FULL JOIN p ON c.root = p.root AND c.path = p.path GROUP BY ALL")
def _(t):
    both = diff.compare(*_listings(t))
    same = (F.col("cur.size") == F.col("prev.size")) & (F.col("cur.mtime_ns") == F.col("prev.mtime_ns"))
    return both.select("root", diff.status(same).alias("status")).groupBy("root", "status").agg(F.count("*").alias("n"))


@query("diff_fastpath", f"""WITH {_PAIR} SELECT c.root, c.path, coalesce(c.size = p.size AND c.mtime = p.mtime AND (p.ctime IS NULL OR c.ctime = p.ctime) AND (p.ino IS NULL OR c.ino = p.ino) AND c.mtime < {START_NS} AND (p.ctime IS NULL OR c.ctime < {START_NS}), false) AS reused
FROM c LEFT JOIN p ON c.root = p.root AND c.path = p.path""")
def _(t):
    both = diff.compare(*_listings(t)).where("cur is not null")
    return both.select("root", "path", diff.unchanged("cur", "prev", F.lit(START_NS)).alias("reused"))


def _entries(t):
    li = t.raw("lineitem")
    return li.select((F.col("l_linenumber") % 3).alias("t"), (F.col("l_suppkey") % 3).alias("dev"), F.col("l_partkey").alias("ino"), F.when(F.col("l_partkey") % 2 == 0, 2).otherwise(1).alias("nlink"),
                     F.col("l_partkey").alias("size"), (F.col("l_orderkey") % 9 == 0).alias("root"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), "l_orderkey", "l_linenumber")


_ENTRIES = "e AS (SELECT l_linenumber % 3 AS t, l_suppkey % 3 AS dev, l_partkey AS ino, CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 1 END AS nlink, l_partkey AS size, l_orderkey % 9 = 0 AS root, concat_ws('/', l_orderkey, l_linenumber) AS path, l_orderkey, l_linenumber FROM lineitem)"


@query("stats_hardlink_once", f"""WITH {_ENTRIES} SELECT count(*) FILTER (t = 0) AS files, count(*) FILTER (t = 1 AND NOT root) AS dirs, count(*) FILTER (t = 2) AS symlinks,
CAST((SELECT sum(size) FROM e WHERE t = 0 AND nlink = 1) + (SELECT sum(s) FROM (SELECT max(size) AS s FROM e WHERE t = 0 AND nlink > 1 GROUP BY dev, ino)) AS BIGINT) AS bytes FROM e""")
def _(t):
    return diff.snapshot_stats(_entries(t))


@query("hard_link_leaders", f"WITH {_ENTRIES}, l AS (SELECT dev, ino, arg_min(path, {{'a': l_orderkey, 'b': l_linenumber}}) AS lead FROM e WHERE nlink > 1 GROUP BY dev, ino) SELECT path, CASE WHEN nlink > 1 THEN lead ELSE path END AS leader FROM e LEFT JOIN l USING (dev, ino)")
def _(t):
    return diff.hard_link_leaders(_entries(t), ["l_orderkey", "l_linenumber"]).select("path", "leader")


@query("backup_report", "SELECT count(*) FILTER (l_returnflag = 'N') AS chunks_new, count(*) FILTER (l_returnflag = 'A') AS chunks_read, count(*) FILTER (l_returnflag = 'R') AS packs_revived, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS bytes_stored FROM lineitem")
def _(t):
    flag = F.col("l_returnflag")
    return diff.backup_report(t.raw("lineitem").select((flag == "N").alias("new"), (flag == "A").alias("reused"), (flag == "R").alias("revived"), F.col("l_quantity").cast("bigint").alias("raw_len")))


@query("commit_gate", f"""SELECT chunk, h.pack, CASE WHEN l.pack IS NULL THEN 'pack is gone' ELSE 'mark has run out' END AS why FROM (SELECT DISTINCT chunk, pack FROM holder WHERE chunk % 4 = 0) h LEFT JOIN listed l ON l.pack = h.pack LEFT JOIN mark m ON m.id = h.pack
WHERE l.pack IS NULL OR m.modified + {GRACE} <= {NOW_SQL}""")
def _(t):
    return diff.commit_gate(t.holders().where("chunk % 4 = 0").select("chunk", "pack").distinct(), t.listed(), t.marks(), NOW, 72 * 3600)


# --- paths -----------------------------------------------------------------------------------------------------------------

INCLUDE = ["/*.example.com/**", "!/*/en", "[0-4]*"]
EXCLUDE = ["m.*", "/**/de", "!m.th*", "*.html"]


def _paths(t):
    pages = t.raw("pages")
    path = F.concat(F.lit("/"), F.array_join(P.components(F.regexp_replace("url", r"[?#].*\z", "")), "/"))
    return pages.select("page_id", path.alias("path"))


_PATH = r"pp AS (SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/'), lambda c: c <> '' AND c <> '.'), lambda c: CASE WHEN c = '..' THEN '__parent__' ELSE c END), '/') AS path FROM pages)"
_PREFIX = r"px AS (SELECT page_id, path, n, '/' || array_to_string(list_slice(string_split(substr(path, 2), '/'), 1, n), '/') AS pre FROM (SELECT page_id, path, unnest(range(1, len(string_split(substr(path, 2), '/')) + 1)) AS n FROM pp))"


def _decision_sql(patterns: list[str], col: str) -> str:
    out = "NULL"
    for p in map(P.compile_pattern, patterns):
        regex = p.regex.replace("(?!/)", "").replace("'", "''")
        out = f"CASE WHEN regexp_matches({col}, '{regex}') THEN {'false' if p.negated else 'true'} ELSE {out} END"
    return f"CAST({out} AS BOOLEAN)"


@query("path_components", f"WITH {_PATH} SELECT page_id, path FROM pp")
def _(t):
    return _paths(t)


@query("path_exclude", f"WITH {_PATH}, {_PREFIX} SELECT page_id, bool_or(coalesce({_decision_sql(EXCLUDE, 'pre')}, false)) AS excluded FROM px GROUP BY page_id")
def _(t):
    f = P.PathFilter(EXCLUDE)
    return _paths(t).select("page_id", f.excluded(F.col("path")).alias("excluded"))


@query("path_include_inherit", f"WITH {_PATH}, {_PREFIX} SELECT page_id, coalesce(arg_max(d, n) FILTER (d IS NOT NULL), false) AS taken FROM (SELECT page_id, n, {_decision_sql(INCLUDE, 'pre')} AS d FROM px) GROUP BY page_id")
def _(t):
    return _paths(t).select("page_id", P.PathFilter(INCLUDE).inherited(F.col("path"), False).alias("taken"))


@query("path_select", f"""WITH {_PATH}, {_PREFIX} SELECT page_id FROM (SELECT page_id, coalesce(arg_max(d, n) FILTER (d IS NOT NULL), false) AS taken, bool_or(coalesce(x, false)) AS gone FROM (SELECT page_id, n, {_decision_sql(INCLUDE, 'pre')} AS d, {_decision_sql(EXCLUDE, 'pre')} AS x FROM px) GROUP BY page_id) WHERE taken AND NOT gone""")
def _(t):
    return _paths(t).where(P.select(F.col("path"), P.PathFilter(INCLUDE), P.PathFilter(EXCLUDE))).select("page_id")


UNMATCHED = ["/*.example.com", "*.nowhere", "/blog.*/es/9*", "!m.*", "/x/**/y"]


@query("path_unmatched", f"""WITH {_PATH}, {_PREFIX}, sel AS (SELECT page_id FROM (SELECT page_id, n, {_decision_sql(UNMATCHED, 'pre')} AS d FROM px) GROUP BY page_id HAVING coalesce(arg_max(d, n) FILTER (d IS NOT NULL), false)),
pat(pattern, re) AS (VALUES {', '.join("('" + p + "', '" + P.compile_pattern(p).regex + "')" for p in UNMATCHED if p[0] != '!')}) SELECT pattern FROM pat WHERE NOT EXISTS (SELECT 1 FROM px WHERE page_id IN (SELECT page_id FROM sel) AND regexp_matches(pre, re))""")
def _(t):
    return restore.unmatched(_paths(t).select("path"), UNMATCHED)


@query("source_roots", f"WITH {_PATH}, r AS (SELECT DISTINCT path FROM pp UNION SELECT '/' || split_part(substr(path, 2), '/', 1) || '/' || split_part(substr(path, 2), '/', 2) FROM pp WHERE page_id % 5 = 0) SELECT path FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.path, b.path || '/'))")
def _(t):
    p = _paths(t)
    top = p.where("page_id % 5 = 0").select(F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.substr("path", F.lit(2)), "/"), 1, 2), "/")).alias("path"))
    return diff.kept_roots(p.select("path").union(top))


# --- random reads, segments, scalars ----------------------------------------------------------------------------------------


@query("range_locate_bytes", """
WITH c AS (SELECT l_orderkey AS file, l_linenumber AS pos, max(CAST(l_quantity AS BIGINT)) AS raw FROM lineitem GROUP BY ALL), o AS (SELECT *, CAST(sum(raw) OVER (PARTITION BY file ORDER BY pos) AS BIGINT) AS hi FROM c), r AS (SELECT o_orderkey AS request, o_orderkey AS file, o_orderkey % 100 AS st, CAST(30 AS BIGINT) AS ln FROM orders)
SELECT request, file, pos, greatest(st, hi - raw) - (hi - raw) AS "from", least(st + ln, hi) - (hi - raw) AS "to" FROM r JOIN o USING (file) WHERE st < hi AND st + ln > hi - raw AND raw > 0""")
def _(t):
    chunks = t.raw("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("bigint").alias("raw_len")).groupBy("file", "pos").agg(F.max("raw_len").alias("raw_len"))
    requests = t.raw("orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 100).alias("start"), F.lit(30).cast("bigint").alias("length"))
    return restore.locate(chunks, requests)


@query("tree_segments", """
WITH n AS (SELECT client, (row_number() OVER (PARTITION BY client ORDER BY key) - 1) // 7 AS segment FROM snap), f AS (SELECT client, segment, count(*) AS n FROM n GROUP BY ALL)
SELECT * FROM f UNION ALL SELECT client, max(segment) + 1, 0 FROM f GROUP BY client HAVING arg_max(n, segment) = 7""")
def _(t):
    return trees.segments(t.snapshots(), ["client"], ["key"], 7)


@query("human_sizes", """SELECT o_orderkey AS id, CASE WHEN b >= 1099511627776 THEN printf('%.1f TiB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.1f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%d B', b) END AS size
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * (o_orderkey % 1000) AS b FROM orders)""")
def _(t):
    key = F.col("o_orderkey")
    return t.raw("orders").select(key.alias("id"), S.human_bytes(key * key * (key % 1000), "TiB").alias("size"))


# --- metrics ---------------------------------------------------------------------------------------------------------------


@query("metrics_job_summary", "SELECT job, count(*) FILTER (status = 'success') AS n_ok, count(*) FILTER (status <> 'success') AS n_failed, max({'s': started, 'd': duration_secs}).s AS last_started, max({'s': started, 'd': duration_secs}).d AS last_duration FROM job GROUP BY job")
def _(t):
    return metrics.summary(t.jobs()).withColumn("last_started", F.col("last_started").cast("timestamp_ntz"))


@query("metrics_runs", "SELECT job, status, count(*) AS n FROM job GROUP BY ALL")
def _(t):
    return metrics.runs(t.jobs())


@query("metrics_last_success", "SELECT job, repo, max(started) AS started FROM job WHERE status = 'success' GROUP BY ALL")
def _(t):
    return metrics.last_success(t.jobs()).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("metrics_detail", "SELECT job, repo, arg_max(CAST(detail ->> '$.k' AS BIGINT), started) AS value FROM job WHERE detail ->> '$.k' IS NOT NULL GROUP BY ALL")
def _(t):
    return metrics.detail(t.jobs(), "$.k")


@query("metrics_open_metrics", "SELECT '# HELP runs_total Runs by job and status.' AS line UNION ALL SELECT '# TYPE runs_total gauge' UNION ALL SELECT 'runs_total{job=\"' || job || '\",status=\"' || status || '\"} ' || count(*) FROM job GROUP BY job, status")
def _(t):
    return metrics.open_metrics(metrics.runs(t.jobs()), "runs_total", ["job", "status"], "n", "Runs by job and status.")


@query("history_top20", "SELECT job, id FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started DESC, id DESC) AS rn FROM job) WHERE rn <= 20")
def _(t):
    return diff.recent(t.jobs(), 20, ["job"], [F.col("started").desc(), F.col("id").desc()]).select("job", "id")


# --- content -----------------------------------------------------------------------------------------------------------------


@query("dedup_exact_documents", "SELECT sha256(text) AS id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def _(t):
    return t.raw("documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def _chunks(t):
    each = t.raw("documents").select("doc_id", F.explode(chunking.fastcdc(F.encode("text", "utf-8"))).alias("c"))
    return each.select("doc_id", "c.seq", "c.offset", "c.length", S.hex_id(F.col("c.id")).alias("id"))


@query("chunk_fastcdc_documents")
def _(t):
    return _chunks(t)


@query("chunk_covers_documents", "SELECT doc_id, octet_length(encode(text)) AS bytes, true AS whole FROM documents WHERE octet_length(encode(text)) > 0")
def _(t):
    return _chunks(t).groupBy("doc_id").agg(F.sum("length").alias("bytes"), (F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("whole"))


@query("dedup_ratio_fastcdc")
def _(t):
    per = _chunks(t).groupBy("id").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return per.agg(F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("stored"), F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"))


@query("pack_fill")
def _(t):
    filled = kernels.fill_packs(_chunks(t).dropDuplicates(["id"]).select("id", "length"), 256 << 10, ["id"])
    return filled.groupBy("pack").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("compress_adaptive", "SELECT doc_id, sha256(text) AS back FROM documents")
def _(t):
    packed = t.raw("documents").select("doc_id", kernels.compress(F.encode("text", "utf-8")).alias("z"))
    return packed.select("doc_id", F.sha2(kernels.decompress(F.col("z"), 64 << 20), 256).alias("back"))


@query("parity_roundtrip", "SELECT doc_id, sha256(text) AS repaired FROM documents")
def _(t):
    raw = F.encode("text", "utf-8")
    d = t.raw("documents").select("doc_id", raw.alias("raw"), kernels.parity_encode(raw, 2).alias("p"))
    # The first sixteenth is overwritten: one shard of sixteen is gone.
    n = F.least(F.col("p.shard_len"), F.octet_length("raw")).cast("int")
    damaged = F.concat(F.unhex(F.repeat(F.lit("00"), n)), F.substring(F.col("raw"), n + 1, F.octet_length("raw")))
    return d.select("doc_id", F.sha2(kernels.parity_repair(damaged, F.col("p")), 256).alias("repaired"))




# --- exclusion, gates, schedules ---------------------------------------------------------------------------------------------

RULES = exclude.Rules(patterns=["/b/*3", "!/b/13"], larger_than=180_000, markers={"m7": b"F"}, one_file_system=True)


def _tree(t):
    """Orders as files /<a..d>/<n>/f<key> with marker files m7, and their directories."""
    o, key = t.raw("orders"), F.col("o_orderkey")
    top = F.element_at(F.array(*map(F.lit, "abcd")), (key % 4 + 1).cast("int"))
    dirname = F.concat(F.lit("/"), top, F.lit("/"), (key % 40).cast("string"))
    name = F.when(key % 90 == 7, "m7").otherwise(F.concat(F.lit("f"), key.cast("string")))
    dev = F.when(key % 40 == 22, 2).otherwise(1)
    files = o.select(F.concat(dirname, F.lit("/"), name).alias("path"), dirname.alias("dir"), name.alias("name"), F.lit("file").alias("kind"), F.floor("o_totalprice").cast("bigint").alias("size"), dev.alias("dev"), F.encode("o_orderstatus", "utf-8").alias("head"))
    files = files.groupBy("path", "dir", "name", "kind").agg(F.max("size").alias("size"), F.max("dev").alias("dev"), F.max("head").alias("head"))
    dirs = o.select(dirname.alias("path"), F.concat(F.lit("/"), top).alias("dir"), (key % 40).cast("string").alias("name"), F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("size"), dev.alias("dev"), F.lit(None).cast("binary").alias("head")).distinct()
    return files.unionByName(dirs).withColumn("root_dev", F.lit(1))


_TREE = """o AS (SELECT o_orderkey AS k, '/' || substr('abcd', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS top, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderkey % 40 = 22 THEN 2 ELSE 1 END AS dev, o_orderstatus AS head FROM orders),
f AS (SELECT top || '/' || (k % 40) AS dir, CASE WHEN k % 90 = 7 THEN 'm7' ELSE 'f' || k END AS name, max(size) AS size, max(dev) AS dev, max(head) AS head FROM o GROUP BY ALL),
e AS (SELECT dir || '/' || name AS path, dir, name, 'file' AS kind, size, dev, head FROM f UNION ALL SELECT DISTINCT top || '/' || (k % 40), top, CAST(k % 40 AS VARCHAR), 'dir', 0, dev, NULL FROM o),
mk AS (SELECT DISTINCT dir FROM e WHERE name = 'm7' AND kind = 'file' AND head = 'F'),
w AS (SELECT *, CASE WHEN path LIKE '/b/%3' AND path NOT LIKE '/b/%/%' AND path <> '/b/13' THEN 'pattern' WHEN kind = 'file' AND size > 180000 THEN 'too large' WHEN dir IN (SELECT dir FROM mk) AND name <> 'm7' THEN 'beside a marker' WHEN kind = 'file' AND dev <> 1 THEN 'other file system' END AS reason FROM e),
st AS (SELECT path FROM w WHERE kind = 'dir' AND (reason IS NOT NULL OR dev <> 1)),
r AS (SELECT path, reason, dir NOT IN (SELECT path FROM st) AS seen FROM w)"""


@query("backup_exclude", f"WITH {_TREE} SELECT path, reason, seen AND reason IS NULL AS taken, seen AND reason IS NOT NULL AS topmost FROM r")
def _(t):
    return exclude.walk(_tree(t), RULES).select("path", "reason", "taken", "topmost")


@query("commit_gate_trees", """
WITH m AS (SELECT id, modified FROM mark WHERE id % 2 = 0), tr AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0)
SELECT m.id AS tree, CASE WHEN tr.id IS NULL THEN 'tree is gone' ELSE 'not touched since its mark' END AS why FROM m LEFT JOIN tr USING (id) LEFT JOIN touch t ON t.id = m.id WHERE tr.id IS NULL OR t.id IS NULL OR t.modified < m.modified""")
def _(t):
    marks = t.marks().where("id % 2 = 0")
    return diff.commit_gate_trees(marks.select(F.col("id").alias("node")), marks, t.raw("orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id")), t.touches())


@query("schedule_next_due", "WITH d AS (SELECT repo, CASE job WHEN 'click' THEN 'prune' WHEN 'view' THEN 'forget' ELSE 'backup' END AS job, date_trunc('day', started) AS dd FROM job) SELECT repo, min({'at': dd, 'r': CASE job WHEN 'backup' THEN 1 WHEN 'forget' THEN 2 ELSE 3 END, 'j': job}).j AS job, CAST(min(dd) AS TIMESTAMP) AS \"at\" FROM d GROUP BY repo")
def _(t):
    job = F.when(F.col("job") == "click", "prune").when(F.col("job") == "view", "forget").otherwise("backup")
    due = t.jobs().select("repo", job.alias("job"), F.date_trunc("day", "started").alias("at"))
    return schedule.next_due(due).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("chunk_lists", """
WITH x AS (SELECT l_orderkey AS file, l_orderkey % 2 AS content, list(l_partkey ORDER BY l_partkey, l_linenumber) AS chunks FROM lineitem GROUP BY l_orderkey), l AS (SELECT p_partkey AS list, [p_partkey * 10, p_partkey * 10 + 1] AS chunks FROM part),
a AS (SELECT file, content, unnest(chunks) AS id, unnest(range(len(chunks))) AS ps FROM x), i AS (SELECT list AS id, unnest(chunks) AS chunk, unnest(range(2)) AS sub FROM l),
b AS (SELECT file, ps, 0 AS sub, id AS chunk FROM a WHERE content = 0 UNION ALL SELECT file, ps, sub, chunk FROM a JOIN i USING (id) WHERE content = 1)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY ps, sub) - 1 AS INTEGER) AS pos, chunk FROM b""")
def _(t):
    files = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("c"))
    files = files.select("file", (F.col("file") % 2).alias("content"), F.col("c.l_partkey").alias("chunks"))
    return restore.chunk_lists(files, t.raw("part").select(F.col("p_partkey").alias("list"), F.array(F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 1).alias("chunks")))


@query("restore_plan", f"""WITH {_PATH}, {_PREFIX}, ent AS (SELECT DISTINCT pre AS path, CASE WHEN max(n) OVER (PARTITION BY page_id) = n THEN 'file' ELSE 'dir' END AS kind FROM px), once AS (SELECT path, min(kind) AS kind FROM ent GROUP BY path),
ep AS (SELECT path, kind, n, '/' || array_to_string(list_slice(string_split(substr(path, 2), '/'), 1, n), '/') AS pre FROM (SELECT path, kind, unnest(range(1, len(string_split(substr(path, 2), '/')) + 1)) AS n FROM once)),
tk AS (SELECT path, kind FROM (SELECT path, kind, n, {_decision_sql(INCLUDE, 'pre')} AS d, {_decision_sql(EXCLUDE, 'pre')} AS x FROM ep) GROUP BY path, kind HAVING coalesce(arg_max(d, n) FILTER (d IS NOT NULL), false) AND NOT bool_or(coalesce(x, false)))
SELECT path, kind FROM once WHERE path IN (SELECT path FROM tk) OR (kind = 'dir' AND EXISTS (SELECT 1 FROM tk WHERE starts_with(tk.path, once.path || '/')))""")
def _(t):
    p = _paths(t)
    every = p.select(F.posexplode(P.prefixes(F.col("path"))).alias("at", "pre"), "path")
    entries = every.select(F.col("pre").alias("path"), F.when(F.col("pre") == F.col("path"), "file").otherwise("dir").alias("kind")).groupBy("path").agg(F.min("kind").alias("kind"))
    return restore.plan(entries, INCLUDE, EXCLUDE).select("path", "kind")
