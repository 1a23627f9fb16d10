"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every token window.

DataFrame functions only. A window is ``n`` consecutive words of a benchmark item; an item with fewer words (but not none)
is one window as it is. The corpus is split into words once; its windows of every size that the benchmark has are hashed in that pass and probed against the
hash set. What passes is verified word by word, by a join with the windows themselves, so that a hash collision removes nothing.

Scale: the corpus side is never shuffled; only hits are, by document. The broadcast set holds sizes and hashes alone, 12 bytes each, and is broadcast
while it has at most ``max_broadcast`` of them (counted first); a larger benchmark is joined by shuffling on the hash instead. Lists of
items stay in the table of windows. A hit of a row that is repeated is one hit before hits are put in order by document, so no
order is longer than a document.

Defined cases: null and empty texts have no words and hit nothing; null ids are kept as a document of their own; repeated rows
(same id and text) each give the same result row; very long texts are one row of as many windows; an empty benchmark or corpus gives no hits or no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, row_key, table, written

#: Everything in ASCII that is neither a digit nor a letter splits words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, hash, window, item_ids): each distinct window with the sorted ids of the items that have it."""
    each = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(n), F.size("w"))
    cut = each.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    cut = cut.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("window"))
    return cut.groupBy("size", "window").agg(F.collect_set("item").alias("item_ids")).select("size", F.xxhash64("window").alias("hash"), "window", "item_ids")


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(key, at, size, item_ids): every occurrence of a window in a document; ``at`` counts words from 0."""
    windows = written(windows, "windows")
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most n rows
    each = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    if not sizes:
        return each.where(F.lit(False)).select("key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("item_ids"))
    listed = F.array(*map(F.lit, sorted(sizes)))
    # Each size, then each place: one row for a window, made and probed without a shuffle.
    sized = each.select("key", "w", F.explode(F.filter(listed, lambda s: s <= F.size("w"))).alias("size"))
    probe = sized.select("key", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    probe = probe.withColumn("hash", F.xxhash64(F.slice("w", F.col("at"), F.col("size"))))
    known = windows.select("size", "hash").distinct()
    known = F.broadcast(known) if sum(sizes.values()) <= max_broadcast else known
    passed = probe.join(known, ["size", "hash"], "left_semi").select("key", "at", "size", "hash", F.slice("w", F.col("at"), F.col("size")).alias("found"))
    ours = windows.select(F.col("size").alias("s"), F.col("hash").alias("h"), "window", "item_ids")
    right = (F.col("size") == F.col("s")) & (F.col("hash") == F.col("h")) & (F.col("found") == F.col("window"))
    return passed.join(ours, right).select("key", (F.col("at") - 1).alias("at"), "size", "item_ids")


def spans(found: DataFrame) -> DataFrame:
    """Per document the union of its hits: (key, n_hit, item_ids) with n_hit counting each word once."""
    found = found.groupBy("key", "at", "size").agg(F.first("item_ids").alias("item_ids"))  # a repeated row's hits are one
    w = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(w), F.lit(0))))
    return found.select("key", "item_ids", fresh.alias("fresh")).groupBy("key").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: its id, text, n_words, n_hit and the ids of the items with occurring windows."""
    found = spans(hits(docs, benchmark_windows(benchmark, n, item_col, item_text), id_col, text_col, max_broadcast))
    each = docs.select(F.col(id_col), F.col(text_col), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = each.join(found, each["key"].eqNullSafe(found["key"]), "left")
    return out.select(each[id_col], each[text_col], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a hit; all columns stay."""
    found = hits(docs, benchmark_windows(benchmark, n), id_col, text_col).select("key").distinct()
    keyed = docs.withColumn("__key", row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(found, keyed["__key"].eqNullSafe(found["key"]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, p.size, item_id FROM pos p JOIN win USING (size, win)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
