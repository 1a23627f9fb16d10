"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, beside plain text statistics.

DataFrame functions only. Words and word pairs are hashed into ``buckets`` buckets. Two multinomials over the buckets are counted in one
pass: the raw corpus (every document) and the trusted target (documents labelled good, at most ``max_trusted`` of them, those
whose ids hash lowest). A document's score is the mean over its n-grams of log p(target) - log p(raw), both
multinomials taken at the target's size and smoothed by ``smoothing`` counts a bucket (so that a bucket too rare to tell weighs
next to nothing, in a small corpus too), in whole millionths so that sums don't depend on their order. Every document is judged by the same threshold.

Scale: counts are combined on the map side to at most ``buckets`` rows a task; the weights, broadcast, have exactly ``buckets`` rows or fewer;
scoring shuffles one small row for each document and part of it, never texts. Repeats within a document are found by sorting its
window hashes in place, without a shuffle.

Defined cases: null and empty texts have no words, so ``base_failed`` is true, the score 0 and ``kept`` false; without
trusted documents all weights are 0 and only the base rules decide; repeated rows give one result row each (a document is
counted as often as it stands in the table); null ids are judged like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: The white space that parts words.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
SMOOTHING = 20.0
UNIT = 1_000_000
#: Mean log-likelihood ratio below which a document is more like the raw corpus' other part than like the target.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds w (words), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("w", words(F.col(text))).withColumn("__lines", lines)
    out = out.withColumn("n_words", F.size("w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long")).withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    w, n = F.col("w"), F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__h", windows)
    # Only a text with two equal windows is put in order, by the whole hash, so that equal windows stand together.
    again_ = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__p", F.when(again_, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))))
    p = F.col("__p")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
    out = out.withColumn("__at", F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__lines", "__h", "__p", "__at")


def ngrams(w: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the word pairs."""
    pairs = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.pmod(F.xxhash64(w[i], w[i + 1]), F.lit(buckets)).cast("int")))
    return F.concat(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")), F.coalesce(pairs, F.array().cast("array<int>")))


def weights(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight long): the log-likelihood ratio of each bucket that occurs, in millionths. ``trusted``: at most ``MAX_TRUSTED`` ids."""
    good = trusted.select(F.col("id").alias("__good"))
    each = docs.select(F.col(id_col).cast("long").alias("__id"), words(F.col(text_col)).alias("w")).join(F.broadcast(good), F.col("__id") == F.col("__good"), "left")
    each = each.select(F.col("__good").isNotNull().cast("long").alias("t"), F.explode(ngrams(F.col("w"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = written(counts, "counts")
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    r, t = total["r"] or 0, total["t"] or 0
    if not t:
        return counts.select("bucket", F.lit(0).cast("long").alias("weight"))
    ratio = F.log(F.col("target") + F.lit(smoothing)) - F.log(F.col("raw") * F.lit(t / r) + F.lit(smoothing))
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """(id): ids labelled quality 1 and never 0, those with the lowest hashes, at most ``limit``."""
    ok = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q")).where("q = 1")
    return ok.select("id").orderBy(F.xxhash64("id"), "id").limit(limit)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(id, statistics, base_failed, score double, kept boolean) for each row of ``docs``."""
    weight = weights(docs, trusted, text_col, id_col, buckets)
    # __row tells repeated rows apart; a row's n-grams are summed within its task, so the sums are shuffled, not the n-grams.
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    each = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text")
    each = each.select("id", *base, "w", F.monotonically_increasing_id().alias("__row"))
    each = each.select("id", "__row", *base, F.explode_outer(ngrams(F.col("w"), buckets)).alias("b"))
    scored = each.join(F.broadcast(weight), F.col("b") == F.col("bucket"), "left")
    sums = scored.groupBy("id", "__row", *base).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("s"), F.count("b").alias("n"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    score = F.when(F.col("n") > 0, F.col("s") / (F.col("n") * F.lit(float(UNIT)))).otherwise(F.lit(0.0))
    return sums.select("id", *base, failed.alias("base_failed"), score.alias("score")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def op6_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return out.withColumnRenamed("id", "doc_id").drop("score")
