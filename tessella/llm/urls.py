"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

DataFrame functions only. The filter is a table of blocks of 256 bits: eight 32-bit words, one bit set in each word for each URL
(the split-block layout). A URL's hash picks the block, eight odd multipliers pick the bits. Blocks are built by a
``bit_or`` aggregation and probed by a join on the block number, so the filter is spread over the cluster and never has to fit
in one place; it is broadcast only while its size, fixed by the counted list, is at most ``max_broadcast_mb``. URLs that pass go to an
exact join on the canonical URL, which removes the false positives.

Rules (host, path) are policy, few and given by the caller: a rule fits its host and all subdomains if the path starts with the
rule's; the longest wins.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and no list entry (verdict ``allow``);
repeated rows are judged each on its own; very long URLs are judged whole; an empty list blocks nothing, an empty table gives an empty table; other columns pass through, but
those named like a column that is made give way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

#: Odd 32-bit multipliers, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_URL = 16
MAX_RULES = 64

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Host labels whose pages make up the list of the query.
LISTED_LABELS = ("casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme, ``www.``/``m.``, query, fragment, a page suffix and a closing slash don't tell pages apart. Empty host: null."""
    host, path = host_path(url)
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), bare))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; more than {MAX_RULES} belong into the list")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _bits(h: Column) -> list[Column]:
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # so that no product leaves 63 bits
    return [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]


def _masks(h: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in _bits(h)]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks)).cast("int")


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(__slot, __w0..__w7) from a column ``canon``."""
    h = F.xxhash64("canon")
    rows = listed.where(F.col("canon").isNotNull()).select(_block(h, blocks).alias("__slot"), *[m.alias(f"__w{i}") for i, m in enumerate(_masks(h))])
    return rows.groupBy("__slot").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(len(SALTS))])


def listed_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", bits_per_url: int = BITS_PER_URL, max_broadcast_mb: int = 64) -> DataFrame:
    """``pages`` with columns canon and listed (boolean): whether the canonical URL stands in ``listed`` (a column url)."""
    entries = written(listed.select(canonical(F.col("url")).alias("canon")).where(F.col("canon").isNotNull()).distinct(), "listed")
    n = entries.count()
    blocks = max(1, -(-n * bits_per_url // 256))
    small = blocks * 80 <= max_broadcast_mb << 20
    hint = F.broadcast if small else (lambda x: x)
    filt = hint(build_filter(entries, blocks))
    keyed = pages.withColumn("__canon", canonical(F.col(url_col)))
    h = F.xxhash64("__canon")
    probe = keyed.withColumn("__block", _block(h, blocks)).join(filt, F.col("__block") == F.col("__slot"), "left")
    passes = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(h))])
    probe = probe.withColumn("__maybe", F.coalesce(passes, F.lit(False)) & F.col("__canon").isNotNull())
    # Only what the filter passes goes to the exact join; the rest isn't shuffled for it.
    ours = entries.select(F.col("canon").alias("__entry"))
    some = probe.where("__maybe").join(ours, F.col("__canon") == F.col("__entry"), "left")
    rest = probe.where("not __maybe").withColumn("__entry", F.lit(None).cast("string"))
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("canon", "maybe", "listed")]
    return some.unionByName(rest).select(*own, F.col("__canon").alias("canon"), F.col("__maybe").alias("maybe"), F.col("__entry").isNotNull().alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", **kw) -> DataFrame:
    """(all columns of ``pages``, host, path, rule, verdict, canon, maybe, listed)."""
    out = listed_urls(pages, listed, url_col, **kw).drop("host", "path", "rule", "verdict")
    host, path = host_path(F.col(url_col))
    rule, verdict = rule_for(host, path, rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise("allow")
    return out.select("*", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op8_url_filter(spark, sf_dir):
    """The list of this query: the pages of hosts that have one of ``LISTED_LABELS`` as a label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = host_path(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select("url")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


OP8_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') END AS canon FROM q),
l AS (SELECT DISTINCT canon FROM c WHERE list_has_any(string_split(host, '.'), ['casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
rules(r, h, s, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS v FROM q, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM c LEFT JOIN best USING (page_id) LEFT JOIN l ON c.canon = l.canon
"""
