import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import decontaminate, quality, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _norm(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def test_decontaminate(spark, docs, pairs):
    items = [(1, pairs[0][1]), (2, "seven wizards quietly"), (3, None), (4, " "), (5, "the QUICK brown fox jumps over the lazy dog while, seven"), (6, "nowhere at all"), (5, "the quick brown fox jumps over the lazy dog while seven")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    windows = {}
    for i, t in items:
        w = _norm(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    want = []
    for i, t in pairs:
        w, hit, ids = _norm(t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= owners
        want.append((i, len(w), len(hit), sorted(ids)))
    for limit in (10**6, 0):
        got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.decontaminate(docs, bench, max_broadcast=limit).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[2] for w in want)


def test_decontaminate_empty(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).count() == 0
    assert decontaminate.decontaminate(docs, none).where("n_hit > 0").count() == 0


def _statistics(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k:k + 3]), []).append(k)
    rep = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


def test_quality_statistics_and_score(spark, docs, pairs):
    trusted = spark.createDataFrame([(1,), (9,)], "id long")
    got = quality.judge(docs, trusted, buckets=64).collect()
    assert len(got) == len(pairs)
    signed = lambda v: v - 2**64 if v >> 63 else v
    h = lambda a, s=42: xxhash.xxh64_intdigest(a.encode(), s)

    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        return [signed(h(x)) % 64 for x in w] + [signed(h(b, h(a))) % 64 for a, b in zip(w, w[1:])]

    import math
    from collections import Counter

    raw, target = Counter(), Counter()
    for i, t in pairs:
        g = Counter(grams(t))
        raw += g
        if i in (1, 9):
            target += g
    share = sum(target.values()) / sum(raw.values())
    weight = {b: math.floor((math.log(target[b] + quality.SMOOTHING) - math.log(raw[b] * share + quality.SMOOTHING)) * quality.UNIT + 0.5) for b in raw}
    want = []
    for i, t in pairs:
        s, g = _statistics(t), grams(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        score = sum(weight[b] for b in g) / (len(g) * quality.UNIT) if g else 0.0
        want.append((str(i), *s, failed, round(score, 5), not failed and score >= quality.THRESHOLD))
    mine = [(str(r["id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], round(r["score"], 5), r["kept"]) for r in got]
    assert sorted(mine) == sorted(want)


def test_quality_without_trust(spark, docs, empty):
    none = spark.createDataFrame([], "id long")
    assert {r["score"] for r in quality.judge(docs, none).collect()} == {0.0}
    assert quality.judge(empty, none).count() == 0


URLS = [None, "", "nothing", "http://A.Example.NET/en/x?y", "https://example.com/de/1#z", "http://www.example.com/de", "http://x.org/fr/", "http://x.org/fr", "ftp://net/", "http://net", "http://spam-farm.example.org/a.html?u=http://b", "https://www.spam-farm.example.org/a/", "http://h?q/x", "a://b://c/d"]


def _rule(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit, key=lambda f: len(f[0]), default=(None, None))
    return host, path, *rule


@pytest.mark.parametrize("megabytes", [64, 0])
def test_urls(spark, megabytes):
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(URLS)], "page_id long, url string, html string, block int")
    listed = pages.where(F.col("url").contains("spam-farm") & F.col("url").contains("http:")).select("url")
    got = {r["page_id"]: r for r in urls.judge(pages, listed, max_broadcast_mb=megabytes).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule, verdict = _rule(u)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["listed"] == ("spam-farm" in (u or "")) and not (r["listed"] and not r["maybe"])
        assert r["verdict"] == (verdict or ("block" if r["listed"] else "allow"))


def test_the_filter_passes_every_listed_url_and_few_others(spark):
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example.com/"), F.col("id")).alias("url"))
    out = urls.listed_urls(pages, pages.where("page_id < 2000").select("url"))
    n = out.agg(F.count_if("listed").alias("l"), F.count_if("maybe").alias("m"), F.count_if(F.expr("listed and not maybe")).alias("bad")).first()
    assert n["l"] == 2000 and n["bad"] == 0 and n["m"] < 2100


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, pages.select("url")).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(one, pages.select("url")).collect()] == ["allow"]
