import random
from itertools import combinations

import corpus_pipeline as C
import numpy as np

from tessella.llm import near_copies

SF = "/root/testdata/sf0.001"


def sets_of(texts):
    out = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = dict(C.STAGES)["simhash"](spark, docs, SF)
    assert kept.columns == docs.columns
    sets = sets_of([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert 150 < len(sets) < 200 and not [p for p in combinations(sets, 2) if near(sets[p[0]], sets[p[1]])]


def test_components_are_those_of_all_pairs(spark):
    r = random.Random(4)
    texts = []
    for _ in range(25):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(6):  # a chain: each a few words from the one before
            texts.append((len(texts), " ".join(words)))
            words = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 40)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    texts += [(900, None), (901, " \n"), (902, "")]
    sets = sets_of(texts)
    root = {k: k for k in sets}
    for a, b in sorted(combinations(sorted(sets), 2)):
        if near(sets[a], sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    groups = {}
    for x in near_copies.near_copies(docs).collect():
        groups.setdefault(x["root"], []).append(x["id"])
    want = {}
    for k, v in root.items():
        want.setdefault(v, []).append(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert sorted(x["doc_id"] for x in near_copies.keep_one(docs).collect()) == sorted(want)


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words stand in this one"), (None, "no id has this text here")], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["text"]) for x in near_copies.keep_one(docs).collect()), key=str)
    assert got == [(3, "a b c d e f"), (3, "other words stand in this one"), (None, "no id has this text here")]


def test_groups_of_another_operator_are_joined(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "no copy"), (4, "none either"), (5, "nor this"), (None, "nor this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    groups = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.when(F.col("doc_id").isin(2, 4), 7).otherwise(F.coalesce("doc_id", F.lit(99)) + 10).cast("long").alias("root"))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs, groups=groups).collect()) == [1, 3, 5]


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text, each with words of its own, some so many that they are near to a few others or to none: the pairs that are made grow with the group, not with its square."""
    r, made, before = random.Random(7), [], near_copies._likely
    base, texts = [f"w{k}" for k in range(160)], []
    for k in range(300):
        words = list(base)
        for at in r.sample(range(160), r.choice([0, 1, 2, 2, 3, 3, 4, 5, 6])):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append((k, " ".join(words)))

    def counted(pairs, *rest):
        made.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(near_copies, "_likely", counted)
    groups = {}
    for x in near_copies.near_copies(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect():
        groups.setdefault(x["root"], set()).add(x["id"])
    sets = sets_of(texts)
    root = {k: k for k in sets}
    for a, b in combinations(sets, 2):
        if near(sets[a], sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in root if root[k] == v) for v in root.values()}
    assert sum(made) < 10 * len(texts)


def test_sketches_never_rule_out_a_pair():
    r = random.Random(5)
    for _ in range(200):
        pool = [r.getrandbits(64) for _ in range(r.choice([3, 50, 3000]))]
        a, b = (np.unique(np.array(r.sample(pool, r.randint(1, len(pool))), np.uint64)) for _ in "ab")
        x, y = (near_copies.sketch(s).view(np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
