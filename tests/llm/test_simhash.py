import random

import numpy as np

from tessella.llm import simhash
from tessella.llm.components import components

from .brute import near_components
from .brute import simhash as plain


def test_fingerprints_and_components(docs, pairs):
    got = [(r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(pairs)
    want = near_components([(i, t) for i, t in pairs if i is not None])
    assert {g for g in got if g[0] is not None} == want
    assert [g[1] for g in got if g[0] is None] == [f"{plain(pairs[-2][1]):016x}"]
    assert {g[2] for g in got if g[0] in (4, 5, 6)} == {4}


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids.count(12) == 0 and ids.count(11) == 1 and 4 in ids and 5 not in ids


def test_links_are_those_of_all_pairs():
    r = random.Random(9)
    base = r.getrandbits(64)
    x = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(700)} | {r.getrandbits(64) for _ in range(300)}
    x = np.array(sorted(x), np.uint64)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    for direct in (2048, 50):
        i, j = simhash.links_among(x, 2**64 - 1, direct=direct)
        assert set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())) == want


def test_tables_miss_no_link(spark):
    r = random.Random(2)
    near = [r.getrandbits(64) for _ in range(200)]
    both = near + [a ^ sum(1 << b for b in r.sample(range(64), 3)) for a in near]
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in set(both)], "fp long")
    links = {frozenset((l["a"], l["b"])) for l in simhash.near_links(df).collect()}
    roots = {r["a"]: r["b"] for r in components(simhash.near_links(df)).collect()}
    of = lambda v: roots.get(signed(v), signed(v))
    assert links and all(of(a) == of(b) for a, b in zip(near, both[200:]))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["a"]: r["b"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components(links.where("a < 0")).count() == 0


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_large_buckets_are_dealt_out_again(spark):
    """Many fingerprints that agree in most bits: with buckets split before the shuffle the components are those without."""
    r = random.Random(6)
    base = r.getrandbits(64)
    x = {base ^ (r.getrandbits(20) << r.choice((0, 22, 44))) for _ in range(1500)} | {r.getrandbits(64) for _ in range(200)}
    x = np.array(sorted(x), np.uint64)
    signed = x.view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    i, j = simhash.links_among(x, 2**64 - 1)
    root = simhash.stars(len(x), i, j)
    want = {}
    for k, v in zip(root.tolist(), signed):
        want.setdefault(k, set()).add(v)
    for most in (1 << 16, 40):
        of = {r["a"]: r["b"] for r in components(simhash.near_links(df, most=most)).collect()}
        got = {}
        for v in signed:
            got.setdefault(of.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_row_stays_of_rows_without_ids_too(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "quite other words here"), (4, "a b c d"), (7, "some text of seven"), (7, "no copy of anything else"), (7, "some text of seven")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == [(4, "a b c d"), (7, "no copy of anything else"), (7, "some text of seven"), (None, "quite other words here")]


def test_few_links_make_few_tables(spark, monkeypatch):
    """Links of one task's size are joined in one task, after the rounds that bring them to it; the result is that of the rounds alone."""
    from tessella.llm import components as module

    r, made, before = random.Random(8), [], module.written
    pairs = [(k, k + 1) for k in range(-40, 60)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(5, 5), (-(1 << 63), 3000), (3000, (1 << 63) - 1)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    monkeypatch.setattr(module, "written", lambda *x: made.append(1) or before(*x))
    found = {}
    for most in (1000, 120, -1):
        monkeypatch.setattr(module, "ONE_TASK", most)
        made.clear()
        found[most] = sorted(map(tuple, components(links).collect()))
        assert most != 1000 or len(made) == 2
    assert found[1000] == found[120] == found[-1] and (59, -40) in found[1000] and ((1 << 63) - 1, -(1 << 63)) in found[1000]
