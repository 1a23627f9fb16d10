import numpy as np
import pandas as pd
import pytest

from tessella.llm import pii, toxicity
from tessella.llm.tagger import BARRED, BARRED_FIRST, TAGS, Tagger


def test_gradient():
    t, r = Tagger(4, 3), np.random.default_rng(0)
    x, y = r.integers(0, 130, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 4], [0] * 7, [5, 6, 6, 0, 7, 8, 0]])
    _, g = t.loss_and_gradient(x, y)
    for n in t.p:
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in t.p[n].shape)
            if n == "a" and BARRED[i] or n == "first" and BARRED_FIRST[i]:
                continue
            old, side = t.p[n][i], []
            for d in (1e-5, -1e-5):
                t.p[n][i] = old + d
                side.append(t.loss_and_gradient(x, y)[0])
            t.p[n][i] = old
            assert abs((side[0] - side[1]) / 2e-5 - g[n][i]) < 1e-6


def test_viterbi_is_the_best_of_all_sequences():
    from itertools import product

    t, r = Tagger(3, 2, seed=1), np.random.default_rng(1)
    t.p["a"] = r.normal(0, 1, t.p["a"].shape)
    rows = r.integers(0, 130, (2, 4))
    s, (a, first) = t._scores(rows)[-1], t._rules()
    score = lambda k, seq: first[seq[0]] + sum(s[i, k, c] for i, c in enumerate(seq)) + sum(a[x, y] for x, y in zip(seq, seq[1:]))
    for k, got in enumerate(t.tag(rows)):
        assert tuple(got) == max(product(range(len(TAGS)), repeat=4), key=lambda q: score(k, q))


def _naive(t):
    import re

    e, i = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    c, p = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda m: "".join(x for x in m[0] if x in "0123456789")
    out = [("email", m.start(), m.end()) for m in re.finditer(e, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(i, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(c, t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(p, t) if 8 <= len(digits(m)) <= 15]


def test_patterns(pairs):
    import random

    r = random.Random(2)
    some = ["".join(r.choice("a.@-+1 27(0)é_%\n") for _ in range(r.randint(0, 40))) for _ in range(30000)]
    for t in [*some, *(t or "" for _, t in pairs), "1.2.3.004", "1.2.3.0256", "x@a.b@c.d", "4111-1111 11111111"]:
        assert pii.pattern_spans(t) == _naive(t), t


def test_patterns_take_time_in_proportion():
    import time

    began = time.time()
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " + " " * 200_000):
        pii.pattern_spans(t)
    assert time.time() - began < 10


@pytest.fixture(scope="module")
def tagger():
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"]).text
    return pii.fit([t[:5000] for t in texts[texts.str.contains("[0-9@]", regex=True)]])


def test_tagger_on_items_it_has_not_seen(tagger):
    r = np.random.default_rng(99)
    hit = n = wrong = clean = 0
    for _ in range(400):
        kind, item = pii._generated(r)
        text = f"some words before it {item} and words after"
        ((base, added),) = pii.find_all([text], tagger)
        found = [(k, text[a:b]) for k, a, b in base + added]
        if kind:
            n += 1
            hit += (kind, item) in found
        else:
            clean += 1
            wrong += bool(found)
    assert hit / n > 0.8 and wrong / clean < 0.1


def test_long_texts_and_windows_edges(tagger):
    item = "+1 (310) 555-4510"
    for pad in range(20, 100, 7):
        text = "lorem ipsum " * 3000 + "x" * pad + " (415) 555-2671 , " + "y" * 50 + item
        ((base, added),) = pii.find_all([text], tagger)
        assert [text[a:b] for _, a, b in base] == [item]
        assert all(text[a:b] == "(415) 555-2671" for _, a, b in added)


def test_find_and_mask(docs, empty, tagger, pairs):
    got = {r["id"]: r for r in pii.find(docs, tagger).collect()}
    assert [s["kind"] for s in got[13]["base"]] == ["email", "ip", "card", "phone"]
    assert not got[4]["base"] and not got[5]["added"] and not got[9]["added"]
    masked = pii.mask(docs, tagger)
    assert masked.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert rows[13] == "écrit à [EMAIL] ou [PHONE], carte [CARD], hôte [IP]"
    assert rows[5] is None and rows[1] == pairs[0][1]
    assert pii.mask(empty, tagger).count() == 0 and pii.find(empty, tagger).count() == 0


def test_mask_of_overlapping_spans():
    assert pii.mask_text("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.with_score(out.select("doc_id", "text"), toxicity.learn(out, labels))
    held = scored.join(labels, "doc_id").where(toxicity.held_out(scored["doc_id"])).toPandas()
    said = held.score >= 0.5
    # Of the texts labelled toxic a good half has a word that marks it; the others can't be told from ordinary ones.
    assert held.toxic[said].mean() > 0.85 and said[held.toxic == 0].mean() < 0.02 and said[held.toxic == 1].mean() > 0.5


def test_toxicity_cases(spark, docs, empty, pairs):
    import random

    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def text(marks):
        return " ".join(r.choice(marks) if marks and r.random() < 0.15 else r.choice(vocabulary) for _ in range(r.randint(40, 120)))

    bad = ["idiot", "moron", "stupid", "clown"]
    model = toxicity.fit([(text(bad), 1) for _ in range(60)] + [(text([]), 0) for _ in range(120)])
    score = model.scorer()
    said = [[score(text(m).encode()) >= 0.5 for _ in range(40)] for m in (bad, [])]
    assert sum(said[0]) >= 34 and sum(said[1]) <= 3
    out = toxicity.with_score(docs.drop("score"), model)
    assert out.columns == [*docs.drop("score").columns, "score"]
    got = out.collect()
    assert len(got) == len(pairs) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.with_score(empty.drop("score"), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.with_score(docs.drop("score"), toxicity.learn(docs, none)).collect()} == {0.0}


def test_toxic_words_of_a_rare_language_have_entries():
    import random

    r = random.Random(5)
    words = [["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(400)] for letters in ("abcdefghilmno", "prstuvwxyzáé")]
    marks = [["idiot", "moron", "stupid", "clown"], ["bométei", "zúrrapo"]]

    def text(k, bad):
        return " ".join(r.choice(marks[k]) if bad and r.random() < 0.15 else r.choice(words[k]) for _ in range(80))

    rows = [(text(0, True), 1) for _ in range(300)] + [(text(1, True), 1) for _ in range(7)] + [(text(k, False), 0) for k in (0, 1) for _ in range(600)]
    model = toxicity.fit(rows)
    held = b"".join(v for v in vars(model).values() if isinstance(v, bytes) and v is not model.ordinary)
    assert all(w.encode() in held for w in marks[1])
    score = model.scorer()
    said = [[score(text(1, bad).encode()) >= 0.5 for _ in range(30)] for bad in (True, False)]
    assert sum(said[0]) >= 25 and sum(said[1]) <= 3


def test_runs_are_decoded_as_one_sequence():
    """A batch of runs, and a long run as a stream, give what a plain Viterbi search over the joined emissions gives."""
    t, r = Tagger(3, 4, seed=2), np.random.default_rng(4)
    t.p["a"] = r.normal(0, 1, t.p["a"].shape)
    a, first = t._rules()

    def plain(e):
        score, back = first + e[0], []
        for row in e[1:]:
            step = score[:, None] + a
            back.append(step.argmax(0))
            score = step.max(0) + row
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    runs = [r.normal(0, 2, (n, len(TAGS))) for n in (64, 1, 300, 96, 64, 7)]
    assert [list(x) for x in t.best(runs)] == [plain(e) for e in runs] and t.best([]) == []
    for e in runs:
        for size in (1, 50, 1000):
            assert np.concatenate(list(t.stream(e[k:k + size] for k in range(0, len(e), size)))).tolist() == plain(e)


def test_items_are_found_alike_in_long_runs_and_short_ones(tagger):
    """Windows that hang together for longer than any internal size, with an item at every offset of a window."""
    item, pad = "(415) 555-2671", "word 1 and x2 then "
    for n in (3, 200, 700):
        for shift in (0, 5, 13, 29):
            text = pad * n + "y" * shift + " call " + item + " now. " + pad * n
            assert len(pii.runs_of(pii.window_starts(text))) == 1
            ((base, added),) = pii.find_all([text], tagger)
            short = "y" * shift + " call " + item + " now. "
            assert not base and ("phone", text.index(item), text.index(item) + len(item)) in added, (n, shift, short)
            assert len(added) == len(set(added)) and all(x[2] <= y[1] for x, y in zip(added, added[1:]))


def test_clashing_names_pass_through_or_give_way(spark, tagger):
    docs = spark.createDataFrame([(1, "mail a.b@c.de", "x", "y", 2.0)], "doc_id long, text string, __masked string, __text string, score double")
    row = pii.mask(docs, tagger).first()
    assert row.asDict() == {"doc_id": 1, "text": "mail [EMAIL]", "__masked": "x", "__text": "y", "score": 2.0}
    model = toxicity.fit([("a b c", 0)])
    out = toxicity.with_score(docs, model)
    assert out.columns == ["doc_id", "text", "__masked", "__text", "score"] and out.first()["score"] == 0.0
    assert toxicity.reject(docs, model).columns == docs.columns


def test_score_is_that_of_a_plain_version():
    """Lengths of windows behind both dictionaries, their log-likelihood ratios summed, and the logistic of it, written out."""
    import math
    import random

    import zstandard

    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join(r.choice(["worthless", "idiot"]) if bad and r.random() < 0.2 else r.choice(vocabulary) for _ in range(60))
    model = toxicity.fit([(text(True), 1) for _ in range(50)] + [(text(False), 0) for _ in range(100)])
    score = model.scorer()

    def length(content, window):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=6, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(window))

    for t in (text(True), text(False), "", "É  IDIOT\n\tidiot É", "x" * 500):
        norm = (" " + " ".join("".join(c.lower() if c.isascii() else c for c in t).split()) + " ").encode()
        cuts, at = [], 0
        while True:
            cuts.append(norm[at:at + 64])
            at += 48
            if at >= len(norm) - 16:
                break
        total = 0.0
        for w in cuts:
            d = max(-8, min(12, length(model.ordinary, w) - length(model.toxic + model.ordinary, w)))
            total += model.ratio[d + 8]
        z = model.weight[0] + model.weight[1] * total + model.weight[2] * math.log(len(cuts))
        assert abs(score(t.encode()) - 1 / (1 + math.exp(-z))) < 1e-9
