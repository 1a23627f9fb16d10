import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tessella.llm import pieces, token_files  # noqa: E402
from tessella.llm.common import scratch  # noqa: E402

BPE, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", "a  b", " a", "a ", "<|endoftext|> x", "日本 語", " \n\n x", "it's 12 a b", "\n a", "x \n y", "a\t\tb c", "é ß²³ x", "a\n", "\xa0 x", "(a) don't foo.\nBar ×2÷3 ªº ¼a", "abc***def", "a\x00b", "Ġ Ġa"]


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(0)
    docs = [np.array(r.integers(0, 30, int(r.integers(0, 200))), "<u4").tobytes() for _ in range(300)] + [np.zeros(500, "<u4").tobytes(), b""]
    s = token_files.Shard(token_files.pack_shard([None, *range(1, 302)], docs, 50257))
    end = b"\2\0\0\0"
    assert s.all().tobytes() == b"".join(d + end for d in docs) and len(s.rules) and len(s.symbols) < 0.7 * len(s.all())
    assert s.nulls[0] and not s.nulls[1]
    for k in (0, 7, 300, 301):
        want = np.frombuffer(docs[k] + end, "<u4")
        assert (s.document(k) == want).all() and (s.document(k, 3, 17) == want[3:17]).all()


def test_encoder_gives_what_the_library_gives(pairs):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(BPE), token_files.Encoder(BPE)
    r = random.Random(1)
    some = ["".join(r.choice(["a", "Be", " ", "\n", "'s", "1", "é", "#", ".", ",", "ñ"]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts = [*ODD, *some, *(t or "" for _, t in pairs)]
    for _ in range(2):
        assert encoder(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files(spark, docs, pairs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    manifest = token_files.write_tokens(docs, BPE, scratch(spark, "t"), partition_bytes=20000, shard_tokens=9000)
    assert manifest.count() > 2
    got = sorted(((r["id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.read_tokens(manifest).collect()), key=lambda x: x[1])
    want, at = [], 0
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_tokens(token_files.write_tokens(empty, BPE, scratch(spark, "t"))).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(MODEL)


def _best(v, s):
    """The whole table, from left to right."""
    score, back = [0] + [None] * len(s), [0] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for k in range(1, min(v.longest, e) + 1):
            p = v.pieces.get(s[e - k:e])
            z = score[e - k] + p[1] if p else score[e - 1] + v.unknown if k == 1 else None
            if z is not None and (score[e] is None or z >= score[e]):
                score[e], back[e] = z, e - k
    out, e = [], len(s)
    while e:
        w = s[back[e]:e]
        out[:0] = [v.pieces[w][0]] if w in v.pieces else [v.byte_ids[b] for b in w.encode()]
        e = back[e]
    return out


def test_streaming_search_is_the_best_path(vocabulary):
    r = random.Random(3)
    for _ in range(200):
        s = "".join(r.choice("aeinrst▁hlo日e") for _ in range(r.randint(1, 500)))
        assert list(vocabulary.search([s])) == _best(vocabulary, s) == list(vocabulary.search(list(s)))


def test_search_commits_as_it_reads(vocabulary):
    def endless():
        while True:
            yield "the quick brown fox"

    found = vocabulary.search(endless())
    assert len([next(found) for _ in range(10_000)]) == 10_000


def test_round_trip(vocabulary, docs, empty, pairs):
    texts = [*ODD, "▁x▁", "   ", "<s>", "<0x0A>", "a▁ b"]
    assert [vocabulary.decode(memoryview(c).cast("I")) for c in vocabulary.encode(texts)] == texts
    got = pieces.round_trip(docs, MODEL).collect()
    assert len(got) == len(pairs) and all(r["same"] for r in got)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text", "w"), MODEL), MODEL)
    assert back.columns == ["doc_id", "text", "w", "n_ids", "ids", "decoded"] and all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert pieces.round_trip(empty, MODEL).count() == 0


def test_ids_have_the_library_s_score_or_a_better_one(vocabulary):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces, searched by the library's own Viterbi
    other = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    words = sorted({w for t in open(__file__).read().split() for w in [t] if t.isascii()})
    same = 0
    for w, c in zip(words, vocabulary.encode(words)):
        mine, theirs = list(memoryview(c).cast("I")), other.encode(w)
        assert sum(map(other.get_score, mine)) >= sum(map(other.get_score, theirs))
        same += mine == theirs
    assert same > 0.9 * len(words)


def test_pairs_are_replaced_until_none_is_frequent():
    r = np.random.default_rng(3)
    one = r.integers(10, 50000, 1000).astype("<u4")
    s = token_files.Shard(token_files.pack_shard(list(range(2000)), [one.tobytes()] * 2000, 50257))
    assert len(s.symbols) == 4000 and (s.document(1999, 0, 1000) == one).all()
    # More rules than symbols of 16 bits have room for.
    pairs = r.permutation(40000)[:36000].astype("<u4").reshape(-1, 2)
    docs = [p.tobytes() for p in pairs for _ in range(8)]
    s = token_files.Shard(token_files.pack_shard(list(range(len(docs))), docs, 50257))
    assert len(s.rules) == 18000 and len(s.symbols) == 2 * len(docs)
    assert s.all().tobytes() == b"".join(d + np.array([2], "<u4").tobytes() for d in docs)



def test_search_of_a_whole_text_commits_at_its_spaces(vocabulary, pairs):
    for t in [*(t for _, t in pairs if t and "▁" not in t), "a b c", "one  two"]:
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        before = vocabulary.commits
        ids = list(vocabulary.search(iter(marked)))
        assert ids == list(memoryview(vocabulary.encode([t])[0]).cast("I"))
        # A commit at the front of every run of spaces; long runs of other characters add their own.
        assert vocabulary.commits - before >= len(pieces.CHUNK.findall(marked)) - 1


def test_no_frequent_pair_is_left():
    """On words that repeat with overlaps, the result of the rounds has no pair that occurs often, and the ids come back."""
    r = np.random.default_rng(5)
    words = [r.integers(0, 300, int(r.integers(2, 6))) for _ in range(400)]
    docs = [np.concatenate([words[int(k)] for k in (r.random(300) ** 3 * 400).astype(int)]).astype("<u4") for _ in range(60)]
    flat = np.concatenate([np.append(d, 50257) for d in docs]).astype("<u4")
    seq, rules, starts = token_files.repair(flat, 50257)
    inner = (seq[:-1] != 50257) & (seq[1:] != 50257)
    pairs, counts = np.unique(np.stack([seq[:-1][inner], seq[1:][inner]]), axis=1, return_counts=True)
    assert len(starts) > 4 and (counts[pairs[0] != pairs[1]] < token_files.MIN_COUNT).all()
    s = token_files.Shard(token_files.pack_shard(list(range(60)), [d.tobytes() for d in docs], 50257))
    assert (s.all() == np.where(flat == 50257, 2, flat)).all() and all((s.document(k)[:-1] == d).all() for k, d in enumerate(docs))


def test_words_of_up_to_sixteen_characters_are_encoded_once(monkeypatch):
    encoder, asked, before = token_files.Encoder(BPE), [], token_files.Encoder._words
    monkeypatch.setattr(encoder.known, "compute", lambda words: asked.extend(words) or before(encoder, words))
    texts = ["some extraordinarily understanding words", "words", ""]
    assert encoder(texts) == encoder(texts) == encoder._library(texts)
    assert asked.count(" understanding") == 1 and asked.count("some") == 1


def test_codes_of_parts_are_joined():
    import pyarrow as pa

    from tessella.llm.words import by_parts

    lists = [["a", "bb"], [], ["bb", "", "a", "a"], ["c"]]
    known = lambda words: [w.encode() * 4 for w in words]
    want = ["".join(w * 4 for w in x).encode() for x in lists]
    parts = pa.array(lists, pa.list_(pa.string()))
    assert by_parts(parts, known) == want and by_parts(parts.slice(1), known) == want[1:]
    assert by_parts(parts.slice(1, 1), known) == [b""] and by_parts(parts.slice(0, 0), known) == []


def test_a_task_gives_freed_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(pieces, "give_back", lambda: done.append(True))
    task = pieces._lean(iter)([1, 2])
    assert next(task) == 1 and not done
    assert list(task) == [2] and done == [True]
    stopped = pieces._lean(lambda batches: (b for b in batches))([1, 2])
    next(stopped)
    stopped.close()
    assert done == [True, True]
