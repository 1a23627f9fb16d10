import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import suffix_dedup, token_windows

from .brute import repeated_bytes, repeated_words


def _bytes(df):
    return Counter((r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect())


def _words(df):
    return Counter((r["id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect())


def test_bytes(docs, pairs):
    assert _bytes(suffix_dedup.remove_repeated(docs)) == Counter(repeated_bytes(pairs))


@pytest.mark.parametrize("block,part", [(200, 300), (5000, 700)])
def test_bytes_in_small_blocks_and_parts(docs, pairs, block, part):
    got = suffix_dedup.remove_repeated(docs, block_bytes=block, bucket_bytes=2000, part_bytes=part)
    assert _bytes(got) == Counter(repeated_bytes(pairs))


def test_words(docs, pairs):
    assert _words(token_windows.remove_repeated(docs)) == Counter(repeated_words(pairs))
    assert _words(token_windows.remove_repeated(docs, block_bytes=300, bucket_bytes=1000)) == Counter(repeated_words(pairs))


def test_empty(empty):
    assert suffix_dedup.remove_repeated(empty).count() == 0
    assert token_windows.remove_repeated(empty).count() == 0


def test_expansion_finds_the_least_id_of_every_string():
    r = random.Random(4)
    for length in (32, 50):
        base = "".join(r.choice("ab") for _ in range(300))
        fragments = list({base[a:a + length + r.randint(0, 30)].encode() for a in (r.randint(0, 200) for _ in range(60))})
        ids = np.array([r.randint(0, 9) for _ in fragments])
        least = {}
        for f, i in zip(fragments, ids):
            for k in range(len(f) - length + 1):
                least[f[k:k + length]] = min(least.get(f[k:k + length], 99), i)
        want = [least[f[k:k + length]] for f in fragments for k in range(len(f) - length + 1)]
        assert suffix_dedup.expand(fragments, ids, length).tolist() == want
        assert suffix_dedup._expand_strings(fragments, ids, length, 500).tolist() == want
