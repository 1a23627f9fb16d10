"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed. Strings never
cross documents, and are judged on the input.

Equal strings must meet in one place. The smallest hashed ``length // 4``-gram of a string (its minimizer) is at the same offset in every
copy, so the bytes around it are the same in all copies; the hash of that context is the string's key. Neighbouring strings with one
context form a fragment of the text, some 70 bytes for 20 strings. Blocks (see ``blocks``) first find out which
contexts another block has too; the fragments of those, each distinct one once for each block, go to hash buckets. There a BWT of the bucket's
fragments is built, and breadth-first backward extension derives common prefixes by increasing value: the intervals of the prefixes of
one more byte follow from those of the last round through the BWT, and rounds stop at ``length``. Each interval then
holds the suffixes with one prefix of that length; its smallest document id goes back to the blocks.

Bounds: a bucket's distinct fragments are expanded in parts of ``PART_BYTES``, split by key; a single key above that (very many
different surroundings of one context) is split by the strings themselves. Both are exact.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; a null id counts as larger than every other, and rows with
equal (or null) ids take nothing from each other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import table, written

U = np.uint64
SEGMENT = 1 << 20
PART_BYTES = 1 << 19
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict = {}


def _powers_of(base: int, n: int):
    """base^i and base^-i modulo 2^64, for i below n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        got = tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(b))])) for b in (base, inverse))
        _powers[base] = got
    return got


class Fragments:
    """Of a block: start and count (first string, how many) and key of each fragment, with two hashes of its bytes."""

    def __init__(self, block: B.Block, length: int):
        data = np.frombuffer(block.data, "u1")
        parts = [self._segment(data[a:a + SEGMENT + length - 1], block.starts - a, length) for a in range(0, max(1, len(data)), SEGMENT)]
        self.start = np.concatenate([p[0] + k * SEGMENT for k, p in enumerate(parts)])
        self.count, self.key, self.h1, self.h2 = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        self.of = np.searchsorted(block.starts, self.start, "right") - 1

    @staticmethod
    def _segment(x: np.ndarray, starts: np.ndarray, length: int):
        gram = length // 4
        width = length - gram + 1
        half = width // 2
        n = len(x) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, U)
        sums, inverses = [], []
        for base in (BASE1, BASE2):
            up, down = _powers_of(base, SEGMENT + length)
            sums.append(np.concatenate([[U(0)], np.cumsum((x.astype(U) + U(1)) * up[:len(x)])]))
            inverses.append(down)

        def hashed(k, a, b):
            return B.mix((sums[k][b] - sums[k][a]) * inverses[k][a])

        grams = len(x) - gram + 1
        h = B.mix((sums[0][gram:] - sums[0][:grams]) * inverses[0][:grams])
        h = (h & ~U(0xFFFFFFFF)) | np.arange(grams, dtype=U)  # ties go to the leftmost
        have = 1
        while have * 2 <= width:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        if have < width:
            h = np.minimum(h[:len(h) - (width - have)], h[width - have:])
        p = (h[:n] & U(0xFFFFFFFF)).astype(np.int64)
        s = np.arange(n)
        inside = np.clip(starts, 0, len(x))
        of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(inside))
        valid = of[:n] == of[length - 1:length - 1 + n]
        left = p - s >= half
        turn = np.ones(n, bool)
        turn[1:] = (p[1:] != p[:-1]) | (left[1:] != left[:-1]) | (valid[1:] != valid[:-1]) | (of[1:n] != of[:n - 1])
        first = np.flatnonzero(turn)
        count = np.diff(np.append(first, n))
        keep = valid[first]
        first, count = first[keep], count[keep]
        p, left = p[first], left[first]
        a = np.where(left, p - half, p)
        b = np.where(left, p + gram, p + length - half + 1)
        key = hashed(0, a, b) ^ np.where(left, U(0), U(0x5BF03635DEADBEEF))
        end = first + count + length - 1
        return first, count, key, hashed(0, first, end), hashed(1, first, end)


def expand(fragments: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of each fragment, in order: the smallest id of the fragments that have it."""
    size = np.array([len(f) for f in fragments], np.int64)
    text = np.frombuffer(b"\0".join(fragments) + b"\0", "u1").astype(np.int64) + 1
    ends = np.cumsum(size + 1) - 1
    text[ends] = 0  # a separator ends each fragment; separators differ, in the order of the fragments
    n = len(text)
    # Suffix order by doubling; what follows a separator doesn't count.
    alive, key, depth = np.ones(n, bool), np.zeros(n, U), 7
    for k in range(depth):
        c = np.zeros(n, np.int64)
        c[:n - k] = text[k:] if k else text
        key = (key << U(9)) | np.where(alive, c, 0).astype(U)
        alive &= c != 0
    to_end = np.repeat(ends, size + 1) - np.arange(n)  # bytes before the separator
    while True:
        order = np.argsort(key)
        rank = np.empty(n, U)
        ordered = key[order]
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]).astype(U)
        if depth > to_end.max():
            break
        after = np.zeros(n, U)
        after[:n - depth] = rank[depth:]
        key = (rank << U(32)) | np.where(to_end >= depth, after, U(0))
        depth *= 2
    suffixes = (np.sort((rank << U(32)) | np.arange(n, dtype=U)) & U(0xFFFFFFFF)).astype(np.int64)
    bwt = text[suffixes - 1].astype(np.uint16)
    # Backward extension: the i-th suffix is its first byte before the suffix at back[i].
    back = np.argsort(bwt, kind="stable").astype(np.int32)
    head = bwt[back]
    bound = np.ones(n, np.int32)  # 1 where an interval of the current prefix length begins
    bound[1:] = (head[1:] != head[:-1]) | (head[1:] == 0)
    open_ = np.flatnonzero(bound == 0)
    mine, before = back[open_], back[open_ - 1]
    for _ in range(length - 1):
        if not len(open_):
            break
        interval = np.cumsum(bound, dtype=np.int32)
        parted = interval[mine] != interval[before]
        bound[open_[parted]] = 1
        stay = ~parted
        open_, mine, before = open_[stay], mine[stay], before[stay]
    whole = to_end[suffixes] >= length
    owner = np.where(whole, np.repeat(ids, size + 1)[suffixes], B.NULL_ID)
    first = np.flatnonzero(bound)
    least = np.empty(n, np.int64)
    least[suffixes] = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, n)))
    return least[to_end >= length]


def expand_parts(fragments: list[bytes], keys: np.ndarray, ids: np.ndarray, length: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """``expand`` in parts of bounded size; keys are sorted, and equal strings have equal keys."""
    size = np.array([len(f) + 1 for f in fragments], np.int64)
    out, a = [], 0
    ends = np.cumsum(size)
    tops = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))  # ends of runs of one key
    while a < len(keys):
        limit = (ends[a - 1] if a else 0) + part_bytes
        fits = tops[(tops > a) & (ends[np.minimum(tops, len(keys)) - 1] <= limit)]
        b = int(fits[-1]) if len(fits) else int(tops[tops > a][0])
        if len(fits) or ends[b - 1] <= limit:
            out.append(expand(fragments[a:b], ids[a:b], length))
        else:
            out.append(_expand_strings(fragments[a:b], ids[a:b], length, part_bytes))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _expand_strings(fragments, ids, length, part_bytes):
    """One key alone is too large: each string apart, in parts by a checksum of it, so that equal ones stay together."""
    owners = np.repeat(ids, [len(f) - length + 1 for f in fragments])
    strings = [f[i:i + length] for f in fragments for i in range(len(f) - length + 1)]
    import zlib

    parts = -(-len(strings) * (length + 1) // part_bytes)
    part = np.array([zlib.crc32(s) % parts for s in strings])
    least = np.empty(len(strings), np.int64)
    for k in range(parts):
        at = np.flatnonzero(part == k)
        if len(at):
            least[at] = expand([strings[i] for i in at], owners[at], length)
    return least


def remove_repeated(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, bucket_bytes: int = B.BUCKET_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, spans array<struct<from,to>> of removed bytes, kept binary: the rest)."""
    packed = B.pack(docs, id_col, text_col, block_bytes)
    raw = B.total_raw(packed)
    bits, buckets = B.key_bits(raw / 8), B.buckets_for(raw, bucket_bytes)

    def candidates(block: B.Block, answers: dict):
        """The fragments that may repeat; the distinct ones in order of key: their places among those, ids and keys; and each one's place."""
        f = Fragments(block, length)
        if len(f.key):
            keep = B.seem_shared(f.key, bits, buckets, answers.get(1, []))
            f.start, f.count, f.key, f.h1, f.h2, f.of = (v[keep] for v in (f.start, f.count, f.key, f.h1, f.h2, f.of))
        own = block.ids[f.of]
        order = np.lexsort((own, f.h2, f.h1, f.key))
        new = np.ones(len(order), bool)
        for v in (f.key, f.h1, f.h2):
            same = v[order][1:] == v[order][:-1]
            new[1:] = ~same if v is f.key else new[1:] | ~same
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return f, order[new], own, place

    def send(key, block, answers):
        f, lead, own, _ = candidates(block, answers)
        parts = B.runs(B.bucket_of(f.key[lead], 64, buckets)) if len(lead) else []
        bits_of = lambda x, y: [block.data[a:a + c + length - 1] for a, c in zip(f.start[lead[x:y]].tolist(), f.count[lead[x:y]].tolist())]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([key] * len(parts), pa.int64()),
            "keys": pa.array([B.pack_sorted(f.key[lead[x:y]]) for _, x, y in parts], pa.binary()), "counts": pa.array([B.planes(f.count[lead[x:y]].astype("<u2")) for _, x, y in parts], pa.binary()),
            "ids": pa.array([B.planes(own[lead[x:y]]) for _, x, y in parts], pa.binary()), "data": pa.array([zstandard.compress(b"".join(bits_of(x, y)), 1) for _, x, y in parts], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        keys, ids, sent = [], [], []
        for k, c, i, d in zip(*(t[name] for name in ("keys", "counts", "ids", "data"))):
            sizes = B.unplanes(c.as_py(), "<u2").astype(np.int64) + length - 1
            ends = np.cumsum(sizes)
            data, mine = zstandard.decompress(d.as_py()), np.empty(len(sizes), np.int64)
            for j, (a, b, key, own) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), B.unpack_sorted(k.as_py()).tolist(), B.unplanes(i.as_py(), "<i8").tolist())):
                bit = data[a:b]
                at = distinct.setdefault(bit, len(keys))
                if at == len(keys):
                    keys.append(key)
                    ids.append(own)
                elif own < ids[at]:
                    ids[at] = own
                mine[j] = at
            sent.append(mine)
        keys, ids, bits_ = np.array(keys, U), np.array(ids, np.int64), list(distinct)
        order = np.argsort(keys, kind="stable")
        least = expand_parts([bits_[j] for j in order.tolist()], keys[order], ids[order], length, part_bytes)
        counts = np.array([len(b) for b in bits_], np.int64) - length + 1
        at = np.empty(len(keys), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        out = [B.planes(least[spread(at[m], counts[m])]) for m in sent]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "kind": pa.array([2] * len(t), pa.int32()), "answer": pa.array(out, pa.binary())})

    def apply(key, block, answers):
        f, lead, own, place = candidates(block, answers)
        least = np.concatenate([B.unplanes(x, "<i8") for _, x in sorted(answers.get(2, []))] or [np.zeros(0, np.int64)])
        counts = f.count[lead]
        if len(least) != counts.sum():
            raise RuntimeError(f"block {key}: {len(least)} answers to {counts.sum()} strings")
        at = np.cumsum(counts) - counts
        strings = spread(f.start, f.count)
        gone = strings[least[spread(at[place], f.count)] < np.repeat(own, f.count)]
        n = len(block.data)
        edge = np.zeros(n + 1, np.int32)
        edge[gone] = 1
        np.subtract.at(edge, gone + length, 1)
        removed = np.cumsum(edge[:n]) > 0
        data, kept, spans, n_removed = np.frombuffer(block.data, "u1"), [], [], []
        for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            mine = removed[a:b]
            if mine.any():
                kept.append(data[a:b][~mine].tobytes())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                spans.append([{"from": int(x), "to": int(y)} for x, y in turn.reshape(-1, 2)])
                n_removed.append(int(mine.sum()))
            else:
                kept.append(block.data[a:b])
                spans.append([])
                n_removed.append(0)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.RecordBatch.from_pydict({"id": block.column_of_ids(), "n_bytes": pa.array(np.diff(block.starts)), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    one = written(B.shared_bits(packed, lambda block: Fragments(block, length).key, bits, buckets), "answers")
    sent = B.with_answers(packed, one, send, "bucket long, block long, keys binary, counts binary, ids binary, data binary")
    two = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, kind int, answer binary")
    return B.with_answers(packed, one.unionByName(two), apply, "id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def op1_suffix_dedup(spark, sf_dir):
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
lead AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN lead USING (k) WHERE f < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
part AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS tail FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
