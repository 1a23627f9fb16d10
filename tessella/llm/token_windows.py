"""Substring dedup by Rabin-Karp hashes of every window of ``n`` consecutive words, counted in Spark.

A word is a maximal run of bytes other than ASCII white space. Every window of every document gets two rolling polynomial hashes
modulo 2^64 (together 128 bits). First, windows are counted over all blocks by a cut of the first hash (see ``blocks``); then those
that repeat are grouped by both hashes, and each group's smallest document id goes back to the blocks that have the window.
A document loses each word covered by a window whose sequence also starts in a document with a smaller id; overlapping repeated windows
merge into maximal removal intervals. Windows are judged on the input, not on what is left.

Defined cases: a null text has no words; documents of fewer than ``n`` words lose nothing; a null id counts as larger than
every other (two null ids don't take words from each other); rows with equal ids don't either; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import table, written

U = np.uint64
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Windows:
    """words (all of the block), of (document of each word), at (first word of each window), h1 and h2."""

    def __init__(self, block: B.Block, n: int):
        split = [t.split() for t in block.texts()]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.words = [w for each in split for w in each]
        self.of = np.repeat(np.arange(len(split)), self.counts)
        index = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        values = np.frombuffer(b"".join(map(xxhash.xxh128_digest, index)), "<u8").reshape(-1, 2)
        flat = np.fromiter(map(index.__getitem__, self.words), np.int64, len(self.words))
        m = max(0, len(flat) - n + 1)
        self.at = np.flatnonzero(self.of[:m] == self.of[n - 1:]) if m else np.zeros(0, np.int64)
        self.h1, self.h2 = (self._roll(values[:, k], flat, n, m, U(BASES[k])) for k in (0, 1))

    def _roll(self, values, flat, n, m, base):
        v, h = values[flat], np.zeros(m, U)
        for k in range(n):
            h = h * base + v[k:k + m]
        return B.mix(h[self.at])


def _distinct(h1, h2, ids):
    """Distinct pairs in order with the smallest id of each; and for each input its pair's place."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return a[first], b[first], ids[order][first], place


def remove_repeated(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, spans array<struct<from,to>> of removed words, kept string: the rest joined by one space)."""
    packed = B.pack(docs, id_col, text_col, block_bytes)
    raw = B.total_raw(packed)
    bits, buckets = B.key_bits(raw / 4), B.buckets_for(raw, bucket_bytes)

    def candidates(block: B.Block, answers: dict):
        w = Windows(block, n)
        if len(w.at):
            keep = B.seem_shared(w.h1, bits, buckets, answers.get(1, []))
            w.at, w.h1, w.h2 = w.at[keep], w.h1[keep], w.h2[keep]
        return w, *_distinct(w.h1, w.h2, block.ids[w.of[w.at]])

    def send(key, block, answers):
        _, a, b, ids, _ = candidates(block, answers)
        parts = B.runs(B.bucket_of(a, 64, buckets)) if len(a) else []
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([key] * len(parts), pa.int64()),
            "h1": pa.array([B.pack_sorted(a[x:y]) for _, x, y in parts], pa.binary()), "h2": pa.array([b[x:y].tobytes() for _, x, y in parts], pa.binary()), "ids": pa.array([B.planes(ids[x:y]) for _, x, y in parts], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        h1 = [B.unpack_sorted(x.as_py()) for x in t["h1"]]
        cuts = np.cumsum([0, *map(len, h1)])
        h2 = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["h2"]])
        ids = np.concatenate([B.unplanes(x.as_py(), "<i8") for x in t["ids"]])
        _, _, least, place = _distinct(np.concatenate(h1), h2, ids)
        least = least[place]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "kind": pa.array([2] * len(t), pa.int32()), "answer": pa.array([B.planes(least[x:y]) for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())})

    def apply(key, block, answers):
        w, a, _, _, place = candidates(block, answers)
        least = np.concatenate([B.unplanes(x, "<i8") for _, x in sorted(answers.get(2, []))] or [np.zeros(0, np.int64)])
        if len(least) != len(a):
            raise RuntimeError(f"block {key}: {len(least)} answers to {len(a)} windows")
        gone = w.at[least[place] < block.ids[w.of[w.at]]] if len(a) else np.zeros(0, np.int64)
        edge = np.bincount(gone, minlength=len(w.words) + 1)[:len(w.words) + 1] - np.bincount(gone + n, minlength=len(w.words) + 1)[:len(w.words) + 1]
        removed = np.cumsum(edge)[:len(w.words)] > 0
        ends = np.cumsum(w.counts)
        kept, spans = [], []
        for end, count in zip(ends.tolist(), w.counts.tolist()):
            mine = removed[end - count:end]
            if mine.any():
                kept.append(b" ".join([w.words[i] for i in (np.flatnonzero(~mine) + (end - count)).tolist()]))
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                spans.append([{"from": int(x), "to": int(y)} for x, y in turn.reshape(-1, 2)])
            else:
                kept.append(b" ".join(w.words[end - count:end]))
                spans.append([])
        n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), np.minimum(ends - w.counts, len(removed))) * (w.counts > 0) if len(block) else np.zeros(0, np.int64)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.RecordBatch.from_pydict({"id": block.column_of_ids(), "n_words": pa.array(w.counts), "n_removed": pa.array(n_removed), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    one = written(B.shared_bits(packed, lambda block: Windows(block, n).h1, bits, buckets), "answers")
    sent = B.with_answers(packed, one, send, "bucket long, block long, h1 binary, h2 binary, ids binary")
    two = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, kind int, answer binary")
    return B.with_answers(packed, one.unionByName(two), apply, "id long, n_words long, n_removed long, spans array<struct<from:long,to:long>>, kept string")


def op5_token_windows(spark, sf_dir):
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(13)) AS k FROM least WHERE first < doc_id)),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
