"""Blocks of documents and the exchange of hashed keys between them.

Substring operators compare every window of every document with all others. One row for each window would be some ten times the
text, so documents are packed into blocks of a few MB (a table in the shared folder), and a block sends its distinct keys to hash
buckets as sorted, delta-coded arrays: two to three bytes for each key. A bucket answers with one bit for each key sent
(does another block have it?). Only windows whose key is shared take part in what follows.

Every function here is deterministic for a given blocks table, so a lost task or executor is simply run again: the answer to a
block is aligned with the list that the block derives anew.

Scale: a hot key (a passage in a third of all documents) is one entry for each block, however often the block has it. Buckets
are sized by ``bucket_bytes`` of text, blocks by ``block_bytes``; both bound a task's memory whatever the input. A document larger than a
block is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: Stands for a null id: larger than any other, so nothing is removed on its account.
NULL_ID = np.iinfo(np.int64).max
U = np.uint64


class Block:
    """ids (int64, nulls as NULL_ID), nulls (bool), starts (int64, one more than documents) and data (bytes of all texts)."""

    def __init__(self, payload: bytes):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.nulls = np.frombuffer(raw, "u1", n, 8 + 8 * n).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 9 * n))])
        self.data = raw[8 + 17 * n:]

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self):
        return (self.data[a:b] for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()))

    def column_of_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n, raw, payload), written to the shared folder."""

    def run(batches):
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            nulls = np.array([i is None for i in ids], "u1")
            body = b"".join([np.int64(len(ids)).tobytes(), np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes(), nulls.tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), *texts])
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) | k], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "raw": pa.array([size], pa.int64()), "payload": pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary())})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if ids and size + len(t) > block_bytes:
                    yield row()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    each = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return written(each.mapInArrow(run, "block long, n long, raw long, payload binary"), "blocks")


def total_raw(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits (a bijection)."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def planes(a: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(a).view("u1").reshape(len(a), -1).T).tobytes())


def unplanes(blob: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u1")
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, "<u8"), dtype="u8")


def buckets_for(raw: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-raw // bucket_bytes))


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """By range, so that a bucket's part of a sorted array is one run."""
    top = keys >> U(bits - 32)
    return ((top * U(buckets)) >> U(32)).astype(np.int64)


def key_bits(n_keys: float) -> int:
    """Eight bits more than the keys need: about one key in 256 seems shared and isn't. What seems shared is compared in full later."""
    return int(min(64, max(33, np.ceil(np.log2(max(n_keys, 2))) + 8)))


def runs(buckets: np.ndarray):
    """(bucket, from, to) of each run of a sorted array."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    at = np.concatenate([[0], cuts, [len(buckets)]])
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:]) if b > a]


def sent_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The distinct keys of a block, cut to ``bits`` and sorted: what it sends, and what the answer's bits stand for."""
    return np.unique(keys >> U(64 - bits))


def shared_bits(blocks: DataFrame, keys_of, bits: int, buckets: int) -> DataFrame:
    """(block, bucket, kind 1, answer): for each key that a block sent, a bit that is 1 if another block has the key too."""

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                sent = sent_keys(keys_of(Block(payload.as_py())), bits)
                if len(sent):
                    parts = runs(bucket_of(sent, bits, buckets))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "keys": pa.array([pack_sorted(sent[a:b]) for _, a, b in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        sent = [unpack_sorted(k.as_py()) for k in table["keys"]]
        together = np.sort(np.concatenate(sent))
        shared = np.unique(together[1:][together[1:] == together[:-1]])
        bits_ = [zstandard.compress(np.packbits(member(s, shared)).tobytes(), 1) for s in sent]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([1] * len(sent), pa.int32()), "answer": pa.array(bits_, pa.binary())})

    rows = blocks.select("block", "payload").mapInArrow(send, "bucket long, block long, keys binary")
    return rows.groupBy("bucket").applyInArrow(answer, "block long, bucket long, kind int, answer binary")


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` stand in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def seem_shared(keys: np.ndarray, bits: int, buckets: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Which of a block's keys, one for each window, another block has or this block has more than once."""
    cut = keys >> U(64 - bits)
    sent, inverse, counts = np.unique(cut, return_inverse=True, return_counts=True)
    flags = counts > 1
    for (bucket, a, b), (got, blob) in zip(runs(bucket_of(sent, bits, buckets)), sorted(answers), strict=True):
        if bucket != got:
            raise RuntimeError(f"the answer for bucket {bucket} is missing")
        flags[a:b] |= np.unpackbits(np.frombuffer(zstandard.decompress(blob), "u1"), count=b - a).astype(bool)
    return flags[inverse]


def with_answers(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block id, Block, {kind: [(bucket, answer)]}) -> RecordBatch or None`` for each block with all answers to it."""

    def run(key, left: pa.Table, right: pa.Table):
        out = []
        by_kind: dict[int, list] = {}
        for bucket, kind, blob in zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), right["answer"].to_pylist()):
            by_kind.setdefault(kind, []).append((bucket, blob))
        for payload in left["payload"]:
            got = fn(key[0].as_py(), Block(payload.as_py()), by_kind)
            if got is not None:
                out.append(got)
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    empty = to_arrow_schema(kind).empty_table()
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
