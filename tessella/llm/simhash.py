"""SimHash near-dedup with pivot distance tables.

A fingerprint is 64 bits, one set where over half of the hashes of the text's 3-word shingles have it set. Documents with equal fingerprints are
one node; only distinct fingerprints are compared. Two fingerprints that differ in at most 3 bits agree on at least 2 of 5 bit
groups, so each goes into ten buckets, one for each pair of groups (26 bits that must be equal): no link is missed. Within
a bucket, a table of Hamming distances to reference fingerprints (pivots) is computed once; by the triangle inequality a pair whose
distances to any pivot differ by more than 3 is no link, so pairs are discarded pivot by pivot, by the largest coordinate
difference, and what survives all pivots is verified bit by bit. A bucket of more than ``DIRECT`` fingerprints is split again
by the bits that the bucket leaves free (of four groups one must be equal), so no bucket is compared pair by pair as a whole; one of more than ``BUCKET``, which
is counted first, is split so before it is shuffled.

Each bucket emits the star of each of its components, not its pairs; ``components`` joins the stars.

Defined cases: null and empty texts, and texts of white space alone, have fingerprint zero and are linked like any other; fewer than
three words make one shingle; rows with equal ids are separate documents of one component id; a null id is never the
smallest of its component unless all ids in it are null (then null); very long texts are hashed whole, some shingles at a time; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, table, text_hash, written
from .components import components, stars

U = np.uint64
SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Bits of the five groups.
GROUPS = (13, 13, 13, 13, 12)
PIVOTS = 32
DIRECT = 2048
#: Fingerprints of the largest bucket that goes to a task as it is.
BUCKET = 1 << 16


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 7) for k in range(n)], U)


def fingerprint(text: bytes, shingle: int = SHINGLE, step: int = 1 << 15) -> int:
    """Of UTF-8 bytes. Whole texts; ``step`` only bounds the memory of one pass."""
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + step], ends[k:k + step])], U)
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h long: the text's xxhash64, fp long)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(2)], U)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "h", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), text.cast("binary").alias("t"))
    return each.mapInArrow(run, "id long, h long, fp long")


def links_among(x: np.ndarray, free: int, distance: int = DISTANCE, refs: np.ndarray | None = None, direct: int = DIRECT):
    """(i, j) of all pairs within ``distance``, some perhaps more than once. ``free``: the bits in which they can differ."""
    refs = pivots() if refs is None else refs
    n = len(x)
    bits = [b for b in range(64) if free >> b & 1]
    if n > direct and len(bits) > 2 * (distance + 1):
        out_i, out_j = [], []
        for part in np.array_split(bits, distance + 1):
            mask = sum(1 << int(b) for b in part)
            value = x & U(mask)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for at in np.split(order, cuts):
                if len(at) > 1:
                    i, j = links_among(x[at], free & ~mask, distance, refs, direct)
                    out_i.append(at[i])
                    out_j.append(at[j])
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2
    far = np.bitwise_count(x[:, None] ^ refs[None, :]).astype(np.int8)  # the pivot table
    order = np.argsort(far[:, 0], kind="stable")
    far, y = far[order], x[order]
    found_i, found_j = [], []
    reach = np.searchsorted(far[:, 0], far[:, 0] + distance, "right")  # the first pivot bounds each one's partners
    step = max(1, (1 << 20) // max(1, n))
    for a in range(0, n, step):
        b = min(n, a + step)
        width = reach[a:b] - np.arange(a, b) - 1
        i = np.repeat(np.arange(a, b), width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + i + 1
        for k in range(1, len(refs)):
            if not len(i):
                break
            near = np.abs(far[i, k] - far[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(y[i] ^ y[j]) <= distance
        found_i.append(order[i[near]])
        found_j.append(order[j[near]])
    return np.concatenate(found_i), np.concatenate(found_j)


def _tables():
    """(shared bits, free bits) of each pair of groups."""
    at, masks = 0, []
    for size in GROUPS:
        masks.append(((1 << size) - 1) << at)
        at += size
    every = (1 << 64) - 1
    return [(a | b, every & ~(a | b)) for a, b in combinations(masks, 2)]


def _finer(tables, parts: int):
    """Each table with its free bits in ``parts`` groups, one of which must be equal too: (table, shared bits, free bits)."""
    out = []
    for k, (shared, free) in enumerate(tables):
        bits = [b for b in range(64) if free >> b & 1]
        for some in np.array_split(bits, parts):
            mask = sum(1 << int(b) for b in some)
            out.append((k, shared | mask, free & ~mask))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(masks: list[int]):
    return F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key")


def near_links(distinct: DataFrame, distance: int = DISTANCE, most: int = BUCKET) -> DataFrame:
    """``distinct(fp)`` to (a, b): a star of links for each component of each bucket. A bucket of more than ``most`` fingerprints is dealt out again by
    more bits before anything is sent to a task, so no task holds more than the fingerprints that agree in some 36 bits."""
    if distance > len(GROUPS) - 2:
        raise ValueError(f"with {len(GROUPS)} groups in pairs, at most {len(GROUPS) - 2} bits can differ")
    tables = _tables()
    finer = _finer(tables, distance + 1)
    # Buckets of either kind by one number: the tables, then the finer ones.
    kinds = [*tables, *[(m, f) for _, m, f in finer]]

    def run(batches):
        refs, held = pivots(), [(np.zeros(0, np.int8), np.zeros(0, U))]
        masks = np.array([m for m, _ in kinds], U)

        def linked(t, x):
            """Rows of whole buckets, in order."""
            key = x & masks[t]
            cut = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1])) + 1
            at = np.concatenate([[0], cut, [len(x)]])
            a_out, b_out = [], []
            for k in np.flatnonzero(np.diff(at) > 1):
                y = np.sort(x[at[k]:at[k + 1]])
                root = stars(len(y), *links_among(y, kinds[t[at[k]]][1], distance, refs))
                tied = root != np.arange(len(y))
                a_out.append(y[tied])
                b_out.append(y[root[tied]])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def flush():
            t, x = (np.concatenate(c) for c in zip(*held))
            return linked(t, x) if len(t) else ()

        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int8)
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            if not len(t):
                continue
            same = (t == t[-1]) & ((x & masks[t]) == (x[-1] & masks[t[-1]]))  # the last bucket may go on in the next batch
            first = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
            if first:
                held.append((t[:first], x[:first]))
                yield from flush()
                held = [(t[first:], x[first:])]
            elif len(held[-1][0]) and (held[-1][0][-1] != t[0] or (held[-1][1][-1] ^ x[0]) & masks[t[0]]):
                yield from flush()
                held = [(t, x)]
            else:
                held.append((t, x))
        yield from flush()

    keyed = distinct.select("fp", _keys([m for m, _ in tables]))
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("c")).where(F.col("c") > most).select(F.col("t").alias("lt"), F.col("key").alias("lk"))
    large = written(large, "large")
    if not large.isEmpty():
        again = distinct.select("fp", _keys([m for _, m, _ in finer]))
        # A finer bucket counts where its table's bucket is large.
        owner = F.array(*[F.lit(k) for k, _, _ in finer])[F.col("t")]
        mask = F.array(*[F.lit(_signed(tables[k][0])) for k, _, _ in finer])[F.col("t")]
        again = again.join(large, (owner == F.col("lt")) & (F.col("fp").bitwiseAND(mask) == F.col("lk")), "left_semi")
        keyed = keyed.join(large, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lk")), "left_anti")
        keyed = keyed.unionByName(again.withColumn("t", F.col("t") + len(tables)))
    return keyed.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h long: the text's xxhash64, fp long, root long: one fingerprint of the component, component): component is the smallest id reachable over links of at most ``distance`` bits."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, F.col("fp") == F.col("a"), "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(least, "root").select(F.col("fp").alias("node"), "root", "component")
    return each.join(of, F.col("fp") == F.col("node")).select("id", "h", "fp", "root", "component")


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of those with the smallest id the one of the smallest text hash (null ids come last; of rows repeated
    with both, one); all columns stay."""
    found = near_duplicates(docs, distance, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("r"))
    return keep_rows(docs, written(best.select("r.id", "r.h"), "kept"), id_col, text_col)


def op3_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
