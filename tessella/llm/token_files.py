"""Token ids in binary shards, packed by Re-Pair grammar compression.

Documents are encoded with a ``tokenizers`` file, each closed by an end id, and written in ascending id order: range partitioning
by id gives every task a run of ids, which it cuts into shards of at most ``SHARD_TOKENS``. Within a shard, frequent pairs of neighbouring
symbols are replaced by nonterminals in rounds, all pairs of at least ``MIN_COUNT`` occurrences at once, from the left
where they overlap in a run, until no pair is so frequent. No pair spans two documents, so that each document is a run of symbols of its own.

A shard file holds the rules, the expansion length of each, where each document's symbols and tokens begin, and the symbols; with
these (16 bits of each, and apart from them the bits above, as many as the rules need), one document, or a slice of it, is decoded without the rest (``Shard.document``). Files are written under a temporary
name and renamed, named by task and number, so that a task that runs again replaces its own.

Encoding looks words up in a dictionary that the tokenizers library fills: the byte-level pre-tokenizer never joins text across the front of a space that
precedes a non-space, nor a letter or digit with a following sign or line end, so a text is cut there and each distinct part is encoded by the library once. Texts with characters outside
``PLAIN``, runs of spaces or the text of a special token are encoded by the library as a whole.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with equal ids are ordered by a hash of the text, then by text, so that
one id may span tasks; a text longer than a shard is a shard of its own; other columns are ignored; an empty table writes no shards.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, table, written
from .words import Remembered, by_parts, in_batches

MAGIC = b"TESSRP01"
END_ID = 2
SHARD_TOKENS = 2 << 20
PARTITION_BYTES = 24 << 20
MIN_COUNT = 8
#: Characters over which every reading of the pre-tokenizer's classes agrees: ASCII, and Latin letters and signs.
PLAIN = r"\t\n\r\x20-\x7e¡-¬®-ɏ"


class Encoder:
    """Text to little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Texts with other characters, with white space or the end after a space, or with a special token's text aren't cut into words.
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = f"[^{PLAIN}]| [ \\t\\n\\r]| $" + (f"|{special}" if special else "")
        self.known = Remembered(self._words, longest=16)
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.spaced = np.array([w.startswith("\u0120") for w, _ in names])  # the byte-level name of a space

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Those that begin with a space and hold no other are encoded in long texts, and told apart by the ids that begin with a space."""
        spaced = [w for w in words if w[:1] == " "]
        others = [w for w in words if w and w[0] != " "]
        out: dict[str, bytes] = dict(zip(others, self._library(others)))
        for a in range(0, len(spaced), 1000):
            some = spaced[a:a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            flat = ids.tobytes()
            out.update(zip(some, (flat[x:y] for x, y in zip(at[:-1], at[1:]))))
        return [out.get(w, b"") for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, self.whole)
        out = dict(zip(np.flatnonzero(whole).tolist(), self._library(column.filter(whole).to_pylist())))
        plain = pc.invert(whole)
        out.update(zip(np.flatnonzero(plain).tolist(), by_parts(cut(column.filter(plain)), self.known)))
        return [out[k] for k in range(len(texts))]


def cut(texts: pa.LargeStringArray) -> pa.ListArray:
    """Texts of ``PLAIN`` characters cut before their spaces, and between a letter or digit and what follows it that is neither: no token spans these."""
    marked = pc.replace_substring_regex(texts, r"([\pL\pN])([^\s\pL\pN]|[\t\n\r])", "\\1\x00\\2")
    return pc.split_pattern(pc.replace_substring(marked, " ", "\x00 "), "\x00")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that its dictionary lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of ascending places, every other one of each run of neighbours, from the left."""
    k = np.arange(len(at))
    lead = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, k, 0))
    return (k - lead) % 2 == 0


def _numbers(code: np.ndarray, slot: np.ndarray, pair: np.ndarray, pair_slot: np.ndarray, slots: int) -> np.ndarray:
    """The number of each code among the ascending ``pair``, from 1; 0: none. A table of slots tells most; pairs that share a slot are searched for."""
    table = np.zeros(slots, np.uint32)
    table[pair_slot] = np.arange(1, len(pair) + 1, dtype=np.uint32)
    held = table[pair_slot] == np.arange(1, len(pair) + 1)
    number = table[slot]
    number[np.append(pair[:1], pair)[number] != code] = 0
    rest = pair[~held]
    if len(rest):
        shared = np.zeros(slots, bool)
        shared[pair_slot[~held]] = True
        open_ = np.flatnonzero(shared[slot] & (number == 0))
        near = np.minimum(np.searchsorted(rest, code[open_]), len(rest) - 1)
        same = rest[near] == code[open_]
        number[open_[same]] = (np.flatnonzero(~held)[near[same]] + 1).astype(np.uint32)
    return number


def repair(symbols: np.ndarray, end: int, min_count: int = MIN_COUNT):
    """(symbols, rules, first rule of each round and one more). ``end`` closes a document and is in no pair; nonterminals count from end + 1. All occurrences of a
    frequent pair are replaced, or overlap one that is; so after the first round only pairs with a symbol of the round before can be frequent."""
    seq, rules, starts, slots = symbols.astype(np.uint32), np.zeros((0, 2), np.uint32), [0], 1 << 20
    while len(seq) > 1:
        # A pair as one number: of 32 bits while symbols have 16.
        kind, half, odd = (np.uint32, 16, 0x9E3779B1) if end + len(rules) < 0xFFFF else (np.uint64, 32, 0x9E3779B97F4A7C15)
        if len(starts) == 1:
            closing = seq == end
            at = np.flatnonzero(~(closing[:-1] | closing[1:]))
        else:
            new = seq > end + starts[-2]
            at = np.flatnonzero(new[:-1] | new[1:])
            at = at[(seq[at] != end) & (seq[at + 1] != end)]
        code = (seq[at].astype(kind) << kind(half)) | seq[at + 1]
        slot = ((code * kind(odd)) >> kind(2 * half - 20)).astype(np.int32)
        # A pair is at most as frequent as its slot of the hash, so only pairs of frequent slots are counted.
        often = (np.bincount(slot, minlength=slots) >= min_count)[slot]
        at, code, slot = at[often], code[often], slot[often]
        pair, count = np.unique(code, return_counts=True)
        pair = pair[count >= min_count]
        if not len(pair):
            break
        number = _numbers(code, slot, pair, ((pair * kind(odd)) >> kind(2 * half - 20)).astype(np.int32), slots)
        hit = np.flatnonzero(number)
        hit = hit[_alternate(at[hit])]
        seq[at[hit]] = number[hit] + np.uint32(end + len(rules))
        keep = np.ones(len(seq), bool)
        keep[at[hit] + 1] = False
        seq = seq[keep]
        rules = np.concatenate([rules, np.stack([pair >> kind(half), pair & kind((1 << half) - 1)], 1).astype(np.uint32)])
        starts.append(len(rules))
    return seq, rules, starts


def expansion_lengths(rules: np.ndarray, starts: list[int], end: int) -> np.ndarray:
    size = np.ones(end + 1 + len(rules), np.int64)
    for a, b in zip(starts[:-1], starts[1:]):
        size[end + 1 + a:end + 1 + b] = size[rules[a:b, 0]] + size[rules[a:b, 1]]
    return size[end + 1:]


def _split(symbols: np.ndarray, high: int) -> bytes:
    """16 bits of each, then the ``high`` bits above."""
    above = (symbols[:, None] >> np.arange(16, 16 + high, dtype=np.uint32)[None, :]).astype("u1") & 1
    return symbols.astype("<u2").tobytes() + np.packbits(above).tobytes()


def pack_shard(ids: list, documents: list[bytes], vocabulary: int, end_id: int = END_ID) -> bytes:
    """A shard file's bytes. ``documents``: each one's ids as little-endian 32-bit integers, without the end id."""
    end = vocabulary
    counts = np.array([len(d) // 4 + 1 for d in documents], np.int64)
    tokens = np.frombuffer(struct.pack("<I", end).join([*documents, b""]), "<u4")
    seq, rules, starts = repair(tokens, end)
    sizes = expansion_lengths(rules, starts, end)
    closing = np.flatnonzero(seq == end)
    high = max(0, int(end + len(rules)).bit_length() - 16)
    wide = next(w for w in (1, 2, 4) if not len(sizes) or sizes.max() < 1 << 8 * w)
    head = struct.pack("<8sIIIIIIQQQ", MAGIC, 2, end_id, end, len(starts) - 1, len(rules), high, wide, len(documents), len(seq))
    return b"".join([
        head, np.array(starts, "<u4").tobytes(), _split(rules.reshape(-1), high), sizes.astype(f"<u{wide}").tobytes(),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(),
        np.concatenate([[0], closing + 1]).astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes(), _split(seq, high)])


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Shard:
    """A shard file, read: ids, nulls, token_starts, and documents on demand."""

    def __init__(self, data: bytes):
        magic, version, self.end_id, self.end, rounds, n_rules, high, wide, n_docs, n_symbols = struct.unpack_from("<8sIIIIIIQQQ", data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a shard of this format")
        at = struct.calcsize("<8sIIIIIIQQQ")

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        def joined(n):
            out = take("<u2", n).astype(np.uint32)
            if high:
                bits = np.unpackbits(take("u1", -(-n * high // 8)), count=n * high).reshape(-1, high)
                for k in range(high):
                    out |= bits[:, k].astype(np.uint32) << np.uint32(16 + k)
            return out

        self.starts = take("<u4", rounds + 1).tolist()
        self.rules = joined(2 * n_rules).reshape(-1, 2)
        self.sizes = take(f"<u{wide}", n_rules)
        self.ids, self.nulls = take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.symbol_starts, self.token_starts = take("<u8", n_docs + 1).astype(np.int64), take("<u8", n_docs + 1).astype(np.int64)
        self.symbols = joined(n_symbols)

    def __len__(self) -> int:
        return len(self.ids)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Symbols to ids, the end of a document as the end id. Rounds are undone from the last."""
        seq = seq.astype(np.uint32)
        for a in reversed(self.starts[:-1]):
            low = np.uint32(self.end + 1 + a)
            made = seq >= low
            if made.any():
                out = np.repeat(seq, 1 + made)
                at = np.flatnonzero(made)
                at = at + np.arange(len(at))
                pair = self.rules[seq[made] - np.uint32(self.end + 1)]
                out[at] = pair[:, 0]
                out[at + 1] = pair[:, 1]
                seq = out
        return np.where(seq == self.end, np.uint32(self.end_id), seq).astype("<u4")

    def all(self) -> np.ndarray:
        """All ids, by a table of every rule's expansion. A round's rules stand for at most an eighth of the shard together, so the table is small."""
        first, size, flat = np.zeros(self.end + 1 + len(self.rules), np.int64), np.ones(self.end + 1 + len(self.rules), np.int64), [np.arange(self.end + 1, dtype="<u4")]
        first[:self.end + 1] = np.arange(self.end + 1)
        flat[0][self.end] = self.end_id
        size[self.end + 1:] = self.sizes
        table = flat[0]
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            both = self.rules[a:b].reshape(-1)
            made = size[self.end + 1 + a:self.end + 1 + b]
            first[self.end + 1 + a:self.end + 1 + b] = len(table) + np.cumsum(made) - made
            table = np.concatenate([table, table[_spread(first[both], size[both])]])
        return table[_spread(first[self.symbols], size[self.symbols])]

    def document(self, k: int, begin: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of document k, or some of them: only the symbols that hold those are expanded."""
        seq = self.symbols[self.symbol_starts[k]:self.symbol_starts[k + 1]].astype(np.int64)
        sizes = np.where(seq > self.end, self.sizes[np.maximum(seq - self.end - 1, 0)] if len(self.sizes) else 1, 1).astype(np.int64)
        ends = np.cumsum(sizes)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if begin >= stop:
            return np.zeros(0, "<u4")
        a, b = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        offset = int(ends[a] - sizes[a])
        return self.expand(seq[a:b])[begin - offset:stop - offset]


def _put(path: str, data: bytes) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:  # of an earlier try of this task
        fs.delete_file(at)
    fs.move(part, at)


def _get(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards below ``folder`` (a URI that driver and executors share) and returns the manifest (part, shard, path, n_docs, n_tokens, n_bytes, base):
    base is the number of ids in all shards before."""

    def run(batches):
        part, encode = TaskContext.get().partitionId(), _encoder(tokenizer)
        ids, texts, n, k = [], [], 0, 0

        def row():
            data = pack_shard(ids, texts, encode.size, end_id)
            path = f"{folder}/part-{part:08d}-{k:06d}.ids"
            _put(path, data)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [k], "path": [path], "n_docs": [len(ids)], "n_tokens": [n], "n_bytes": [len(data)]})

        for batch in batches:
            for i, got in zip(batch.column(0).to_pylist(), in_batches(batch.column(1), encode)):
                if ids and n + len(got) // 4 + 1 > shard_tokens:
                    yield row()
                    k, ids, texts, n = k + 1, [], [], 0
                ids.append(i)
                texts.append(got)
                n += len(got) // 4 + 1
        if ids:
            yield row()

    each = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = each.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("raw"), F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).first()
    # By id; where ids repeat or are missing, by the text's hash too, so that rows of one id are dealt out. The order of all rows is the same either way.
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    by = order[:1] if found["ids"] >= 0.9 * found["n"] else order
    dealt = each.withColumn("h", F.xxhash64("t")).repartitionByRange(max(1, -(-found["raw"] // partition_bytes)), *by).sortWithinPartitions(*order, "t").drop("h")
    manifest = written(dealt.mapInArrow(run, "part long, shard long, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    # One row for each shard file: the only thing that is ordered in one task.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids binary: little-endian 32-bit) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(_get(path))
                flat, cuts = shard.all().tobytes(), shard.token_starts
                for a in range(0, len(shard), 2000):
                    b = min(len(shard), a + 2000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.ids[a:b], pa.int64(), mask=shard.nulls[a:b]), pa.array(base + cuts[a:b]), pa.array(np.diff(cuts[a:b + 1])),
                        pa.array([flat[4 * x:4 * y] for x, y in zip(cuts[a:b].tolist(), cuts[a + 1:b + 1].tolist())], pa.binary())], ["id", "start", "n_tokens", "ids"])

    files = manifest.select("path", "base")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens"))
    return read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
