"""Toxicity by compression distance: a zstandard dictionary of toxic text and one of ordinary text, compared window by window.

The ordinary dictionary is trained on windows of ordinary texts. The toxic one is trained on toxic texts too, but on those passages only that
ordinary texts lack: runs of ``GRAM``-byte strings whose share of the toxic texts (near copies counted once) is ``SURPLUS`` times their share of the ordinary ones, and
improbable if label and string were independent. A toxic text is mostly ordinary text, so a dictionary of all its windows holds what both
kinds share. A window is compressed behind the ordinary dictionary, and behind the toxic one followed by the same ordinary
one, so that what both kinds share cancels out; the difference of the two lengths tells how much of the window only toxic text explains.

Calibration is by inner folds: each labelled text is measured with dictionaries that were trained on the other folds. The histograms of these
differences, of toxic and of ordinary texts, give each length difference its log-likelihood ratio; a text's is the sum over its windows, and
a two-weight logistic fit to the out-of-fold sums (with the number of windows beside) turns it into a probability. The threshold of 0.5 is thus
one on summed length differences.

Fitting uses a bounded sample of labelled rows that aren't held out: ``max_rows`` of each label, those with the lowest hashes, and of each text at
most ``max_chars`` characters, in pieces spread evenly over the whole of it; the fit weighs labels by how many there are. Scoring covers every window of every whole
text. The model is some 40 KB and goes to the executors with the function.

Defined cases: null texts count as empty, an empty text is one empty window; without both kinds of labels every score is the
share of toxic labels (0 without labels); repeated rows score alike; a null id is held out and never learned from; very long texts are scored
window by window in one pass; an empty table gives an empty table; other columns pass through, but one that has the name of the score gives way to it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, spread_text, table

WINDOW = 64
#: Windows overlap, so that a short word at the edge of one stands whole in the next.
STEP = 48
STRATEGY = zstandard.STRATEGY_LAZY2
SEARCH = 5
#: The shortest match that a compressor takes: shorter ones stand everywhere.
MATCH = 6
ORDINARY_BYTES = 32768
#: The toxic dictionary has an eighth of its samples' bytes, within these bounds.
TOXIC_BYTES = (512, 4096)
#: The trainer's pieces, of the ordinary and of the toxic dictionary.
SEGMENTS = (200, 64)
GRAM = 8
SURPLUS = 8
LEAST_TEXTS = 4
#: Natural logarithm of the probability bound below which a surplus counts.
SIGNIFICANCE = -10.0
MAX_ROWS = 3000
MAX_CHARS = 8000
FOLDS = 4
#: Texts added to each length difference's count.
PRIOR = 0.1
#: Length differences beyond these count as these.
LOWEST, HIGHEST = -8, 12
#: Rows of one piece of what scoring returns.
ROWS = 1000


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    ratio: np.ndarray  # log-likelihood ratio of each length difference
    weight: np.ndarray  # of one, the summed ratio, and the logarithm of the number of windows
    base: float

    def scorer(self):
        if not len(self.weight):
            return lambda text: self.base
        differ = _differ(self.ordinary, self.toxic)

        def score(text: bytes) -> float:
            d = differ(text)
            z = self.weight @ np.array([1.0, self.ratio[d - LOWEST].sum(), np.log(len(d))])
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, runs of ASCII white space as one space, one at either end."""
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(text: bytes) -> list[bytes]:
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Tables with room for every position: in smaller ones a longer dictionary would overwrite its own entries.
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=SEARCH, min_match=MATCH, target_length=32, strategy=STRATEGY, write_content_size=False, write_dict_id=False)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress


def _differ(ordinary: bytes, toxic: bytes):
    """Bytes (UTF-8) to the length difference of each window."""
    plain, both = _compressor(ordinary), _compressor(toxic + ordinary)
    return lambda text: np.clip([len(plain(w)) - len(both(w)) for w in windows(normal(text))], LOWEST, HIGHEST)


def dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary's bytes, taken from the samples in pieces of ``segment``; the samples' own where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def grams(text: bytes) -> np.ndarray:
    """A 32-bit hash of each string of ``GRAM`` bytes."""
    x = np.frombuffer(text, "u1").astype(np.uint32)
    n = max(0, len(x) - GRAM + 1)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + x[k:k + n]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)


def kind(text: bytes) -> bytes:
    """Near copies have the same four lowest hashes: they count as one text."""
    return np.unique(grams(text))[:4].tobytes()


def _places(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where those of ``values`` stand that the ascending ``among`` has."""
    at = np.minimum(np.searchsorted(among, values), max(0, len(among) - 1))
    return at[among[at] == values] if len(among) else at[:0]


class Counts:
    """The strings that ``LEAST_TEXTS`` kinds of toxic text have, and how many kinds of toxic and of ordinary text of each fold have each."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, folds: np.ndarray):
        # One text stands for each kind of a label.
        lead = {(kind(t), y): k for k, (t, y) in reversed(list(enumerate(zip(texts, labels.tolist()))))}
        self.lead = sorted(lead.values())
        every = np.sort(np.concatenate([np.zeros(0, np.uint32), *(np.unique(grams(texts[k])) for k in self.lead if labels[k])]))
        often = every[LEAST_TEXTS - 1:][every[LEAST_TEXTS - 1:] == every[:len(every) - LEAST_TEXTS + 1]] if len(every) >= LEAST_TEXTS else every[:0]
        self.strings = np.unique(often)
        self.seen = np.zeros((2, FOLDS, len(self.strings)), np.int64)
        self.texts = np.zeros((2, FOLDS), np.int64)
        for k in self.lead:
            self.seen[int(labels[k]), folds[k], _places(self.strings, np.unique(grams(texts[k])))] += 1
            self.texts[int(labels[k]), folds[k]] += 1

    def surplus(self, without: int | None) -> np.ndarray:
        """The strings with a significant surplus in toxic texts, ascending, of all folds but one."""
        use = [f for f in range(FOLDS) if f != without]
        g, c = self.seen[:, use].sum(1)
        n_good, n_bad = self.texts[:, use].sum(1)
        if not n_good or not n_bad:
            return self.strings[:0]
        total, share = np.maximum(c + g, 1), n_bad / (n_bad + n_good)
        q = c / total
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0.0)
            tail = np.where(q > share, -total * (q * np.log(q / share) + rest), 0.0)  # Chernoff's bound of the binomial tail
        return self.strings[(c >= LEAST_TEXTS) & (c / n_bad >= SURPLUS * (g + 1) / (n_good + 1)) & (tail <= SIGNIFICANCE)]


def passages(text: bytes, marked: np.ndarray) -> list[bytes]:
    """The maximal runs of bytes that marked strings cover."""
    h = grams(text)
    if not len(h) or not len(marked):
        return []
    at = np.flatnonzero(marked[np.minimum(np.searchsorted(marked, h), len(marked) - 1)] == h)
    edge = np.zeros(len(text) + 1, np.int32)
    edge[at] += 1
    edge[at + GRAM] -= 1
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))
    return [text[a:b] for a, b in turn.reshape(-1, 2).tolist()]


def _pair(bad: list[bytes], good: list[bytes], marked: np.ndarray) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    # The trainer reads the samples stretch by stretch: in the order of their texts' hashes, no stretch belongs to one language or source.
    samples = [p for t in sorted(bad, key=zlib.crc32) for p in passages(t, marked)]
    n = sum(-(-len(t) // WINDOW) for t in good)
    every = [w for k, w in enumerate(t[i:i + WINDOW] for t in good for i in range(0, len(t), WINDOW)) if k % max(1, n // 50_000) == 0]
    size = min(TOXIC_BYTES[1], max(TOXIC_BYTES[0], sum(map(len, samples)) // 8))
    return dictionary(ORDINARY_BYTES, every, SEGMENTS[0]), dictionary(size, samples, SEGMENTS[1]) if samples else b""


def fit(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> Model:
    """From (text, label) pairs, deterministic for their order; fold ``FOLDS`` is none, so the last dictionaries are trained on all. ``totals``: how many rows of each label there are, where ``rows`` is a sample."""
    base = float(np.mean([y for _, y in rows])) if rows else 0.0
    if totals:
        base = totals.get(1, 0) / max(1, sum(totals.values()))
    rows = list(dict.fromkeys((normal(t.encode()), y) for t, y in rows))
    texts, labels = [t for t, _ in rows], np.array([y for _, y in rows], float)
    if not 0 < labels.sum() < len(labels):
        return Model(b"", b"", np.zeros(0), np.zeros(0), base)
    fold = np.array([zlib.crc32(kind(t)) % FOLDS for t in texts])  # near copies stand in one fold
    counts = Counts(texts, labels, fold)
    lead = np.zeros(len(texts), bool)
    lead[counts.lead] = True
    pair = lambda f: _pair([texts[k] for k in np.flatnonzero(lead & (labels == 1) & (fold != f))], [texts[k] for k in np.flatnonzero((labels == 0) & (fold != f))], counts.surplus(f))
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for f in range(FOLDS):
        differ = _differ(*pair(f))
        for k in np.flatnonzero(fold == f):
            found[k] = differ(texts[k])
    kinds = HIGHEST - LOWEST + 1
    # Every text counts as one, however long: else one long text with a line that repeats would speak for its label.
    seen = [sum(np.bincount(d - LOWEST, minlength=kinds) / len(d) for d, y in zip(found, labels) if y == z) + PRIOR for z in (0, 1)]
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    x = np.array([[1.0, ratio[d - LOWEST].sum(), np.log(len(d))] for d in found])
    each = {z: (totals or {}).get(z, 0) / (labels == z).sum() for z in (0, 1)}
    weigh = np.where(labels == 1, each[1], each[0]) if totals else np.ones(len(labels))
    weigh = weigh * len(labels) / weigh.sum()
    w = np.zeros(3)
    for _ in range(60):  # Newton's method, on weights held towards 0 a little
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (weigh * (p - labels)) + w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Model(*pair(FOLDS), ratio, w, base)


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """A model from labelled rows that aren't held out. ``labels``: (doc_id, toxic)."""
    ours = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    totals = {int(r["__toxic"]): r["n"] for r in ours.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label in (0, 1):
        some = ours.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
        found = docs.join(F.broadcast(some), F.col(id_col).cast("long") == F.col("__id")).select("__id", spread_text(F.col(text_col), max_chars).alias("t")).distinct()
        # Rows may repeat an id: the bound holds for rows too.
        rows += [(r["__id"], r["t"], label) for r in found.orderBy(F.xxhash64("__id", "t"), "__id", "t").limit(max_rows).collect()]
    return fit([(t, y) for _, t, y in sorted(rows)], totals)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` (but one called ``name``) and the score."""

    kept = [f for f in docs.schema.fields if f.name != name]
    own = [f.name for f in kept].index(text_col) if text_col != name and docs.schema[text_col].dataType == StringType() else len(kept)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                scores = pa.array([score(t.as_py() or b"") for t in some.column(own).cast(pa.binary())], pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns[:len(kept)], scores], [*some.schema.names[:len(kept)], name])

    each = docs.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text_col}`").cast("string").alias(fresh(docs, "__text"))] if own == len(kept) else []))
    return each.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    name = fresh(docs, "__toxicity")
    return with_score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
