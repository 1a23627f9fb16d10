"""Personal data: patterns, and spans that a character-level bidirectional LSTM with a CRF adds to them.

The patterns (e-mail and IP addresses, card and phone numbers) are found in every whole text, in time linear in its length. The model is trained
in numpy on labelled spans: windows of a bounded sample of texts, labelled by the patterns, and the same windows with generated items set in,
among them forms that the patterns don't know (phone numbers without a plus sign, cards of 13 to 15 digits). It reads
windows of ``WINDOW`` characters that overlap by half. Windows that overlap are reconciled before decoding: each character's emissions are those of the window in
which it stands most centrally, and one Viterbi search runs over all windows that hang together, so that no sequence of tags that the CRF bars can arise at a seam and no
item is cut at one. A long run of windows is decoded as a stream: tags are given out where all surviving paths agree. Spans of any of the four kinds hold a digit or an ``@``: windows without one are
not run. A span of the model is added if it can be of its kind (digits, checksum, parts) and touches no pattern's span.

Scale: no shuffle; the model (some 100 KB) goes with the function, the sample's bounds are ``max_texts``, ``max_chars`` of each and ``max_windows`` of these. Windows are run ``BATCH`` at a time.

Defined cases: null texts count as empty; an empty text has no spans; very long texts are found and decoded whole; repeated rows give equal rows; an empty table gives an empty table; a corpus without any sample text trains on
generated items alone; other columns pass through ``mask``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import spread_text, table
from .tagger import KINDS, TAGS, Tagger, codes

WINDOW = 64
BATCH = 256
MAX_TEXTS = 1500
MAX_CHARS = 20_000
MAX_WINDOWS = 40
#: Windows of the longest run that is decoded together with others.
LONG = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so it can only begin where one begins.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ip_ok(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdecimal() and p.isascii() and (len(p) < 4 or not p[:-3].strip("0")) and int(p[-3:]) <= 255 for p in parts)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                last = m.end()
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an ``@``: multiples of half a window."""
    half, seen = WINDOW // 2, {}
    for m in _HINT.finditer(text):
        k = m.start() // half
        seen[k] = seen[max(0, k - 1)] = True
    return [k * half for k in sorted(seen)]


def windows_of(text: str, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int64)
    for k, a in enumerate(starts):
        part = codes(text[a:a + WINDOW])
        out[k, :len(part)] = part
    return out


def runs_of(starts: list[int]) -> list[list[int]]:
    """Windows that overlap, together."""
    out: list[list[int]] = []
    for a in starts:
        if out and a - out[-1][-1] == WINDOW // 2:
            out[-1].append(a)
        else:
            out.append([a])
    return out


def joined(emissions: np.ndarray, at: int, windows: int) -> np.ndarray:
    """The emissions of a run, or of the part of it that begins with window ``at``: each character's are those of the window in which it stands most centrally."""
    quarter = WINDOW // 4
    return np.concatenate([e[quarter if at + k else 0:WINDOW if at + k == windows - 1 else WINDOW - quarter] for k, e in enumerate(emissions)])


def spans_of(tags: dict[int, int]) -> list[tuple[str, int, int]]:
    out: list[list] = []
    for at in sorted(tags):
        t = TAGS[tags[at]]
        if out and out[-1][2] == at and out[-1][0] == t[2:] and t[0] == "I":
            out[-1][2] = at + 1
        else:
            out.append([t[2:], at, at + 1])
    return [tuple(s) for s in out]


def can_be(kind: str, text: str) -> bool:
    d = _digits(text)
    if text != text.strip() or not d and kind != "email":
        return False
    if kind == "email":
        name, at, host = text.partition("@")
        return bool(name and at and host) and "@" not in host and "." in host.strip(".") and not re.search(r"\s", text)
    if kind == "ip":
        return _ip_ok(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9](?:[ -]?[0-9])+", text) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"\(?\+?[0-9](?:[ ().-]{0,2}[0-9])+", text) is not None and re.search(r"[ ().-]", text) is not None and not re.fullmatch(r"[0-9.]+", text)


def _generated(r: np.random.Generator) -> tuple[str, str]:
    """A kind ("" for what only looks like one) and an item of it."""
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    word = lambda n: "".join(chr(97 + int(c)) for c in r.integers(0, 26, n))
    kind = pick("email", "ip", "card", "phone", "phone", "")
    if kind == "email":
        return kind, f"{word(int(r.integers(2, 9)))}{pick('', '.', '_')}{word(3)}{pick('', num(2))}@{word(int(r.integers(3, 9)))}.{pick('com', 'org', 'example.net')}"
    if kind == "ip":
        return kind, ".".join(str(int(x)) for x in r.integers(0, 256, 4))
    if kind == "card":
        n = pick(13, 15, 16, 16, 16, 19)
        body = pick("3", "4", "5", "6") + num(n - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, body if r.random() < 0.5 else pick(" ", "-").join(body[i:i + 4] for i in range(0, n, 4))
    if kind == "phone":
        a, b, c = num(3), num(3), num(4)
        return kind, pick(f"+{pick('1', '44', '49', '33')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a} {b} {c}")
    return "", pick(num(int(r.integers(1, 8))), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"version {num(1)}.{num(1)}.{num(2)}", f"${num(3)}.{num(2)}", f"{num(3)},{num(3)}", f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(20))}"', f"@{word(6)}", f"{num(4)}/{num(4)}", f"#{num(5)}")


def _labelled(text: str, spans) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        if a < WINDOW and b > 0:
            a, b = max(a, 0), min(b, WINDOW)
            tags[a:b] = TAGS.index(f"I-{kind}")
            tags[a] = TAGS.index(f"B-{kind}")
    return tags


def fit(texts: list[str], seed: int = 3, made: int = 2500, steps: int = 300, max_windows: int = MAX_WINDOWS) -> Tagger:
    """From sample texts, at most ``max_windows`` windows of each, spread evenly over it; deterministic for their order."""
    r = np.random.default_rng(seed)
    rows, tags = [], []
    for text in texts:
        spans = pattern_spans(text)
        starts = window_starts(text)
        starts = starts[::max(1, -(-len(starts) // max_windows))]
        rows += list(windows_of(text, starts))
        # Cut spans keep their tags: a window begins with B there, as in a text that begins so.
        tags += [_labelled(text[a:a + WINDOW], [(k, x - a, y - a) for k, x, y in spans]) for a in starts]
    plain = [t for t in texts if t] or ["lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"]
    for _ in range(made):
        t = plain[int(r.integers(0, len(plain)))]
        at = int(r.integers(0, max(1, len(t) - WINDOW)))
        text, spans = t[at:at + int(r.integers(0, 30))], []
        while len(text) < WINDOW:
            kind, item = _generated(r)
            text += "" if not text or text[-1].isspace() else " "
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + (" ", ", ", ". ", "\n", "%%% ", "!! ")[int(r.integers(0, 6))]
            at = int(r.integers(0, max(1, len(t) - WINDOW)))
            text += t[at:at + int(r.integers(5, 40))]
        text = text[:WINDOW]
        row = codes(text)
        rows.append(row)
        tags.append(_labelled(text, spans))
    return Tagger().train(np.array(rows), np.array(tags), steps)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS) -> Tagger:
    """From at most ``max_texts`` texts with a digit or an ``@``, those whose ids hash lowest, and at most ``max_chars`` of each, in pieces spread over the whole of it."""
    ids = docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_texts)
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select("__id", spread_text(F.col(text_col), max_chars).alias("t")).distinct()
    # An id may have many texts: the bound holds for texts too.
    rows = rows.orderBy(F.xxhash64("__id", "t"), "__id", "t").limit(max_texts).collect()
    return fit([r["t"] for r in sorted(rows, key=lambda r: (r["__id"], r["t"]))])


def find_all(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """For each text: the patterns' spans, and those that the model adds."""
    base = [pattern_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    held: list[tuple[int, list[int]]] = []

    def take(k: int, start: int, tags: np.ndarray):
        text = texts[k]
        at = np.flatnonzero(tags)
        if not len(at):
            return
        taken = sorted((a, b) for _, a, b in base[k])
        lo = np.array([a for a, _ in taken], np.int64)
        hi = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else lo
        for kind, a, b in spans_of({start + int(i): int(tags[i]) for i in at if start + i < len(text)}):
            n = int(np.searchsorted(lo, b, "left"))  # pattern spans that begin before b
            if (n == 0 or hi[n - 1] <= a) and can_be(kind, text[a:b]):
                added[k].append((kind, a, b))

    def run():
        rows = np.concatenate([windows_of(texts[k], starts) for k, starts in held])
        every = np.concatenate([model.emissions(rows[a:a + BATCH]) for a in range(0, len(rows), BATCH)])
        ends = np.cumsum([len(starts) for _, starts in held]).tolist()
        parts = [joined(every[e - len(starts):e], 0, len(starts)) for e, (_, starts) in zip(ends, held)]
        for (k, starts), tags in zip(held, model.best(parts)):
            take(k, starts[0], tags)
        held.clear()

    waiting = 0
    for k, text in enumerate(texts):
        for starts in runs_of(window_starts(text)):
            if len(starts) > LONG:  # by itself, some windows at a time
                some = (joined(model.emissions(windows_of(text, starts[a:a + BATCH])), a, len(starts)) for a in range(0, len(starts), BATCH))
                take(k, starts[0], np.concatenate(list(model.stream(some))))
                continue
            held.append((k, starts))
            waiting += len(starts)
            if waiting >= 16 * BATCH:
                run()
                waiting = 0
    if held:
        run()
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(set(a), key=lambda s: (order[s[0]], s[1], s[2]))) for b, a in zip(base, added)]


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base and added: array<struct<kind,start,end>>), code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        for batch in batches:
            found = find_all([t.as_py() for t in batch.column(1)], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in found], kind), pa.array([as_rows(a) for _, a in found], kind)], ["id", "base", "added"])

    each = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    span = "array<struct<kind:string,start:long,end:long>>"
    return each.mapInArrow(run, f"id long, base {span}, added {span}")


def mask_text(text: str, spans) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the union, under the name of the first."""
    out, at, last = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if last is not None and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at, last = b, kind
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a text masked; null texts stay null."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_all([t or "" for t in texts], model)
            rewritten = [None if t is None else mask_text(t, b + a) for t, (b, a) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(rewritten, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    each = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return each.mapInArrow(run, StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields]))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = find(docs, learn(docs))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(both).alias("spans"), F.size("added").cast("long").alias("n_added"))
