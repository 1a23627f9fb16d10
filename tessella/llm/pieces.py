"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text's ids are those of the segmentation into vocabulary pieces with the highest sum of scores (exact integers or doubles; of equal sums, the
one whose last piece is longest). Spaces become U+2581, with one in front of the text, as the vocabulary's own rules say; a character without a piece of its own
goes to its UTF-8 bytes at the score of the lowest piece less ten. A U+2581 in the text itself goes to bytes too, so that decoding gives every text
back exactly.

The search runs once from left to right. For a boundary, only the scores of the last ``longest piece`` boundaries are kept; backpointers
are kept until all surviving paths (those of the boundaries a later piece can still start at) meet in one boundary, and ids up to there are committed. So
memory doesn't grow with the text. Since no piece has U+2581 after another character (checked on loading), all paths meet at the
front of every run of U+2581, and ids are committed there at once: text between two such boundaries has the same ids wherever it stands. ``encode``
therefore remembers the ids of such parts and searches those it hasn't seen; ``search`` over the whole text gives the same (held by a test).

Defined cases: null and empty texts have no ids; decoding no ids gives an empty text; repeated rows are encoded alike; clashing column names: the
columns made are ``n_ids`` and ``ids`` (encode) and ``decoded`` (decode), other columns pass through, ``keep`` chooses which.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import table
from .words import Remembered, by_parts, give_back, in_batches

SPACE = "▁"
#: Stands for a U+2581 of the text: a lone surrogate, which no text has.
LITERAL = "\udfff"
UNKNOWN_PENALTY = 10
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """pieces: text to (id, score); bytes_: the ids of the 256 byte pieces; spell: each id's bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], spell: list[bytes]):
        self.pieces, self.byte_ids, self.spell = pieces, byte_ids, spell
        self.longest = max(map(len, pieces))
        self.unknown = min(score for _, score in pieces.values()) - UNKNOWN_PENALTY
        self.tails = {p[k:] for p in pieces for k in range(len(p))}
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.known = Remembered(self._codes, limit=200_000)
        self.commits = 0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces, byte_ids, spell = {}, [0] * 256, []
        for i in range(sp.vocab_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                spell.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spell.append(b"")
            else:
                score = sp.get_score(i)
                pieces[name] = (i, int(score) if score == int(score) else score)
                spell.append(name.replace(SPACE, " ").encode())
        return cls(pieces, byte_ids, spell)

    def search(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of strings, committed as paths meet. Keeps a window of the text and of backpointers only."""
        pieces, tails, longest = self.pieces, self.tails, self.longest
        text, score, back = "", [0], [0]  # these begin at the last boundary committed

        def path(to: int) -> list[int]:
            out: list[int] = []
            while to:
                word = text[back[to]:to]
                known = pieces.get(word)
                out += [known[0]] if known else [self.byte_ids[b] for b in reversed((SPACE if word == LITERAL else word).encode())]
                to = back[to]
            return out[::-1]

        for some in chars:
            for c in some:
                if c == SPACE and self.apart and text and text[-1] != SPACE:
                    # No piece goes on over this boundary: every path stands on it.
                    yield from path(len(text))
                    text, score, back = "", [0], [0]
                    self.commits += 1
                text += c
                e = len(text)
                best, at = None, e - 1
                if c not in pieces:
                    best = score[e - 1] + self.unknown
                for k in range(1, min(longest, e) + 1):
                    word = text[e - k:]
                    if word not in tails:
                        break
                    known = pieces.get(word)
                    if known is not None:
                        s = score[e - k] + known[1]
                        if best is None or s >= best:
                            best, at = s, e - k
                score.append(best)
                back.append(at)
                if e >= 4 * longest and e % longest == 0:
                    live = set(range(e - longest + 1, e + 1))
                    while len(live) > 1:  # the last one steps back until all stand on one boundary
                        last = max(live)
                        live.remove(last)
                        live.add(back[last])
                    meet = live.pop()
                    if meet:
                        yield from path(meet)
                        text, low = text[meet:], score[meet]
                        score, back = [s - low for s in score[meet:]], [max(0, b - meet) for b in back[meet:]]
                        self.commits += 1
        yield from path(len(text))

    def _codes(self, words: list[str]) -> list[bytes]:
        return [array("I", self.search([SPACE + w])).tobytes() for w in words]

    def _each(self, words: list[str]) -> list[bytes]:
        once = list(dict.fromkeys(words))
        codes = dict(zip(once, self.known(once)))
        return [codes[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out = [b""] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if not t:
                continue
            if not self.apart or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                marked = SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)
                if self.apart:
                    out[k] = b"".join(self._each([run[1:] for run in CHUNK.findall(marked)]))
                else:
                    out[k] = self._codes([marked[1:]])[0]
            else:
                plain.append(k)
        if plain:
            for k, code in zip(plain, by_parts(pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " "), self.known)):
                out[k] = code
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.spell.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def _lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, after which its process gives freed memory back: it goes on to tasks of other stages."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(columns of ``keep``, all by default; n_ids long, ids binary: little-endian 32-bit)."""
    keep = docs.columns if keep is None else keep

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            codes = list(in_batches(batch.column(batch.num_columns - 1), v.encode))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary())], [*batch.schema.names[:-1], "n_ids", "ids"])

    each = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return each.mapInArrow(_lean(run), StructType([*each.schema.fields[:-1], StructField("n_ids", LongType()), StructField("ids", BinaryType())]))


def decode(coded: DataFrame, model: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """(columns of ``keep``, all by default; decoded string)."""
    keep = coded.columns if keep is None else keep

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            texts = [v.decode(memoryview(c.as_py() or b"").cast("I")) for c in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    each = coded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias("__ids"))
    return each.mapInArrow(run, StructType([*each.schema.fields[:-1], StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, same): every text encoded, and decoded from its ids again, in one worker."""

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            n, crc, sha, same = [], [], [], []
            for text, code in zip(batch.column(1), in_batches(batch.column(1), v.encode)):
                decoded = v.decode(memoryview(code).cast("I"))
                n.append(len(code) // 4)
                crc.append(zlib.crc32(code))
                sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"])

    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return each.mapInArrow(_lean(run), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")


def op10_pieces(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
