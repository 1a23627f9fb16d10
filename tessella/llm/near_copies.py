"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, every such pair found, each verified exactly.

Words are those of ``simhash``. Texts with equal sets are one node. Shingles are put in one order for all texts, those that are common in a
sample of texts (which grows with the corpus) last, the others by their hashes, so a passage that many texts share seldom brings them together. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each
(n: the size of the set), so each node goes into a bucket for each of these: no pair is missed, whatever the sample holds. Sizes that allow the similarity lie in the same
band of sizes or in neighbouring ones. A bucket's nodes are first compared with a few leads of their band and of the band below; what
that links is one component. Then the pairs of a bucket that lie in different components are compared, those within its largest component
excepted, so a large group of near copies makes a few pairs for each member. In large buckets only pairs whose sketches (512 bits of a set) allow the similarity are made:
the join still looks at two such nodes, but makes no row of them. A candidate pair is then judged by its sizes, sketches and leading shingles, which bound what
the whole sets can share; only what they leave is verified on the whole sets.

Only the shingles are made in Python, a text at a time. Buckets, leads, candidate pairs and verification are DataFrame operations that combine before they shuffle and
spill when they must; no bucket is gathered in one task. Whole sets are made for nodes of a likely pair only: a bit table of fixed size tells
which rows can be theirs.

Defined cases: null texts, empty texts and texts of white space alone are one node; fewer than five words make one shingle; very long texts have large sets and are
compared whole; repeated rows are one node; an empty table gives an empty table; other columns, whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep_rows, text_hash, written
from .components import components

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many is counted for the order; a shingle that ``COMMON`` of these have is common; the longest list of such shingles that is collected,
#: and the size of the byte table that it becomes.
SAMPLE = 4
COMMON = 2
MOST_COMMON = 400_000
RANKS = 1 << 22
#: Longs of a set's sketch, and from how many nodes on a bucket's pairs are held against it before they are made.
SKETCH = 8
CROWD = 32
#: Bits of the table that tells rows of candidates.
TABLE_BITS = 1 << 22
#: Texts in one piece of what Python returns.
ROWS = 500


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hashes of the shingles, distinct and ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:max(1, len(words) - width + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[min(width, len(words)) - 1:].tolist())], U))


def leading(s: np.ndarray, ranks: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first n - ceil(t n) + 1 of a set in the order of all texts: by rank, then by hash. ``ranks``: a table by the hashes' low bits."""
    if not len(s):
        return s
    n = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    return s[np.argsort(ranks[s & U(len(ranks) - 1)], kind="stable")[:n]]


def sketch(s: np.ndarray) -> np.ndarray:
    """Of each of 64 * ``SKETCH`` parts of the hashes whether an odd number is in the set. Each shingle that only one of two sets has changes one bit,
    so two sets differ in at least as many shingles as their sketches differ in bits."""
    odd = np.bincount((s >> U(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _node(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), 1)], U).view(np.int64)[0])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _ranks(rows: DataFrame, width: int) -> np.ndarray:
    """A byte for each value of a hash's low bits: 0, or the higher the more texts of a sample have such a shingle. Shingles that share an entry share a rank, which does no harm."""

    def run(batches):
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py(), width) for t in batch.column(0)] or [np.zeros(0, U)]).view(np.int64))], ["s"])

    some = rows.where(F.pmod(F.col("h"), F.lit(SAMPLE)) == 0).select("t").distinct().mapInArrow(run, "s long")
    top = some.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    out = np.zeros(RANKS, "u1")
    at = top.column(0).to_numpy().view(U) & U(RANKS - 1)
    np.maximum.at(out, at, np.minimum(255, 8 * np.log2(top.column(1).to_numpy().astype(float))).astype("u1"))
    return out


def _pieces(batches):
    """Batches of ``ROWS`` rows at most."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _keyed(rows: DataFrame, ranks: np.ndarray, similarity: float, width: int) -> DataFrame:
    """(id, h, node, n, keys, bits)."""

    def run(batches):
        for batch in _pieces(batches):
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            first = [leading(s, ranks, similarity).view(np.int64) for s in sets]
            bits = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["id", "h", "node", "n", "keys", "bits"])

    return rows.mapInArrow(run, "id long, h long, node long, n long, keys array<long>, bits array<long>")


def _buckets(each: DataFrame, similarity: float) -> DataFrame:
    """(node, key, n, few, most, before, band): nodes whose key another node has too, each once; few: whether the key will do for the smaller of two sets; most: what the
    node shares with any other at most."""
    # A little wider than 1 / similarity, so that rounding never parts two sizes by more than one band.
    band = F.floor(F.log(F.col("n")) / (-math.log(similarity) * (1 + 1e-6))).cast("int")
    # Of two similar sets the smaller one shares at least 2 t / (1 + t) of its shingles, so for it an even shorter start of the order will do.
    few = F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9) + 1
    keyed = each.select("node", "n", F.posexplode("keys").alias("at", "key")).select("node", "n", "key", "at", (F.col("at") < few).alias("few"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("few").alias("use")).where("lo <> hi").select("key", "use")
    found = written(keyed.join(shared, "key").distinct(), "shared")
    # A set shares no more with any other than its leading shingles that another has, and all that aren't leading ones.
    # With before, the leading ones that another has and that come before the key, this bounds what a pair shares on either side of it.
    one = Window.partitionBy("node")
    most = F.count("*").over(one) + F.ceil(similarity * F.col("n") - 1e-9) - 1
    numbered = found.select("*", most.alias("most"), (F.row_number().over(one.orderBy("at")) - 1).alias("before"))
    return numbered.where("use").drop("use", "at").withColumn("band", band)


def _fits(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


def _leads(buckets: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with the leads of its band and of the band below. Leads are the smallest node and the two of which
    others have most of the leading shingles: a text that the others were made from is nearer to each of them than they are to one another. Which
    these are depends little on the bucket, so a node of a large group has few."""
    odd = (F.col("n") - F.col("most")) / F.col("n")
    orders = [F.struct("n", "node"), F.struct(odd.alias("o"), "n", "node"), F.struct(odd.alias("o"), F.xxhash64("node").alias("n"), "node")]
    lead = buckets.groupBy("key", "band").agg(F.array_distinct(F.array(*[F.min(o)["node"] for o in orders])).alias("leads"))
    both = lead.unionByName(lead.withColumn("band", F.col("band") + 1))
    return _ordered(buckets.join(both, ["key", "band"]).select(F.col("node").alias("p"), F.explode("leads").alias("q")).where("p <> q"))


def _across(rooted: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of buckets (key, node, n, few, band, root), the pairs of different roots whose sizes, and in large buckets sketches, allow the similarity, where the key will do for the smaller one."""
    counted = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"), F.sum("c").alias("nodes"))
    mixed = counted.where("roots > 1").select("key", F.col("top.root").alias("top"), "nodes")
    members = rooted.join(mixed, "key")
    bits = heads.select("node", "bits")
    members = members.where(F.col("nodes") >= CROWD).join(bits, "node").unionByName(members.where(F.col("nodes") < CROWD).withColumn("bits", F.lit(None).cast("array<long>"))).drop("nodes")
    probes = members.where(F.col("root") != F.col("top")).select("key", F.col("node").alias("p"), F.col("n").alias("m"), F.col("few").alias("pf"), F.col("most").alias("pm"), F.col("before").alias("pb"), F.col("root").alias("r"), F.col("bits").alias("pbits"), "band")
    # A probe looks in its own band and those beside it. Of two nodes that are both outside the largest component, the larger one asks.
    larger = F.struct("m", "p") > F.struct("n", "node")
    enough = _enough(F.least("pb", "before") + F.least(F.col("pm") - F.col("pb"), F.col("most") - F.col("before")), F.col("n") + F.col("m"), similarity)
    right = (F.col("r") != F.col("root")) & enough & _fits(F.col("n"), F.col("m"), similarity) & F.when(larger, F.col("few")).otherwise(F.col("pf")) & ((F.col("root") == F.col("top")) | (F.col("p") > F.col("node")))
    right = right & F.coalesce(_alike(F.col("pbits"), F.col("bits"), F.col("n") + F.col("m"), similarity), F.lit(True))
    probes = probes.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    found = probes.join(members, ["key", "band"]).where(right)
    return _ordered(found.select("p", F.col("node").alias("q")))


def _enough(shared: Column, both: Column, similarity: float) -> Column:
    """Whether two sets of ``both`` shingles in sum can have the similarity if they share at most ``shared``."""
    return shared >= similarity / (1 + similarity) * both - 1e-6


def _alike(x: Column, y: Column, both: Column, similarity: float) -> Column:
    """Whether two sets of ``both`` shingles in sum can have the similarity, by their sketches."""
    apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SKETCH)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return _enough((both - apart) / 2, both, similarity)


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, s array<long>) of all nodes of ``wanted(h)``, and perhaps of some others."""
    bit = F.pmod(F.col("h"), F.lit(TABLE_BITS))
    words = wanted.groupBy(F.floor(bit / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("v")).collect()
    table = np.zeros(TABLE_BITS // 64, U)
    table[[r["w"] for r in words]] = np.array([r["v"] for r in words], np.int64).view(U)

    def run(batches):
        for batch in _pieces(batches):
            at = np.mod(batch.column(0).to_numpy(), TABLE_BITS)
            mine = batch.filter(pa.array((table[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)))
            sets = [shingles(t.as_py(), width) for t in mine.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    return rows.select("h", "t").mapInArrow(run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))


def _likely(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes, sketches and leading shingles allow the similarity. What two sets share is among the leading ones of both, or comes after
    those of the one whose leading ones end first; so it is at most the leading ones shared and the longer rest."""
    left, right = (heads.select(F.col("node").alias(c), *[F.col(x).alias(x + c) for x in ("n", "most", "keys", "bits")]) for c in ("a", "b"))
    size, rest = F.col("na") + F.col("nb"), F.greatest(F.col("na") - F.size("keysa"), F.col("nb") - F.size("keysb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(_fits(F.col("na"), F.col("nb"), similarity) & _enough(F.least("mosta", "mostb"), size, similarity) & _alike(F.col("bitsa"), F.col("bitsb"), size, similarity))
    return both.where(_enough(F.size(F.array_intersect("keysa", "keysb")) + rest, size, similarity)).select("a", "b")


def _verified(likely: DataFrame, each: DataFrame, rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) that have the similarity, by their whole sets, which are made for the nodes of these pairs only."""
    likely = written(likely, "likely")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text stands for each node.
    wanted = each.select("node", "h").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")).select("h")
    sets = _sets(rows, wanted, width)
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(s)) for c, s in (("a", "sa"), ("b", "sb")))
    both = F.size(F.array_intersect("sa", "sb"))
    links = likely.join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")
    out = written(links, "links")
    discard(likely)
    return out


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h long: the text's xxhash64, node long, root long): rows of one root are linked over pairs of at least ``similarity``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), _text(text_col).cast("binary").alias("t"))
    each = written(_keyed(rows, _ranks(rows, width), similarity, width), "shingles")
    buckets = written(_buckets(each, similarity), "buckets")
    heads = written(each.select("node", "n", "keys", "bits").join(buckets.select("node", "most").distinct(), "node").dropDuplicates(["node"]), "heads")
    first = _verified(_likely(_leads(buckets), heads, similarity), each, rows, similarity, width)
    rooted = buckets.join(components(first), F.col("node") == F.col("a"), "left").select("key", "node", "n", "few", "most", "before", "band", F.coalesce("b", "node").alias("root"))
    rooted = written(rooted, "rooted")
    discard(buckets)
    more = _verified(_likely(_across(rooted, heads, similarity), heads, similarity), each, rows, similarity, width)
    found = components(first.unionByName(more))
    for spent in (rooted, heads, first, more):
        discard(spent)
    return each.select("id", "h", "node").join(found, F.col("node") == F.col("a"), "left").select("id", "h", "node", F.coalesce("b", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id, null ids last (of rows with that id, the one of the smallest text hash; of
    rows repeated with both, one); all columns stay. ``groups`` (id, h: the text's xxhash64, root): groups of another operator; near copies and these
    are one group where they have a row in common."""
    found = near_copies(docs, similarity, width, id_col, text_col).select("id", "h", "root")
    if groups is not None:
        key = lambda c: F.xxhash64("id", "h").alias(c)
        other = groups.select(key("ok"), F.col("h").alias("oh"), F.col("root").alias("of")).distinct()
        both = written(found.distinct().join(other, (key("k") == F.col("ok")) & (F.col("h") == F.col("oh"))).select("id", "h", "root", "of"), "groups")
        # Within a group of the other kind, roots are linked with the smallest.
        pairs = both.select("of", "root").distinct()
        least = pairs.groupBy("of").agg(F.min("root").alias("b"), F.max("root").alias("top")).where("b <> top")
        links = components(pairs.join(least, "of").where("root <> b").select(F.col("root").alias("a"), "b"))
        found = both.join(links, F.col("root") == F.col("a"), "left").select("id", "h", F.coalesce("b", "root").alias("root"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("r"))
    return keep_rows(docs, written(best.select("r.id", "r.h"), "kept"), id_col, text_col)
