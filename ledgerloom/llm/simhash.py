"""SimHash near-duplicates: a binary-trie self-join of fingerprints, and its components.

*Fingerprint.*  Words of the text (A-Z lower-cased, cut at ASCII white space) make
3-word shingles, each with its XXH64 (seed 42); a bit of the fingerprint is 1 if over
half of the hashes have it.  Fingerprints link at ``BUDGET`` or fewer differing bits.

*Join.*  Equal fingerprints are one first, with partial aggregation, so copies cost
nothing.  Two fingerprints within 3 bits agree on one of 4 blocks of 16 bits: each
fingerprint goes, with that block turned to the front, to the task of each of its
blocks.  A block that over ``LARGE`` fingerprints agree on is dealt out again, by the
same argument, by the four parts of their other 48 bits.  A task reads its fingerprints
sorted, which is a binary trie, one stretch of whole blocks at a time, and walks pairs of
trie nodes together from the block's node on, counting differing bits and leaving a
pair once they exceed the budget.  Node pairs wait on a stack in bounded portions,
deepest first, and pairs whose leaves are known to be connected are left too, so a
large group of near copies costs neither memory nor all its pairs.  A task passes on
one link a fingerprint, to its group's least: no more rows than it has read.

*Components.*  Links become stars by alternating large-star and small-star rounds,
each written to the shared folder; nothing is collected on the driver.  The most
frequent keys (a fingerprint of a third of all texts, the least of a large
component) meet their rows by a bounded broadcast, see ``common.join_by_key``.

Defined results: a null or empty text, or one of white space only, has fingerprint
0, which links like any other; a text of one or two words is one shingle; repeated
rows share a component; a row with a null key gets its component's least key that is
not null, or null; an empty table gives no rows; other columns, whatever their names
(but ``_s_...``, which is this module's), aren't read, or are kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.llm.common import join_by_key, release, small_batches, staged, tidied, whole_groups

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Fingerprints that agree on a block from which on the block is dealt out again.
LARGE = 1 << 15
#: Node pairs in a portion, and shingles hashed at once.
PORTION, CHUNK = 1 << 17, 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return bits_over_half(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def bits_over_half(hashes: np.ndarray) -> int:
    """The number whose bits over half of the hashes have."""
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        set_ += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes())


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([f - (1 << 64) if f >> 63 else f for f in map(fingerprint, texts)], dtype="int64")


def with_fingerprint(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` and ``_s_fp``, the fingerprint as a signed long."""
    return small_batches(df).withColumn("_s_fp", _fingerprints(F.col(f"`{text_column}`")))


# -- the trie self-join --------------------------------------------------------


class _Forest:
    """Which leaves of a sorted array are known to be connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        if not len(pairs):
            return
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        touched = np.unique(pairs)
        new = np.arange(len(self.label))
        new[touched] = [self.find(x) for x in touched.tolist()]
        self.label = new[self.label]

    def open_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """The node pairs that are not within one component already."""
        change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        a0, a1, b0, b1 = pairs[:, 0], pairs[:, 1] - 1, pairs[:, 2], pairs[:, 3] - 1
        known = (change[a0] == change[a1]) & (change[b0] == change[b1]) & (self.label[a0] == self.label[b0])
        return pairs[~known]


def trie_join(values: np.ndarray, depth: int = 0, budget: int = BUDGET) -> np.ndarray:
    """Component labels (a place in ``values``) of sorted, different fingerprints that agree above ``depth`` where they link.

    Node pairs are rows (low, high, low, high, differing bits); a node is the
    stretch of the sorted array below it, a node paired with itself has equal
    stretches.
    """
    n, forest = len(values), _Forest(len(values))
    if n < 2:
        return forest.label
    top = values >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    edges = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [n]])
    roots = np.stack([edges[:-1], edges[1:], edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int64)], axis=1)
    stack, zeros = [(depth, roots[roots[:, 1] - roots[:, 0] > 1])], {}
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > PORTION:
            stack.append((level, pairs[PORTION:]))
            pairs = pairs[:PORTION]
        pairs = forest.open_pairs(pairs)
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        leaves = pairs[single]
        if len(leaves):  # one fingerprint on either side: all bits that remain at once
            near = np.bitwise_count(values[leaves[:, 0]] ^ values[leaves[:, 2]]) <= budget
            forest.link(leaves[near, 0], leaves[near, 2])
        pairs = pairs[~single]
        if not len(pairs):
            continue
        if level not in zeros:
            zeros[level] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - level) & np.uint64(1)) == 0)])
        z = zeros[level]
        a0, a2, b0, b2, bits = pairs.T
        a1, b1 = a0 + z[a2] - z[a0], b0 + z[b2] - z[b0]
        same = a0 == b0
        cross, equal = np.stack([a0, a1, b1, b2, bits + 1], axis=1), [np.stack([a0, a1, b0, b1, bits], axis=1), np.stack([a1, a2, b1, b2, bits], axis=1)]
        back = np.stack([a1, a2, b0, b1, bits + 1], axis=1)[~same]
        below = np.concatenate([cross, back, *equal])
        below = below[(below[:, 4] <= budget) & (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2])]
        below = below[(below[:, 0] != below[:, 2]) | (below[:, 1] - below[:, 0] > 1)]
        if len(below):
            stack.append((level + 1, below))
    return forest.label


def _turn(x, by: int, bits: int):
    """The lowest ``bits`` of ``x`` turned left by ``by``; the bits above stay.  For columns and for unsigned arrays."""
    if not by:
        return x
    low = (1 << bits) - 1
    if isinstance(x, np.ndarray):
        part = x & np.uint64(low)
        return (x & np.uint64(low ^ (1 << BITS) - 1)) | ((part << np.uint64(by)) & np.uint64(low)) | (part >> np.uint64(bits - by))
    signed = lambda v: F.lit(v - (1 << BITS) if v >> BITS - 1 else v)
    part = x.bitwiseAND(signed(low))
    kept = x.bitwiseAND(signed(low ^ (1 << BITS) - 1))
    return kept.bitwiseOR(F.shiftleft(part, by).bitwiseAND(signed(low))).bitwiseOR(F.shiftrightunsigned(part, bits - by))


def near_links(fingerprints: DataFrame, budget: int = BUDGET, large: int = LARGE) -> DataFrame:
    """``a``, ``b``: links that connect all of the column ``fp``, different values, that are within the budget."""
    import pyarrow as pa

    blocks = budget + 1
    wide = BITS // blocks  # bits of a block,
    narrow = (BITS - wide) // blocks  # and of a part of the other bits
    turned = fingerprints.select(F.posexplode(F.array(*(_turn(F.col("fp"), k * wide, BITS) for k in range(blocks)))).alias("k", "turned"))
    turned = turned.withColumn("head", F.shiftrightunsigned("turned", BITS - wide))
    often = turned.groupBy("k", "head").agg(F.count("*").alias("n")).where(F.col("n") > large).drop("n")
    dealt = turned
    if often.count():
        often = staged(often, "large-blocks")
        parts = F.posexplode(F.array(*(_turn(F.col("turned"), j * narrow, BITS - wide) for j in range(blocks)))).alias("j", "turned")
        again = turned.join(often, ["k", "head"]).select("k", parts)
        again = again.select((blocks + F.col("k") * blocks + F.col("j")).alias("k"), "turned", F.shiftrightunsigned("turned", BITS - wide - narrow).alias("head"))
        dealt = turned.join(often, ["k", "head"], "left_anti").select("k", "turned", "head").unionByName(again)

    def run(batches):
        for ks, heads, values in whole_groups(batches, 3, keys=2):
            for code in np.unique(ks).tolist():
                k, j = (code, 0) if code < blocks else divmod(code - blocks, blocks)
                v = np.sort(values[ks == code].view(np.uint64))
                label = trie_join(v, wide if code < blocks else wide + narrow, budget)
                linked = np.flatnonzero(label != np.arange(len(v)))
                back = []
                for x in (v[linked], v[label[linked]]):
                    x = _turn(x, (BITS - wide - j * narrow) % (BITS - wide), BITS - wide)
                    back.append(pa.array(_turn(x, (BITS - k * wide) % BITS, BITS).view(np.int64)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays(back, names=["a", "b"])

    return dealt.select("k", "head", "turned").repartition("k", "head").sortWithinPartitions("k", "head").mapInArrow(tidied(run), "a long, b long")


# -- components ----------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node that each node of ``links`` (``a``, ``b``) can reach, for all but the roots.

    Hubs are met by a partial minimum and a bounded broadcast, never by collecting
    neighbours; a round's tables are deleted after the next round.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = staged(ordered(links), "links")
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_by_key(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # large-star
        large = staged(ordered(large), "links")
        release(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = join_by_key(large, least, ["a"])
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))  # small-star
        edges = staged(ordered(small), "links")
        release(large)
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint_roots(rows: DataFrame) -> DataFrame:
    """``fp``, ``root`` of every different ``_s_fp`` in ``rows``: the least fingerprint reachable."""
    different = rows.select(F.col("_s_fp").alias("fp")).distinct()
    linked = components(near_links(different))
    return different.join(linked, different["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, text_column: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``_s_fp``, ``component_id`` of every row."""
    rows = staged(with_fingerprint(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_column}`").alias("_s_text")), "_s_text").drop("_s_text"), "fingerprints")
    least = rows.groupBy("_s_fp").agg(F.min("doc_id").alias("least")).join(fingerprint_roots(rows), F.col("_s_fp") == F.col("fp")).select("_s_fp", "root", "least")
    least = staged(least, "fingerprint-roots")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_by_key(least, ids, ["root"]).select("_s_fp", "component_id")
    return join_by_key(rows, named, ["_s_fp"]).select("doc_id", "_s_fp", "component_id")


def keep_one(df: DataFrame, text_column: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of ``df``: the one with the least key (nulls last), then text hash, then row hash."""
    from pyspark.sql import Window

    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    key_ = F.col(f"`{key}`")
    names = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumns({"_s_null": key_.isNull(), "_s_key": F.coalesce(key_, F.lit(0)).cast("long"), "_s_hash": F.xxhash64(text)})
    rows = staged(with_fingerprint(marked.select("_s_null", "_s_key", "_s_hash", F.col(f"`{text_column}`").alias("_s_text")), "_s_text").drop("_s_text"), "fingerprints")
    first = rows.groupBy("_s_fp").agg(F.min(F.struct("_s_null", "_s_key", "_s_hash")).alias("first"))
    kept = first.join(fingerprint_roots(rows), F.col("_s_fp") == F.col("fp")).groupBy("root").agg(F.min("first").alias("k")).select("k.*")
    stay = marked.join(kept, ["_s_null", "_s_key", "_s_hash"], "left_semi")
    # equal keys and texts: one row of them
    order = Window.partitionBy("_s_null", "_s_key", "_s_hash").orderBy(F.xxhash64(*names))
    return stay.withColumn("_s_n", F.row_number().over(order)).where("_s_n = 1").select(*names)
