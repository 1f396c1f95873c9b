"""One document of each group of near copies: 5-word shingle sets whose Jaccard similarity is at least 0.8.

*Candidates.*  Sets' SimHash fingerprints are joined by the trie of ``simhash`` within its
budget of bits, which no similarity of 0.8 is sure to keep; so an exact prefix filter
proposes the rest: in any one order of all shingles, two sets of
similarity 0.8 share one of the first n - ceil(0.8 n) + 1 of each.  Shingles that occur
twice in a sample come last, so passages that many documents share bring few together;
the sample decides that order only, never which pairs are found.  Sizes and places
bound the overlap that a pair can still have.

*Rounds.*  Groups of up to ``SMALL`` sets under one shingle propose all their pairs; larger
ones first the pairs with the few of them whose hashes are least, so that one group of copies
proposes the same pairs under each of its shingles, and later only pairs that aren't connected yet, so
a large group of near copies doesn't cost its square; of those, pairs whose sets' parities
differ in too many bits to be similar are left out, which is exact.  Groups of over ``CHUNK`` sets aren't
met by one task: they pick those few by partial aggregation, and later lie in chunks, of
which two meet in a task.  Proposed pairs, which grow faster than the input where texts share
passages, first meet the sets' parities, about a fortieth of the sets, and those too far apart are left out, which is
exact; the sets of the others, nearly all of them similar, are compared.  Links become stars in ``simhash.components``.

Shingles and whole sets are known by 64-bit hashes.  Words are cut and lower-cased as
in ``simhash``; a text of fewer than five words is one shingle, texts without a word
(null, empty, white space) are copies of each other.  Repeated rows and rows with null
keys are copies like any others; an empty table gives no rows; other columns are kept,
whatever their names (but ``_s_...``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_shuffles, join_spread, join_with_hot, most_rows, portions, release, small_batches, staged, tidied, whole_groups
from ledgerloom.llm.simhash import SEED, bits_over_half, components, near_links

SHINGLE = 5
#: Documents that the order of shingles is taken from, and shingles that it ranks.
SAMPLE, RANKED = 20_000, 1 << 18
#: Groups that propose all pairs at once, sets that larger ones propose pairs with, groups that one task meets, pairs made at once.
SMALL, HEADS, CHUNK, PORTION = 4, 3, 1024, 1 << 20
#: Least bits of a set's parities, a sound bound on how far two sets differ.
PARITY = 512
#: Bits of a Bloom filter (4 MB whatever the input) by which sets that no pair needs are left out early.
MARK = 25


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Different hashes of a text's shingles, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one: rare ones first, then common ones by rank."""
    n = len(hashes)
    if not n:
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    order = np.where(common[at] == hashes, rank[at] + 1, 0) if len(common) else np.zeros(n, np.int64)
    return hashes[np.argsort(order, kind="stable")][: n - (4 * n + 4) // 5 + 1]


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def _can(na, ia, nb, ib):
    """Whether two sets of these sizes can be similar that share a shingle at these places and none before."""
    return 9 * np.minimum(na - ia, nb - ib) >= 4 * (na + nb)


def _edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``PARITY`` bits (doubled until there are as many as hashes) whether an odd number of hashes falls on it; two sets differ in as many elements at least as their parities do."""
    bits = max(PARITY, 1 << max(len(hashes) - 1, 0).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(odd: bytes, size: int = PARITY // 8) -> np.ndarray:
    """Parities as they are with fewer bits (``size`` bytes)."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint64).reshape(-1, size // 8), axis=0)


def can_be_similar(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """Whether the parities of two sets leave it open that they are similar; similar ones differ in a ninth of their sizes at most."""
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return 9 * min(size_a, size_b) >= 4 * (size_a + size_b) and 9 * apart <= size_a + size_b


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, at & 0xFFFFFFFF


def propose(batches):
    """Rows (large, a, b, c): pairs a, b of sets under one shingle, or the rows of large groups as they are."""
    schema = pa.schema([("large", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
    for keys, ids, at in whole_groups(batches, 3):
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids, at = keys[first], ids[first], at[first]
        size, place = _unpack(at)
        edges = _edges(keys)
        many = np.diff(edges)
        left, right = [edges[:-1][many == 2]], [edges[:-1][many == 2] + 1]
        large = np.repeat(many > SMALL, many)
        for k in np.flatnonzero(many > 2).tolist():
            lo, m = int(edges[k]), int(many[k])
            if m <= SMALL:
                x, y = np.triu_indices(m, 1)
            else:
                x, y = np.repeat(np.arange(HEADS), m), np.tile(np.arange(m), HEADS)
            left.append(lo + x)
            right.append(lo + y)
        x, y = np.concatenate(left), np.concatenate(right)
        can = _can(size[x], place[x], size[y], place[y]) & (x != y)
        a, b = ids[x[can]], ids[y[can]]
        for flag, cols in ((False, (a, b, np.zeros(len(a), np.int64))), (True, (keys[large], ids[large], at[large]))):
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), flag)), *map(pa.array, cols)], schema=schema)


def propose_rest(batches):
    """Pairs a, b that aren't connected; rows are shingle, pair of chunks, whether a row is of its second chunk, set, size and place, component, parities."""
    for shingle, low, high, second, ids, at, roots, odd in whole_groups(batches, 8, keys=3):
        size, place = _unpack(at)
        odd = np.frombuffer(b"".join(odd.tolist()), np.uint64).reshape(-1, PARITY // 64)
        change = (shingle[1:] != shingle[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(ids)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if (roots[lo:hi] == roots[lo]).all():
                continue
            other = np.flatnonzero(second[lo:hi]) + lo
            mine = np.flatnonzero(~second[lo:hi]) + lo if len(other) else np.arange(lo, hi)
            other = other if len(other) else mine
            step = max(1, PORTION // len(other))
            for k in range(0, len(mine), step):
                x, y = mine[k : k + step, None], other[None, :]
                x, y = np.nonzero(_can(size[x], place[x], size[y], place[y]) & (roots[x] != roots[y]))
                x, y = mine[x + k], other[y]
                # similar sets differ in a ninth of their sizes at most
                apart = sum((np.bitwise_count(odd[x, j] ^ odd[y, j]).astype(np.int64) for j in range(odd.shape[1])), np.zeros(len(x), np.int64))
                near = 9 * apart <= size[x] + size[y]
                x, y = x[near], y[near]
                if len(x):
                    a, b = ids[x], ids[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def heads(large: DataFrame) -> DataFrame:
    """``shingle``, ``head``: some sets of each group, by hashes of their ids."""
    picked = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(HEADS)]
    return large.groupBy("shingle").agg(F.array(*picked).alias("h")).select("shingle", F.explode(F.array_distinct("h")).alias("head"))


def common_shingles(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur twice in a sample, sorted, and their rank from rare to common; only the order of shingles hangs on them."""
    every = max(1, texts.count() // sample)

    def run(batches):
        for batch in batches:
            for part in portions(batch, 0):
                sets = [shingles(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("_s_key", "_s_text"), F.lit(every)) == 0).select("_s_text").mapInArrow(tidied(run), "h long")
    got = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(h)
    h, n = h[by], n[by]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h, rank


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``; staged) of set ids that sizes and parities (``id``, ``size``, ``odd`` of ``rows``) leave open, each once."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sketches = staged(rows.select("id", "size", "odd").join(needed, "id", "left_semi").dropDuplicates(["id"]), "parities")

    def compare(batches):
        for batch in batches:
            a, b, *rest = batch.columns
            yes = pa.array([can_be_similar(*x) for x in zip(*(c.to_pylist() for c in rest))], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(yes), b.filter(yes)], names=["a", "b"])

    one, other = (sketches.select(F.col("id").alias(c), F.col("odd").alias(f"odd_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    both = join_spread(pairs, one, "a", "b").join(other, "b").select("a", "b", "odd_a", "odd_b", "size_a", "size_b")
    out = staged(both.mapInArrow(tidied(compare), "a long, b long"), "possible")
    release(sketches)
    free_shuffles(pairs.sparkSession)
    return out


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``; staged) of set ids whose sets are similar; ``rows`` has the sets' sizes and parities."""
    pairs = possible(pairs, rows)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    mark = F.col("id").bitwiseAND(F.lit((1 << MARK) - 1))
    words = needed.groupBy(F.shiftright(mark, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((id & {(1 << MARK) - 1}) % 64 AS INT))")).alias("bits")).toArrow()  # at most 2 ** (MARK - 6) rows
    asked = np.zeros(1 << MARK - 6, np.int64)
    asked[words.column("w").to_numpy()] = words.column("bits").to_numpy()

    def run(batches):
        for batch in batches:
            for part in portions(batch, 0):
                out = {}
                for t in part.column(0).to_pylist():
                    s = shingles(t)
                    k = set_id(s)
                    m = k & ((1 << MARK) - 1)
                    if int(asked[m >> 6]) >> (m & 63) & 1:
                        out[k] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["id", "s"])

    found = texts.select("_s_text").mapInArrow(tidied(run), "id long, s binary").join(needed, "id", "left_semi").dropDuplicates(["id"])
    sets = staged(found, "sets")
    free_shuffles(pairs.sparkSession)

    def compare(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            yes = pa.array([similar(p.as_py(), q.as_py()) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(yes), b.filter(yes)], names=["a", "b"])

    both = join_spread(pairs, sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a", "b").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    out = staged(both.select("a", "b", "x", "y").mapInArrow(tidied(compare), "a long, b long"), "similar")
    release(sets)
    free_shuffles(pairs.sparkSession)
    return out


def keep_one(df: DataFrame, text_column: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group that similar pairs connect, with the columns of ``df``: the one with the least key (nulls last), then text hash, then row hash."""
    key_, names = F.col(f"`{key}`"), [F.col(f"`{c}`") for c in df.columns]
    marked = small_batches(df).withColumns({"_s_null": key_.isNull(), "_s_key": F.coalesce(key_, F.lit(0)).cast("long"), "_s_hash": F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))})
    texts = marked.select("_s_key", F.col(f"`{text_column}`").alias("_s_text"))
    common, rank = common_shingles(texts)

    def read(batches):
        for batch in batches:
            for part in portions(batch, 3):
                sets = [shingles(t) for t in part.column(3).to_pylist()]
                first = [prefix(s, common, rank).view(np.int64) for s in sets]
                odd = [parities(s) for s in sets]
                prints = np.array([bits_over_half(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(prints), pa.array(odd, pa.binary()), pa.array([folded(x).tobytes() for x in odd], pa.binary())],
                    names=["_s_null", "_s_key", "_s_hash", "id", "size", "first", "fp", "odd", "brief"],
                )

    rows = marked.select("_s_null", "_s_key", "_s_hash", F.col(f"`{text_column}`").alias("_s_text"))
    rows = staged(rows.mapInArrow(tidied(read), "_s_null boolean, _s_key long, _s_hash long, id long, size long, first array<long>, fp long, odd binary, brief binary"), "prefixes")
    dealt = rows.select("id", "size", F.posexplode("first").alias("place", "shingle")).select("shingle", "id", F.shiftleft("size", 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    large, small, chunks = _by_size(dealt)
    proposed = staged(small.repartition("shingle").sortWithinPartitions("shingle", "id").mapInArrow(tidied(propose), "large boolean, a long, b long, c long"), "proposed")
    free_shuffles(df.sparkSession)
    met = join_with_hot(large, heads(large), ["shingle"], most_rows(chunks, ["shingle"], "m"))
    pairs = [proposed.where("NOT large").select("a", "b"), _alike(rows), met.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    pairs = staged(out.distinct(), "pairs")
    links = verified(pairs, texts, rows)
    roots = components(links)
    left = proposed.where("large").select(F.col("a").alias("shingle"), F.col("b").alias("id"), F.col("c").alias("at")).unionByName(large.select("shingle", "id", "at"))
    left = left.join(roots, left["id"] == roots["node"], "left").select("shingle", "id", "at", F.coalesce("root", "id").alias("root"))
    left = staged(left.distinct(), "large-groups")
    # a group whose sets are all connected has nothing left to propose
    open_ = staged(left.groupBy("shingle").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("m")).where("r1 <> r2").select("shingle", "chunks", "m"), "open-groups")
    if not open_.isEmpty():
        met = join_with_hot(left, open_.select("shingle", "chunks"), ["shingle"], most_rows(open_, ["shingle"], "m"))
        odd = rows.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("brief").alias("odd"))
        met = met.join(odd, "id")
        met = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        # a chunk meets itself and each other chunk once
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = met.select("shingle", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).alias("second"), "id", "at", "root", "odd")
        rest = staged(met.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high").mapInArrow(tidied(propose_rest), "a long, b long").distinct(), "pairs")
        rest = staged(rest.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            roots = components(links.unionByName(verified(rest, texts, rows)))
    free_shuffles(df.sparkSession)
    least = rows.groupBy("id").agg(F.min(F.struct("_s_null", "_s_key", "_s_hash")).alias("least"))
    kept = least.join(roots, least["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("k")).select("k.*")
    stay = marked.join(kept, ["_s_null", "_s_key", "_s_hash"], "left_semi")
    # equal keys and texts: one row of them
    order = Window.partitionBy("_s_null", "_s_key", "_s_hash").orderBy(F.xxhash64(*names))
    return stay.withColumn("_s_n", F.row_number().over(order)).where("_s_n = 1").select(*names)


def _alike(rows: DataFrame) -> DataFrame:
    """Pairs of sets whose fingerprints are equal or that the trie join links."""
    prints = staged(rows.select("fp", "id").distinct(), "set-fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    same = prints.join(least, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    links = near_links(least.select("fp"))
    x, y = least.select(F.col("fp").alias("a"), F.col("first").alias("x")), least.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    linked = links.join(x, "a").join(y, "b").where("x <> y")
    return same.unionByName(linked.select(F.col("y").alias("a"), F.col("x").alias("b")))


def _by_size(dealt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of groups of over ``CHUNK`` sets, the other rows, and those groups with their sizes."""
    counts = staged(dealt.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK), "large-shingles")
    free_shuffles(dealt.sparkSession)
    marked = dealt.join(counts, "shingle", "left")
    return staged(marked.where("m IS NOT NULL").drop("m").distinct(), "large-shingle-rows"), marked.where("m IS NULL").drop("m"), counts
