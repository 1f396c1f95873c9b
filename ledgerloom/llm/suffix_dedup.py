"""Exact removal of byte strings that occur twice, by a hash-compared suffix sort.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts anywhere
else in the corpus (same document included) goes; strings are judged on the input.

How it is spread over a cluster
1. *Texts.*  Equal texts are one class, known by 128 bits of their SHA-256; a task passes
   a class's items on once, however often the text comes.
2. *Anchors.*  Of the ``GRAM``-byte strings in a window of ``LENGTH`` bytes the one with
   the least hash (leftmost of equals) is the window's anchor.  It depends on the
   window's bytes alone, so equal windows have equal anchors at equal places, and each
   window belongs to one anchor.  Windows of one anchor make one item with one stretch
   of text, its context.  This pass reads each document where it lies and passes on
   about 1.7 rows per 100 bytes; items that repeat within a document are merged there,
   and their bytes compared.
3. *Counts.*  Anchors that occur once can't repeat and leave.  An anchor whose contexts
   are all equal has a single class of suffixes at each place; there is nothing to sort.
   Contexts are equal if 128 bits of their BLAKE2b digest are.
4. *Suffix sort.*  The rest, anchors with several different contexts, is sorted: one
   example of each context, suffixes by mergesort, compared by their common extension,
   which a binary search over prefix polynomial hashes finds in 8 steps.  Neighbours
   that have ``LENGTH`` bytes in common repeat; their bytes are compared afterwards, and
   a class of suffixes in which a hash lied is sorted again by its bytes.  An anchor's
   contexts are sorted in runs of about ``RUN``, as an external mergesort does, so no task
   meets all of a frequent anchor; runs are merged by their different suffixes only, one
   of each, which meet by their digest (again 128 bits of BLAKE2b) with partial counts.
5. *Removal.*  Stretches meet their class's rows, are united and cut out.

What a digest decides and no bytes are compared for: equality of texts, of contexts
that nothing else of their anchor differs from, and of suffixes of different runs.  All
are 128 bits of cryptographic hashes.

Skew: of the texts, anchors and contexts that over ``HOT_ROWS`` rows have, the ``SHARES``
most frequent are hot.  Their rows stay where they lie and meet a broadcast of that many
rows; only rows of other keys are shuffled by them.

Defined results: a null text is empty; a text under ``LENGTH`` bytes stays whole;
repeated rows are each other's repeats, whatever their keys; null keys are allowed;
an empty table gives no rows; other columns are carried, whatever their names (but
``_d_...``, which is this module's).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.llm.common import arrow_schema, hot_keys, join_with_hot, most_rows, portions, small_batches, squeezed, staged, text_ids, tidied

LENGTH, GRAM = 200, 64
#: Window starts handled at once; bytes of contexts sorted at once; occurrences of an anchor that share a run of the sort.
PART, PORTION, RUN = 1 << 18, 1 << 20, 4096
#: Texts that a task remembers; forgetting them costs equal rows, which are merged later.
REMEMBERED = 100_000

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and their inverses, modulo 2 ** 64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[size] = both[0], both[1]
    return _powers[size]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte times power, and the inverse powers that make a stretch's hash free of its place."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def stretch_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    return (sums[start + length] - sums[start]) * down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of a text: first and last window start, the anchor's place and its hash."""
    found, grams = [], LENGTH - GRAM + 1
    places = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - LENGTH + 1, PART):
        part = np.frombuffer(data, np.uint8)[at : at + PART + LENGTH - 1]
        sums, down = prefix_hashes(part)
        h = mixed(stretch_hash(sums, down, np.arange(len(part) - GRAM + 1), GRAM))
        key, span = (h & ~places) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * span <= grams:
            key, span = np.minimum(key[:-span], key[span:]), 2 * span
        if grams > span:
            key = np.minimum(key[: span - grams], key[grams - span :])
        place = (key & places).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        found.append((at + first, at + np.append(first[1:], len(place)) - 1, at + place[first], h[place[first]]))
    return tuple(map(np.concatenate, zip(*found)))


ITEMS = "t1 long, t2 long, a long, c1 long, c2 long, lo int, hi int, p int, n int"


def longs(digests: list[bytes]) -> np.ndarray:
    """Two signed longs for each digest of 16 bytes."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def text_id(data: bytes) -> bytes:
    """What tells texts apart: the first half of their SHA-256, as ``text_ids`` makes it in Spark."""
    return hashlib.sha256(data).digest()[:16]


def _text_items(data: bytes) -> list:
    """Columns ``a`` to ``n`` of one text: items (each context once), and stretches that repeat within the text (``a`` null)."""
    lo, hi, p, anchor = anchors(data)
    start, stop = lo.tolist(), (hi + LENGTH).tolist()
    index, first, again = {}, [], []
    for k, (x, y) in enumerate(zip(start, stop)):
        s = data[x:y]
        d = digest(s)
        while (j := index.setdefault(d, k)) != k and data[start[j] : stop[j]] != s:
            d = digest(d)  # a digest that lied
        if j == k:
            first.append(k)
        else:
            again += [j, k]
    n = np.ones(len(lo), np.int64)
    n[again] = 2
    begin, end = united(lo[again], hi[again] + LENGTH) if again else (np.zeros(0, np.int64),) * 2
    c, none = longs(list(index)), np.zeros(len(begin), np.int64)
    a = [*anchor[first].view(np.int64).tolist(), *[None] * len(begin)]
    return [a, *(np.concatenate(x) for x in ((c[:, 0], none), (c[:, 1], none), (lo[first], begin), (hi[first], end - LENGTH), (p[first], begin), (n[first], none)))]


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that overlap or touch made one; sorted."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def _first_sights(texts: list, seen: dict):
    """(text class, its bytes or None for a second sight) of the rows that a task has to pass on."""
    for text in texts:
        data = (text or "").encode()
        if len(data) >= LENGTH:
            t = text_id(data)
            if t not in seen:
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen[t] = False
                yield t, data, True
            elif not seen[t]:
                seen[t] = True
                yield t, data, False


def items(texts: DataFrame) -> DataFrame:
    """Items of all texts, a class of equal texts once a task, and a whole stretch for a class that comes again there."""
    schema = arrow_schema(ITEMS)

    def run(batches):
        seen: dict[bytes, bool] = {}
        for batch in batches:
            for part in portions(batch, 0, 64):
                rows = []
                for t, data, first in _first_sights(part.column(0).to_pylist(), seen):
                    made = _text_items(data) if first else [[None], *(np.array([x]) for x in (0, 0, 0, len(data) - LENGTH, 0, 0))]
                    rows.append([*(np.full(len(made[0]), x) for x in longs([t])[0]), *made])
                if rows:
                    columns = [np.concatenate(c) if f.name != "a" else [x for y in c for x in y] for f, c in zip(schema, zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, columns)], schema=schema)

    return texts.select("text").mapInArrow(tidied(run), ITEMS)


# -- the suffix sort -----------------------------------------------------------


class Suffixes:
    """Suffixes of a buffer, compared by their first ``LENGTH`` bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums, self.down = prefix_hashes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` have in common, ``LENGTH`` at most: a binary search over hashes."""
        low, step = np.zeros(len(a), np.int64), 1 << LENGTH.bit_length() - 1
        while step:
            try_ = np.minimum(low + step, LENGTH)
            same = stretch_hash(self.sums, self.down, a, try_) == stretch_hash(self.sums, self.down, b, try_)
            low = np.where(same, try_, low)
            step >>= 1
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before the one at ``b``."""
        n = self.common(a, b)
        full = n == LENGTH
        n = np.where(full, 0, n)
        return ~full & (self.data[a + n] < self.data[b + n])

    def sort(self, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """``starts`` sorted within each of the (contiguous) classes: a bottom-up mergesort of all classes at once."""
        n = len(starts)
        edges = np.concatenate([np.flatnonzero(np.diff(classes, prepend=-1)), [n]])
        sizes = np.diff(edges)
        begin = np.repeat(edges[:-1], sizes)
        size, place = np.repeat(sizes, sizes), np.arange(n) - begin
        width, most = 1, sizes.max(initial=1)
        while width < most:
            active = np.flatnonzero(size > width)
            at, first = place[active], begin[active]
            run = at // (2 * width) * (2 * width)
            left = at - run < width
            other_low = np.where(left, run + width, run)
            other_high = np.minimum(np.where(left, run + 2 * width, run + width), size[active])
            low, high = np.minimum(other_low, other_high), other_high.copy()
            base = low.copy()
            mine = starts[active]
            while (open_ := np.flatnonzero(low < high)).size:  # how many of the other run come first
                middle = (low[open_] + high[open_]) // 2
                other = starts[first[open_] + middle]
                x, from_left = mine[open_], left[open_]
                # of equals the left run's come first
                before = np.where(from_left, self.less(other, x), ~self.less(x, other))
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = first + run + (at - np.where(left, run, run + width)) + (low - base)
            merged = starts.copy()
            merged[target] = mine
            starts, width = merged, 2 * width
        return starts

    def repeated(self, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Starts whose ``LENGTH`` bytes another start of the same class has too; hashes are verified."""
        ordered = self.sort(starts, classes)
        pair = np.flatnonzero(classes[1:] == classes[:-1])
        a, b = ordered[pair], ordered[pair + 1]
        same = stretch_hash(self.sums, self.down, a, LENGTH) == stretch_hash(self.sums, self.down, b, LENGTH)
        a, b, pair = a[same], b[same], pair[same]
        lied = []
        for k in range(0, len(a), 1 << 14):
            steps = np.arange(LENGTH)
            equal = (self.data[a[k : k + (1 << 14), None] + steps] == self.data[b[k : k + (1 << 14), None] + steps]).all(axis=1)
            lied.append(pair[k : k + (1 << 14)][~equal])
        bad = np.unique(classes[np.concatenate(lied)]) if lied else []
        out = [np.concatenate([a, b])[~np.isin(np.concatenate([classes[pair]] * 2), bad)]]
        for c in bad:  # by bytes
            rows: dict[bytes, list[int]] = {}
            for s in starts[classes == c].tolist():
                rows.setdefault(self.data[s : s + LENGTH].tobytes(), []).append(s)
            out.append(np.array([s for r in rows.values() if len(r) > 1 for s in r], np.int64))
        return np.unique(np.concatenate(out))


def covered(groups: list, leads: list, counts: list, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, whether it repeats within its group) of all windows of contexts.

    ``leads``: bytes before the anchor; ``counts``: how often the context occurs.
    """
    sizes = np.array(list(map(len, contexts)))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    windows = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(contexts)), windows)
    local = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(sizes) - sizes)[row] + local
    # equal windows have equal anchors at equal places: those can only meet within a class
    group = np.unique(np.array(groups), return_inverse=True, axis=0)[1].reshape(-1)
    classes = group[row] * (2 * LENGTH) + np.array(leads)[row] - local + LENGTH
    order = np.argsort(classes, kind="stable")
    line = classes[order]
    alone = np.concatenate([[True], line[1:] != line[:-1]]) & np.concatenate([line[1:] != line[:-1], [True]])
    order = order[~alone]
    hit = np.zeros(len(data) + 1, bool)
    if len(order):
        hit[Suffixes(data).repeated(starts[order], classes[order])] = True
    return row, local, hit[starts] | (np.array(counts)[row] > 1)


def stretches(row: np.ndarray, local: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the stretches that flagged windows make."""
    at = np.flatnonzero(flag)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)])
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return row[first], local[first], local[last] + LENGTH


SORTED = "a long, c1 long, c2 long, begin int, end int, place int, w1 long, w2 long"


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """Sort each run of contexts (``a``, ``run``, ``runs``, ``c1``, ``c2``, ``lead``, ``n``, ``context``).

    Rows: stretches of contexts that repeat within their run (``w1`` null), and, of anchors
    with several runs, the different suffixes of each run (place to the anchor, digest; ``end``
    is null if the suffix is known to repeat).
    """
    schema = arrow_schema(SORTED)

    def sort(held: list[tuple]) -> pa.RecordBatch:
        a, number, runs, c1, c2, lead, n, text = zip(*held)
        row, local, flag = covered(list(zip(a, number)), lead, n, text)
        at, begin, end = stretches(row, local, flag)
        out = [(a[k], c1[k], c2[k], x, y, None, None, None) for k, x, y in zip(at.tolist(), begin.tolist(), end.tolist())]
        several = np.array(runs)[row] > 1
        met: dict[tuple, tuple] = {}
        for k, i, known in zip(row[several].tolist(), local[several].tolist(), flag[several].tolist()):
            d = digest(text[k][i : i + LENGTH])
            met.setdefault((a[k], number[k], lead[k] - i, d), (k, i, known))
        if met:
            w = longs([key[3] for key in met]).tolist()
            out += [(a[k], c1[k], c2[k], i, None if known else i + LENGTH, place, *x) for ((_, _, place, _), (k, i, known)), x in zip(met.items(), w)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > PORTION and row[:2] != last:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                last, size = row[:2], size + len(row[7])
        if held:
            yield sort(held)

    dealt = contexts.select("a", "run", "runs", "c1", "c2", "lead", "n", "context").repartition("a", "run").sortWithinPartitions("a", "run")
    return dealt.mapInArrow(tidied(run), SORTED)


def merged_runs(sorted_: DataFrame) -> DataFrame:
    """``a``, ``c1``, ``c2``, ``begin``, ``end``: stretches of contexts that repeat, within a run or between runs."""
    names, same = ["a", "c1", "c2", "begin", "end"], ["a", "place", "w1", "w2"]
    suffixes = sorted_.where("w1 IS NOT NULL")
    several = suffixes.groupBy(*same).agg(F.count("*").alias("times")).where("times > 1")
    return sorted_.where("w1 IS NULL").select(*names).unionByName(suffixes.where("end IS NOT NULL").join(several, same, "left_semi").select(*names))


# -- the whole -----------------------------------------------------------------


def _squeezed_classes(texts: DataFrame) -> DataFrame:
    """``t1``, ``t2``, ``z``: texts, a class once a task."""
    def run(batches):
        import zstandard

        seen, pack = {}, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in portions(batch, 0, 64):
                rows = [(t, pack(data)) for t, data, first in _first_sights(part.column(0).to_pylist(), seen) if first]
                if rows:
                    t = longs([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array([r[1] for r in rows], pa.binary())], names=["t1", "t2", "z"])

    return texts.select("text").mapInArrow(tidied(run), "t1 long, t2 long, z binary")


def repeats(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``t1``, ``t2``, ``spans``: the stretches to remove from each class of texts that has any (not united yet)."""
    texts = small_batches(df).select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    found = staged(items(texts), "anchors")
    known = found.where("a IS NOT NULL")
    counts = (
        known.groupBy("a").agg(F.sum("n").alias("times"), F.count("*").alias("rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)))
        .where("times > 1").select("a", ((F.col("min_c1") != F.col("max_c1")) | (F.col("min_c2") != F.col("max_c2"))).alias("several"), "rows")
    )
    often = staged(counts, "frequent-anchors")
    again = staged(join_with_hot(known, often, ["a"], most_rows(often, ["a"], "rows")), "repeated-anchors")
    # one example of each context of an anchor that has several
    one = [F.first(c).alias(c) for c in ("t1", "t2", "lo", "hi", "p", "rows")]
    kinds = staged(again.where("several").groupBy("a", "c1", "c2").agg(F.sum("n").alias("n"), F.count("*").alias("here"), *one), "kinds")
    runs = F.ceil(F.col("rows") / RUN)
    item = F.struct("a", F.pmod(F.col("c1"), runs).alias("run"), runs.alias("runs"), "c1", "c2", (F.col("p") - F.col("lo")).alias("lead"), "n", "lo", (F.col("hi") + LENGTH).alias("end"))
    asked = kinds.groupBy("t1", "t2").agg(F.collect_list(item).alias("items"))  # at most the items of one text
    met = _squeezed_classes(texts).join(asked, ["t1", "t2"]).select("z", "items")
    cut_schema = "a long, run long, runs long, c1 long, c2 long, lead int, n long, context binary"
    schema = arrow_schema(cut_schema)

    def cut(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, wanted in zip(*(c for c in batch.columns)):
                data = open_(z.as_py())
                rows = [(*(i[f] for f in ("a", "run", "runs", "c1", "c2", "lead", "n")), data[i["lo"] : i["end"]]) for i in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows))], schema=schema)

    contexts = staged(met.mapInArrow(tidied(cut), cut_schema), "contexts").dropDuplicates(["a", "c1", "c2"])
    sorted_ = staged(sort_contexts(contexts), "sorted-runs")
    parts = staged(merged_runs(sorted_), "context-repeats")
    several = join_with_hot(again.where("several").select("a", "c1", "c2", "t1", "t2", "lo"), parts, ["a", "c1", "c2"], most_rows(kinds, ["a", "c1", "c2"], "here"))
    spans = (
        again.where("NOT several").select("t1", "t2", F.col("lo").alias("begin"), (F.col("hi") + LENGTH).alias("end"))
        .unionByName(several.select("t1", "t2", (F.col("lo") + F.col("begin")).alias("begin"), (F.col("lo") + F.col("end")).alias("end")))
        .unionByName(found.where("a IS NULL").select("t1", "t2", F.col("lo").alias("begin"), (F.col("hi") + LENGTH).alias("end")))
    )
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def removed(df: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns but the text, and ``_d_bytes``, ``_d_spans`` (united stretches), ``_d_kept`` (remaining bytes) of every row."""
    others = [c for c in df.columns if c != text_column]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    ids = dict(zip(("_d_t1", "_d_t2"), text_ids(text)))
    keyed = df.select(*(c.alias(n) for n, c in ids.items()), *(F.col(f"`{c}`") for c in others), text.alias("_d_text"))
    # rows of a hot text go whole, as they repeat; they are spread, not dealt by their text
    hot = hot_keys(keyed.select(*ids), list(ids))
    if hot is None:
        marked = keyed.withColumn("_d_hot", F.lit(False))
    else:
        marked = keyed.join(F.broadcast(hot.withColumn("_d_hot", F.lit(True))), list(ids), "left").withColumn("_d_hot", F.coalesce("_d_hot", F.lit(False)))
    marked = marked.withColumn("_d_t1", F.when(F.col("_d_hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("_d_t1")))
    marked = marked.withColumn("_d_z", squeezed("_d_text")).drop("_d_text")
    spans = repeats(df, text_column).select(F.col("t1").alias("_d_t1"), F.col("t2").alias("_d_t2"), F.lit(False).alias("_d_hot"), F.col("spans").alias("_d_found"))
    joined = marked.join(spans, ["_d_t1", "_d_t2", "_d_hot"], "left")
    fields = {f.name: f for f in df.schema}
    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in others] + ["_d_bytes long", "_d_spans array<struct<begin:long,end:long>>", "_d_kept binary"])
    arrow = arrow_schema(schema)

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in portions(batch, len(others), 64):
                sizes, found_, kept = [], [], []
                for z, found, hot_ in zip(*(c.to_pylist() for c in part.columns[len(others) :])):
                    data = open_(z)
                    if hot_:
                        found = [{"begin": 0, "end": len(data)}] if len(data) >= LENGTH else []
                    begin, end = united(np.array([s["begin"] for s in found or ()], np.int64), np.array([s["end"] for s in found or ()], np.int64))
                    edges = [0, *(x for pair in zip(begin.tolist(), end.tolist()) for x in pair), len(data)]
                    sizes.append(len(data))
                    found_.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist())])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                made = [pa.array(c, f.type) for c, f in zip((sizes, found_, kept), list(arrow)[len(others) :])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *made], schema=arrow)

    return joined.select(*(f"`{c}`" for c in others), "_d_z", "_d_found", "_d_hot").mapInArrow(tidied(run), schema)


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    gone = F.aggregate("_d_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return cut.select(
        F.col(f"`{key}`").alias("doc_id"), F.col("_d_bytes").alias("n_bytes"), gone.alias("n_removed"),
        F.size("_d_spans").cast("long").alias("n_spans"), F.sha2("_d_kept", 256).alias("kept_sha256"),
    )


@F.pandas_udf(StringType())
def _decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda b: b.decode("utf-8", "ignore"))


def without_repeats(df: DataFrame, text_column: str = "text", count_column: str = "n_chars") -> DataFrame:
    """``df`` with repeated stretches cut out of its texts; a character that a cut splits goes with it.

    A null text stays null; ``count_column``, if there is one, is set to the new text's length.
    """
    cut = removed(df.withColumn("_d_null", F.col(f"`{text_column}`").isNull()), text_column)
    text = F.when(~F.col("_d_null"), _decoded("_d_kept"))
    out = cut.withColumn("_d_text", text)
    columns = []
    for c, kind in df.dtypes:
        if c == text_column:
            columns.append(F.col("_d_text").alias(c))
        elif c == count_column:
            columns.append(F.when(F.col("_d_null"), F.col(f"`{c}`")).otherwise(F.length("_d_text").cast(kind)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
