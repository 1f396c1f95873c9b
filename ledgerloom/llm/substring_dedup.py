"""Exact removal of repeated word windows, by anchors at the positions of a difference cover.

Every word that is covered by a window of ``WINDOW`` words whose word sequence also starts
earlier (in a document of smaller key, or before in the same document) goes; windows are
judged on the input.

``COVER`` is a difference cover modulo ``PERIOD``: every difference of two positions is, modulo
the period, a difference of two of its members.  So any two equal windows, wherever they
start, have a place ``d < PERIOD`` at which both positions ``start + d`` lie on the cover, and the
``ANCHOR = WINDOW - PERIOD + 1`` words from there are in both.  Only those words are hashed: 4 in 13
positions, not all.

How it is spread over a cluster
1. *Anchors.*  Each text gives a row a cover position: the hash of the anchor's words, which
   only brings rows together, and 96 bits of BLAKE2b of its context, the words that
   windows holding the anchor can reach.  In one step of a task equal contexts are one
   row; the later ones are settled there and only pass through.
2. *Extension.*  Rows are shuffled by the anchor's hash and sorted, and a task streams
   over them with one row of memory.  In a class of equal contexts all but the earliest
   occurrence are repeats, with all windows that hold them.  The earliest of a class is
   *open* if its anchor has other contexts too, as some of its windows may begin earlier there.
3. *Open windows.*  Their windows are cut from the texts, hashed (128 bits of BLAKE2b) and meet
   in the same way; all but the earliest are repeats.
4. *Removal.*  What was found meets the texts by key, is united and cut out.

Skew: an anchor that very many documents have in different contexts (a line of a page's
frame) is *hot*; a sample of one text in ``SAMPLE`` tells which may be, at most ``SHARES``, and their
rows are dealt by context instead.  This changes where rows meet, not what is found: the
earliest of each hot context is always open.  Equal contexts and windows are settled
in each step of a task first, so a passage that a third of all documents have
gives a row a step of ``STEP`` bytes.

Equality of contexts is decided by 96 bits, of windows by 128, of a cryptographic hash; no bytes are compared.

Defined results: a null text has no words; a text under ``WINDOW`` words stays whole; a null
key comes after all others, and documents without one by a hash of their texts; rows of equal
keys are one place in the order, so a repeated row doesn't repeat itself, and its
occurrences are compared with other rows of its key by position; an empty table gives no
rows; other columns are carried in ``row``, so they may have any names.  Texts of any
length are read whole, in steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ledgerloom.llm.common import SHARES, arrow_schema, free_shuffles, portions, small_batches, squeezed, staged, tidied

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose rows are settled together, and rows made at once from a long text.
STEP, PIECE = 2 << 20, 1 << 16
#: One text in so many is looked at for hot anchors; rows that one has there at least.
SAMPLE, HOT = 64, 64
#: A null key's place in the order.
LAST = (1 << 63) - 1

#: ``k`` deals, ``c`` and the upper half of ``x`` tell classes apart, its lower half is the place with two marks, ``doc`` and ``r`` are the document.
ROWS = "k long, c long, x long, doc long, r long"
FOUND = "doc long, r long, p int, c long, open boolean"
_HOT, _SETTLED, _PLACE = np.int64(1 << 31), np.int64(1 << 30), np.int64((1 << 30) - 1)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """A text's words: ``line`` has them joined by one space, ``start`` and ``end`` are their places in it."""

    def __init__(self, data: bytes):
        signs = np.frombuffer(data, np.uint8)
        space = _SPACE[signs]
        after = np.concatenate([[True], space[:-1]])
        kept = np.where(space, np.uint8(32), signs)[~(space & after)]
        if len(kept) and kept[-1] == 32:
            kept = kept[:-1]
        gaps = np.flatnonzero(kept == 32)
        some = [len(kept)] if len(kept) else []
        self.line = kept.tobytes()
        self.end = np.concatenate([gaps, np.array(some, np.int64)])
        self.start = np.concatenate([np.zeros(len(some), np.int64), gaps + 1])

    def __len__(self) -> int:
        return len(self.start)

    def cover(self) -> np.ndarray:
        """The positions at which anchors begin."""
        n = len(self)
        if n < WINDOW:
            return np.zeros(0, np.int64)
        places = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
        return places[places <= n - ANCHOR]

    def stretches(self, first: np.ndarray, stop: np.ndarray):
        """The bytes of the words ``first`` to ``stop - 1``, each."""
        line = self.line
        return (line[a:b] for a, b in zip(self.start[first].tolist(), self.end[stop - 1].tolist()))

    def anchors(self, places: np.ndarray) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, self.stretches(places, places + ANCHOR)), np.uint64, len(places)).view(np.int64)

    def contexts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 more bits for what windows that hold an anchor can reach; a context that the text's begin cuts is told by its lead."""
        lead = np.minimum(places, PERIOD - 1)
        parts = self.stretches(places - lead, np.minimum(places + WINDOW, len(self)))
        blake = hashlib.blake2b
        made = b"".join([blake(s if a == PERIOD - 1 else b"%d\n%s" % (a, s), digest_size=12).digest() for a, s in zip(lead.tolist(), parts)])
        both = np.frombuffer(made, np.dtype([("c", "<i8"), ("hi", "<i4")]))
        return both["c"].copy(), both["hi"].astype(np.int64)

    def windows(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blake = hashlib.blake2b
        made = b"".join([blake(s, digest_size=16).digest() for s in self.stretches(begin, begin + WINDOW)])
        both = np.frombuffer(made, "<i8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def settled_here(k: np.ndarray, c: np.ndarray, hi: np.ndarray, p: np.ndarray, doc: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to pass on and which of them are settled repeats; rows that are the same place are one."""
    order = np.argsort(c, kind="stable")
    same = c[order[1:]] == c[order[:-1]]
    meets = np.zeros(len(c), bool)
    meets[order[1:][same]] = True
    meets[order[:-1][same]] = True
    at = np.flatnonzero(meets)
    if not len(at):
        return np.arange(len(c)), np.zeros(len(c), bool)
    at = at[np.lexsort((p[at], r[at], doc[at], hi[at], k[at], c[at]))]
    alike = lambda *columns: np.concatenate([[False], np.logical_and.reduce([x[at[1:]] == x[at[:-1]] for x in columns])])
    repeat = alike(c, k, hi)
    again = repeat & alike(doc, r, p)  # the same place once more
    lead = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(at))))
    first = at[lead]
    repeat &= (doc[at] != doc[first]) | (r[at] != r[first]) | (p[at] != p[first])
    passed, settled = np.ones(len(c), bool), np.zeros(len(c), bool)
    passed[at[again]] = False
    settled[at[repeat]] = True
    keep = np.flatnonzero(passed)
    return keep, settled[keep]


def _emit(parts: list[tuple], schema: pa.Schema, hot: np.ndarray | None) -> pa.RecordBatch:
    k, c, hi, p, doc, r = (np.concatenate(x) for x in zip(*parts))
    keep, settled = settled_here(k, c, hi, p, doc, r)
    k, c, hi, p, doc, r = (x[keep] for x in (k, c, hi, p, doc, r))
    x = (hi << np.int64(32)) | p
    if hot is not None and len(hot):
        is_hot = np.isin(k, hot)
        k = np.where(is_hot, mixed(k, c), k)
        x |= np.where(is_hot, _HOT, np.int64(0))
    k = np.where(settled, mixed(c, doc + p), k)  # anywhere
    x |= np.where(settled, _SETTLED, np.int64(0))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (k, c, x, doc, r)], schema=schema)


def _collected(made, schema: pa.Schema, hot: np.ndarray | None):
    """Batches of the rows of several texts; ``made`` gives (bytes of text, columns)."""
    parts, held = [], 0
    for size, columns in made:
        parts.append(columns)
        held += size
        if held >= STEP:
            yield _emit(parts, schema, hot)
            parts, held = [], 0
    if parts:
        yield _emit(parts, schema, hot)


def keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """``doc``, ``r`` (0 but for null keys), ``text`` and ``row``, the other columns."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    r = F.when(F.col(f"`{key}`").isNull(), F.xxhash64(whole).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc"), r.alias("r"), whole.alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("row"))


def anchor_rows(texts: DataFrame, hot: list[int] = ()) -> DataFrame:
    """``ROWS`` of all cover positions of ``doc``, ``r``, ``text``."""
    schema, hot = arrow_schema(ROWS), np.array(sorted(hot), np.int64)

    def of_texts(batches):
        for batch in batches:
            for part in portions(batch, 2):
                for doc, r, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = Words(text.encode("utf-8", "replace"))
                    places = words.cover()
                    for at in range(0, len(places), PIECE):
                        p = places[at : at + PIECE]
                        c, hi = words.contexts(p)
                        yield len(words.line) * len(p) // len(places), (words.anchors(p), c, hi, p, np.full(len(p), doc), np.full(len(p), r))

    return small_batches(texts).select("doc", "r", "text").mapInArrow(tidied(lambda batches: _collected(of_texts(batches), schema, hot)), ROWS)


def hot_anchors(texts: DataFrame, sample: int = SAMPLE, least: int = HOT) -> list[int]:
    """At most ``SHARES`` anchors that many different contexts have, judged by one text in ``sample``."""
    seen = anchor_rows(texts.where(F.pmod(F.xxhash64("doc", "r"), F.lit(sample)) == 0)).where(F.col("x").bitwiseAND(F.lit(int(_SETTLED))) == 0)
    return [x.k for x in seen.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "k").limit(SHARES).collect()]


def later_ones(rows: DataFrame, opens: bool) -> DataFrame:
    """``FOUND``: all rows of a class but its earliest, and, if asked for, the earliest ones of hot classes or beside others (``open``)."""
    schema = arrow_schema(FOUND)

    def batch_of(doc, r, p, c, open_) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(r), pa.array(p.astype(np.int32)), pa.array(c), pa.array(np.full(len(doc), open_))], schema=schema)

    def run(batches):
        last = first = pending = None  # the last row's k, c, hi; its class's doc, r, p; the last class's (columns, whether it is open so far)
        for batch in batches:
            k, c, x, doc, r = (col.to_numpy() for col in batch.columns)
            done = (x & _SETTLED) != 0
            if done.any():
                yield batch_of(doc[done], r[done], (x & _PLACE)[done], c[done], False)
                k, c, x, doc, r = (v[~done] for v in (k, c, x, doc, r))
            if not len(k):
                continue
            hi, p, hot = x >> np.int64(32), x & _PLACE, (x & _HOT) != 0
            before = [np.concatenate([v[:1] if last is None else [last[i]], v[:-1]]) for i, v in enumerate((k, c, hi))]
            group = k != before[0]
            kind = group | (c != before[1]) | (hi != before[2])
            if last is None:
                group[0] = kind[0] = True
            lead = np.maximum.accumulate(np.where(kind, np.arange(len(k)), -1))
            own = [np.where(lead >= 0, v[lead], first[i] if first is not None else 0) for i, v in enumerate((doc, r, p))]
            again = ~kind & ((doc != own[0]) | (r != own[1]) | (p != own[2]))
            if again.any():
                yield batch_of(doc[again], r[again], p[again], c[again], False)
            heads = np.flatnonzero(kind)
            if opens and len(heads):
                if pending is not None and (pending[1] or not group[heads[0]]):
                    yield batch_of(*pending[0], True)
                beside = np.append(~group[heads[1:]], False) | ~group[heads] | hot[heads]
                wanted = heads[:-1][beside[:-1]]
                if len(wanted):
                    yield batch_of(doc[wanted], r[wanted], p[wanted], c[wanted], True)
                at = heads[-1:]
                pending = (doc[at], r[at], p[at], c[at]), bool(beside[-1])
            last, first = (k[-1], c[-1], hi[-1]), tuple(v[-1] for v in own)
        if pending is not None and pending[1]:
            yield batch_of(*pending[0], True)

    return rows.repartition("k").sortWithinPartitions("k", "c", F.shiftright("x", 32), "doc", "r", "x").mapInArrow(tidied(run), FOUND)


def _claims(found: DataFrame) -> DataFrame:
    """What was found in each document, at most its own positions."""
    return found.groupBy("doc", "r").agg(F.collect_set(F.struct("p", "c", "window")).alias("claims"))


def _read(claims: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = claims[at].values
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return found.field(0).to_numpy().astype(np.int64), found.field(1).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)


def _true_places(words: Words, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Those of the places whose context is the claimed one; others are of another text of the same key."""
    fits = p <= len(words) - ANCHOR if len(words) >= WINDOW else np.zeros(len(p), bool)
    p, c = p[fits], c[fits]
    return p[words.contexts(p)[0] == c] if len(p) else p


def window_rows(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """``ROWS`` of the windows that hold an open anchor."""
    schema = arrow_schema(ROWS)
    met = texts.select("doc", "r", squeezed("text").alias("z")).join(_claims(open_.withColumn("window", F.lit(False))), ["doc", "r"])

    def of_texts(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            claims = batch.column(3)
            for at, (doc, r, z) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                words = Words(unpack(z))
                p, c, _ = _read(claims, at)
                p = _true_places(words, p, c)
                if not len(p):
                    continue
                step = np.zeros(len(words) - WINDOW + 2, np.int64)
                np.add.at(step, np.maximum(p - PERIOD + 1, 0), 1)
                np.add.at(step, np.minimum(p, len(words) - WINDOW) + 1, -1)
                begin = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                for piece in np.array_split(begin, -(-len(begin) // PIECE)):
                    w1, w2 = words.windows(piece)
                    yield len(words.line) * len(piece) // len(words), (w1, w2, np.zeros(len(piece), np.int64), piece, np.full(len(piece), doc), np.full(len(piece), r))

    return met.select("doc", "r", "z", "claims").mapInArrow(tidied(lambda batches: _collected(of_texts(batches), schema, None)), ROWS)


def repeats(texts: DataFrame, sample: int = SAMPLE, least: int = HOT) -> DataFrame:
    """``doc``, ``r``, ``claims``: repeated contexts and windows of each document that has any."""
    found = staged(later_ones(anchor_rows(texts, hot_anchors(texts, sample, least)), True), "anchor-classes")
    free_shuffles(texts.sparkSession)
    windows = staged(later_ones(window_rows(texts, found.where("open")), False), "window-classes")
    free_shuffles(texts.sparkSession)
    both = found.where("NOT open").withColumn("window", F.lit(False)).unionByName(windows.withColumn("window", F.lit(True)))
    return _claims(both)


def removed(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, least: int = HOT) -> DataFrame:
    """``row`` (the other columns), ``n_words``, ``spans`` (removed words, united) and ``kept`` (the others, joined by one space) of every row."""
    texts = keyed(df, text, key)
    wide = texts.select("doc", "r", squeezed("text").alias("z"), "row").join(repeats(texts, sample, least), ["doc", "r"], "left").select("row", "z", "claims")
    span = StructType().add("begin", "long").add("end", "long")
    schema = StructType().add("row", wide.schema["row"].dataType).add("n_words", "long").add("spans", ArrayType(span)).add("kept", "string")
    arrow = arrow_schema(schema)

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            counts, spans, kept = [], [], []
            for at, z in enumerate(batch.column(1).to_pylist()):
                words = Words(unpack(z))
                gone, cut = spans_of(words, *_read(batch.column(2), at))
                counts.append(len(words))
                spans.append(gone)
                kept.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), *(pa.array(v, f.type) for v, f in zip((counts, spans, kept), list(arrow)[1:]))], schema=arrow)

    return wide.mapInArrow(tidied(run), schema)


def spans_of(words: Words, p: np.ndarray, c: np.ndarray, window: np.ndarray) -> tuple[list[dict], str]:
    """The stretches of words that claims cover, united, and the rest as text."""
    n = len(words)
    whole = p[window]
    whole, w = whole[whole <= n - WINDOW], c[window][whole <= n - WINDOW]
    if len(whole):
        whole = whole[words.windows(whole)[1] == w]
    places = _true_places(words, p[~window], c[~window])
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.concatenate([whole, np.maximum(places - PERIOD + 1, 0)]), 1)
    np.add.at(step, np.concatenate([whole + WINDOW, np.minimum(places + WINDOW, n)]), -1)
    covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    begin, end = edges[::2].tolist(), edges[1::2].tolist()
    stays = [(a, b) for a, b in zip([0, *end], [*begin, n]) if a < b]
    text = b" ".join([words.line[words.start[a] : words.end[b - 1]] for a, b in stays])
    return [{"begin": a, "end": b} for a, b in zip(begin, end)], text.decode("utf-8", "replace")


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return cut.select(F.col(f"row.`{key}`").alias("doc_id"), "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the kept words as its text; a null text stays null."""
    marked = df.select(*(F.col(f"`{c}`") for c in df.columns)).withColumn(flag := "_" * (1 + max(map(len, df.columns))), F.col(f"`{text}`").isNull())
    cut = removed(marked, text, key)
    return cut.select(*(F.when(~F.col(f"row.`{flag}`"), F.col("kept")).alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns))
