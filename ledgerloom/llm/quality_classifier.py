"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. *Word vectors.*  Each word has a sparse random index vector of its own, drawn from
   its 64-bit hash.  Over all documents, a word's context vector is the sum of the
   index vectors of the words around its occurrences; tasks pass on partial counts by word
   and then one partial sum of each frequent one, which Spark adds up.  A word that is at least one in ``SHARES`` of all words has
   its context vector in the table that scoring uses: at most ``SHARES`` words can, so
   the table's size is bounded whatever the input (and every input is treated alike).
   Rarer words stand for themselves by their index vector alone; none is left out, and
   no two words share a vector.  Case doesn't matter to a word, and digits are one word
   a length.  Texts are cut in bulk, by the kinds of their characters; strings are made
   and hashed for the different words of a portion only.
2. *Pooling.*  A document is the mean and the spread of its word vectors, its
   logarithmic length, and its shares of different words, capitals, digits and signs.
3. *Network.*  Two layers, trained in numpy on at most ``TRAIN_ROWS`` labelled documents,
   those with the least hash of their key (the one place where a sample is taken), one
   row each however often the key comes.
4. *Calibration.*  One temperature, fitted on labelled rows that the layers did not
   see, turns the network's output into a probability.

Scores depend on the text alone, so equal texts score alike.

Defined results: a null text is empty; an empty text is scored from its zero vector;
labels that are null don't count, a document with several has their largest; with
no labels, or one class only, every score is the smoothed share of label 1; rows
with null or repeated keys are scored each.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ARROW_ROWS, arrow_schema, portions, record_batch, small_batches, staged, tidied

#: Words in the table at most (and the share of all words that brings one there), and occurrences that it needs.
SHARES, LEAST = 1 << 18, 5
#: Size of a vector, and how many places of an index vector are drawn.
DIM, NONZERO = 32, 4
#: Words on either side that count as context.
REACH = 2
#: Labelled documents that the network sees at most; one in CALIBRATE is kept for the temperature.
TRAIN_ROWS, CALIBRATE = 20_000, 5
HIDDEN, EPOCHS, STEP, BATCH, DECAY = 32, 40, 3e-3, 256, 1e-4
SEED = 20_240
FEATURES = 2 * DIM + 5

#: Words that a worker remembers at most, counts that it holds before they are added up, and words handled at once.
REMEMBERED, COUNTED, CHUNK = 100_000, 1 << 20, 1 << 16

#: What a word is; ``split`` finds the same by the kinds of characters.
_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
SPACE, LETTER, DIGIT, SIGN = range(4)


@functools.cache
def kinds_of_characters() -> np.ndarray:
    """The kind of every code point."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"[^\W\d_]+"), (DIGIT, r"\d+")):
        for run in re.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    return out


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of the texts, which of them each word is, in order, and where each text's words begin and end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    edges = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data and len(edges) else np.zeros(0, np.uint8)
    if not len(raw):
        return [], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    edges = edges - edges[0]
    kind = kinds_of_characters()[:256].take(raw)
    beyond = raw > 127
    if beyond.any():  # of these characters all bytes are as the character
        rest = raw[beyond]
        characters = np.frombuffer(rest.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind[beyond] = np.repeat(kinds_of_characters()[characters], np.diff(np.flatnonzero(rest > 191), append=len(rest)))
    begins = kind == SIGN
    begins &= (raw & 0xC0) != 0x80
    begins[1:] |= kind[1:] != kind[:-1]
    begins[edges[:-1][edges[:-1] < len(raw)]] = True
    word = kind != SPACE
    begins &= word
    starts = np.flatnonzero(begins[word])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.count_nonzero(word))), pa.py_buffer(raw[word])).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.searchsorted(np.flatnonzero(begins), edges)


def tokens_of(text: str | None) -> list[str]:
    words, which, _ = split(pa.array([text], pa.large_string()))
    return [words[k] for k in which]


def word_ids(tokens: list[str]) -> np.ndarray:
    """The hashes of words, signed; digits are one word a length."""
    import xxhash

    lower = "\n".join(tokens).lower().split("\n")  # no word holds a line's end
    words = (f"\0digits{len(t)}" if t.isdigit() else w for t, w in zip(tokens, lower))
    return np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(SEED)), np.uint64, len(tokens)).view(np.int64)


def word_id(token: str) -> int:
    return int(word_ids([token])[0])


def index_vectors(ids: np.ndarray) -> np.ndarray:
    """Sparse vectors of 1 and -1, drawn from the ids' bits."""
    h, rows = ids.astype(np.int64).view(np.uint64), np.arange(len(ids))
    out = np.zeros((len(ids), DIM), np.int8)
    for k in range(NONZERO):
        place = ((h >> np.uint64(5 * k)) % np.uint64(DIM)).astype(np.int64)
        out[rows, place] += np.where(h >> np.uint64(40 + k) & np.uint64(1), 1, -1).astype(np.int8)
    return out


class Rows(dict):
    """Words' rows; a word that is looked up and isn't there gets the next one and is listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self) + 1
        self.new.append(token)
        return row


class Words:
    """The words that a worker has met, as rows of arrays that double when full; row 0 is no word."""

    def __init__(self, made):
        """``made`` gives arrays for new words' ids and tokens."""
        self.row = Rows()
        self.n, self.made = 1, made
        self.ids = np.zeros(1024, np.int64)
        self.arrays = [np.zeros((1024, *x.shape[1:]), x.dtype) for x in made(np.zeros(1, np.int64), ["-"])]

    def full(self) -> bool:
        return len(self.row) > REMEMBERED

    def of(self, tokens: list[str]) -> np.ndarray:
        """Rows of different words."""
        out = np.fromiter(map(self.row.__getitem__, tokens), np.int32, len(tokens))
        if new := self.row.new:  # what they need is made for all at once
            at, self.n, self.row.new = self.n, self.n + len(new), []
            ids = word_ids(new)
            self.ids = grown(self.ids, self.n)
            self.ids[at : self.n] = ids
            self.arrays = [grown(x, self.n) for x in self.arrays]
            for x, y in zip(self.arrays, self.made(ids, new)):
                x[at : self.n] = y
        return out

    def rows(self, texts: list | pa.Array) -> list[np.ndarray]:
        """Rows of each text's words, in order."""
        words, which, edges = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        return np.split(self.of(words).take(which), edges[1:-1])


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` rows, the new ones zero."""
    if n <= len(x):
        return x
    out = np.zeros((max(n, 2 * len(x)), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


def add_contexts(table: np.ndarray, counts: np.ndarray, texts: list[np.ndarray], index: np.ndarray, place: np.ndarray) -> None:
    """Add the context vectors of all words of the texts (rows of words) to their places in the table."""
    gap = np.zeros(REACH, np.int32)
    line = np.concatenate([gap] + [x for t in texts for x in (t, gap)])
    for at in range(REACH, len(line) - REACH, CHUNK):
        end = min(at + CHUNK, len(line) - REACH)
        near = index.take(line[at - REACH : end + REACH], axis=0)
        # sums of 2 * REACH entries, each of NONZERO at most, stay within 8 bits
        around = sum((near[REACH + k : len(near) - REACH + k] for k in range(-REACH, REACH + 1) if k), np.zeros((end - at, DIM), np.int8))
        placed = np.sort(place.take(line[at:end]) << 32 | np.arange(end - at))  # words stand in the upper half
        places, order = placed >> 32, placed & 0xFFFFFFFF
        edges = np.flatnonzero(np.diff(places, prepend=-1))
        found = places[edges]
        table[found] += np.add.reduceat(around.take(order, axis=0), edges, axis=0, dtype=np.int32)
        counts[found] += np.diff(edges, append=len(places))


def summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and the sums of their counts."""
    found, which = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, which, np.concatenate([np.zeros(0, np.int64), *counts]))
    return found, out


def word_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``w``, ``n``: how often each word occurs, over all rows."""
    def run(batches):
        ids, counts, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(ids, counts)], names=["w", "n"])

        for batch in batches:
            for part in portions(batch, 0, ARROW_ROWS):
                tokens, which, _ = split(part.column(0))
                ids.append(word_ids(tokens))
                counts.append(np.bincount(which, minlength=len(tokens)))
                held += len(tokens)
                if held > COUNTED:
                    yield flush()
                    ids, counts, held = [], [], 0
        yield flush()

    return small_batches(df).select(f"`{text_column}`").mapInArrow(tidied(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text_column: str = "text", shares: int = SHARES, least: int = LEAST) -> np.ndarray:
    """Sorted ids of the words that are one in ``shares`` of all words and occur ``least`` times: at most ``shares`` of them."""
    counts = staged(word_counts(df, text_column), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") * shares >= total) & (F.col("n") >= least)).select("w").orderBy("w").toArrow()["w"].to_numpy()


def context_sums(df: DataFrame, frequent: np.ndarray, text_column: str = "text") -> DataFrame:
    """``w``, ``n`` and ``s0`` to ``s31``: count and context sum of each frequent word, and of all words together (``w`` null), over all rows."""
    names = [f"s{k}" for k in range(DIM)]
    schema = "w long, n long, " + ", ".join(f"{c} long" for c in names)

    def made(ids, _):
        """Index vectors, and places in the sums: the first is for no word, the last for words that aren't frequent."""
        at = np.searchsorted(frequent, ids)
        known = np.append(frequent, 0)[at] == ids
        return index_vectors(ids), np.where(known & (at < len(frequent)), at, len(frequent)) + 1

    def run(batches):
        words = None
        table, counts = np.zeros((len(frequent) + 2, DIM), np.int64), np.zeros(len(frequent) + 2, np.int64)

        def row(ids, counts, table):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts)] + [pa.array(np.ascontiguousarray(table[:, k])) for k in range(DIM)], names=["w", "n", *names])

        for batch in batches:
            for part in portions(batch, 0, ARROW_ROWS):
                if words is None or words.full():
                    words = Words(made)
                rows = words.rows(part.column(0))
                add_contexts(table, counts, rows, *words.arrays)
        found = np.flatnonzero(counts[1:-1])
        yield row(frequent[found], counts[1:-1][found], table[1:-1][found])
        yield row([None], counts[1:].sum(keepdims=True), table[1:].sum(axis=0, keepdims=True))

    sums = small_batches(df).select(f"`{text_column}`").mapInArrow(tidied(run), schema)
    return sums.groupBy("w").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


class Vectors:
    """Context vectors of the words that have one, by sorted id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The words' vectors: their context's, if known, and a little of their own."""
        out = index_vectors(ids).astype(np.float32) / NONZERO**0.5
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            known = self.ids[at] == ids
            out[known] += self.vectors[at[known]]
        return out


def word_vectors(df: DataFrame, text_column: str = "text") -> Vectors:
    """Vectors of the frequent words: the usual context taken off, unit length."""
    rows = context_sums(df, frequent_words(df, text_column), text_column).orderBy("w").toArrow()  # at most ``SHARES`` and one
    ids, n = rows["w"], rows["n"].to_numpy().astype(np.float64)
    table = np.stack([rows[f"s{k}"].to_numpy() for k in range(DIM)], axis=1)
    if not len(n):
        return Vectors(np.zeros(0, np.int64), np.zeros((0, DIM), np.float16))
    mean = table[0] / max(1.0, n[0])  # null, all words, comes first
    vectors = table[1:] / n[1:, None] - mean
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Vectors(ids.slice(1).to_numpy().astype(np.int64), vectors.astype(np.float16))


def shapes(tokens: list[str]) -> np.ndarray:
    """Whether each word is in capitals, digits, or a sign."""
    kinds = ([len(t) > 1 and t.isupper() for t in tokens], [t.isdigit() for t in tokens], [not t.isalnum() for t in tokens])
    return np.array(kinds, bool).T.astype(np.float32)


_met: list = [None, None]  # the vectors that this worker uses, and the words that it has met


def pooled(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """Each text's features."""
    parts = portions(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, ARROW_ROWS)
    return np.concatenate([np.zeros((0, FEATURES), np.float32), *(pooled_part(part.column(0), vectors) for part in parts)])


def pooled_part(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """As ``pooled``, all texts at once."""
    if _met[0] is not vectors or _met[1].full():
        _met[:] = vectors, Words(lambda ids, tokens: (vectors.of(ids), shapes(tokens)))
    words = _met[1]
    tokens, which, edges = split(texts)
    rows, sizes = words.of(tokens), np.diff(edges)
    v = words.arrays[0].take(rows, axis=0).astype(np.float64)
    each = np.concatenate([v, v**2, words.arrays[1].take(rows, axis=0)], axis=1)  # what is averaged, of each different word
    met = np.sort(np.repeat(np.arange(len(texts)), sizes) << 32 | which)  # text and word
    first = np.flatnonzero(np.diff(met, prepend=-1))
    times, kinds = np.diff(first, append=len(met)), met[first] & 0xFFFFFFFF
    ends = np.searchsorted(first, edges)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, size, at, end in zip(out, sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        if size:
            means = times[at:end] / size @ each.take(kinds[at:end], axis=0)
            mean = means[:DIM]
            row[:DIM], row[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(means[DIM : 2 * DIM] - mean**2, 0))
            row[2 * DIM], row[2 * DIM + 1], row[2 * DIM + 2 :] = np.log1p(size), (end - at) / size, means[2 * DIM :]
    return out


def pool_frame(df: DataFrame, vectors: Vectors, columns: list[str], schema: str) -> DataFrame:
    """``columns`` of ``df``, of whose last, a text, the features are made."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            *values, texts = batch.columns
            yield record_batch(dict(zip(columns, values)) | {"vector": list(pooled(texts, vectors))}, arrow)

    return small_batches(df.select(*columns)).mapInArrow(tidied(run), schema)


def training_keys(labels: DataFrame, learn) -> DataFrame:
    """``doc_id`` and ``quality`` of at most ``TRAIN_ROWS`` labelled documents for which ``learn`` holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


class Network:
    """Two layers over standardised features, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.base = (y.sum() + 1) / (len(y) + 2)
        self.layers = None
        fit = ~calibrate
        if len(set(y[fit])) < 2:
            return
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        a, t = self._scaled(x[fit]), y[fit]
        n = a.shape[1]
        p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(t.mean() / (1 - t.mean())))]
        m, v, k = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(a))
            for at in range(0, len(order), BATCH):
                b, c = a[order[at : at + BATCH]], t[order[at : at + BATCH]]
                h = np.tanh(b @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - c) / len(b)
                dh = np.outer(d, p[2]) * (1 - h**2)
                k += 1
                for i, g in enumerate((b.T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], d.sum())):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                    p[i] = p[i] - STEP * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if calibrate.any():
            z, c = self.logits(x[calibrate]), y[calibrate]
            loss = [np.logaddexp(0, np.where(c > 0.5, -z, z) / s).sum() for s in TEMPERATURES]
            self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh(self._scaled(x) @ p[0] + p[1]) @ p[2] + p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


TEMPERATURES = np.geomspace(0.5, 8, 49)


def train(df: DataFrame, labels: DataFrame, learn, text_column: str = "text", key: str = "doc_id") -> tuple[Vectors, Network]:
    """Word vectors from all of ``df`` and a network from the labelled rows for which ``learn(key)`` holds."""
    vectors = word_vectors(df, text_column)
    texts = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    sample = texts.join(F.broadcast(training_keys(labels, learn)), "doc_id")  # at most TRAIN_ROWS short rows
    rows = pool_frame(sample, vectors, ["doc_id", "quality", "text"], "doc_id long, quality double, vector array<float>")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("vector").alias("vector")).orderBy("doc_id").toArrow()  # at most TRAIN_ROWS
    keys, y = rows["doc_id"].to_numpy(), rows["quality"].to_numpy()
    x = np.array(rows["vector"].to_pylist(), np.float32).reshape(len(keys), FEATURES)
    calibrate = np.array([zlib.crc32(b"calibrate %d" % k) % CALIBRATE == 0 for k in keys.tolist()], bool)
    return vectors, Network(x, y, calibrate)


def score_column(vectors: Vectors, network: Network):
    """A column function: text to the probability of label 1.  Only the text goes to Python."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(network.scores(pooled(pa.array(texts, pa.large_string()), vectors)))

    return scored


def score(df: DataFrame, vectors: Vectors, network: Network, text_column: str = "text") -> DataFrame:
    """``df`` and ``_c_score`` of every row."""
    return small_batches(df).withColumn("_c_score", score_column(vectors, network)(F.col(f"`{text_column}`")))


def fold(key) -> F.Column:
    """crc32 of the key as text, modulo 3; a row whose fold is 1 is held out.  A null key has fold null."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, learnt from labels outside fold 1; columns as in ``df``."""
    vectors, network = train(df, labels, lambda key: fold(key) != 1)
    return score(df, vectors, network).where(F.col("_c_score") >= threshold).drop("_c_score")
