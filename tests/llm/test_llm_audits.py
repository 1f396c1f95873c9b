"""Repeated word windows, filter interactions and source divergences against plain loops, with every odd case."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, filter_audit, queries, substring_dedup
from ledgerloom.llm.common import ARROW_SETTING

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


# -- repeated windows --------------------------------------------------------------


def place(key, text):
    """A row's document in the order of windows."""
    if key is not None:
        return key, 0
    return substring_dedup.LAST, int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).view(np.int64)) | 1


def plainly_removed(rows):
    """(key, words, removed, kept) of every row by comparing all windows."""
    first = {}
    for key, text in rows:
        w = words_of(text)
        for i in range(len(w) - 19):
            at = (*place(key, text), i)
            g = tuple(w[i : i + 20])
            first[g] = min(first.get(g, at), at)
    out = []
    for key, text in rows:
        w = words_of(text)
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (*place(key, text), i) for j in range(i, i + 20)}
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(df, **how):
    cut = substring_dedup.removed(df, **how)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return sorted(map(tuple, cut.select("row.doc_id", "n_words", gone, "kept").collect()), key=repr)


def passages(rng, n_docs, n_words=90, vocabulary=5, share=0.7):
    """Texts put together from shared stretches of any length, cut anywhere, over few words."""
    pool = [[rng.choice("abcdefgh"[:vocabulary]) for _ in range(rng.choice((8, 19, 20, 21, 33, 60)))] for _ in range(6)]
    rows = []
    for k in range(n_docs):
        w = []
        while len(w) < rng.randint(0, n_words):
            w += rng.choice(pool)[rng.randint(0, 3) :] if rng.random() < share else [rng.choice("abcdefgh"[:vocabulary]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 25))]
        rows.append((k, rng.choice((" ", "  ", "\n", "\t ")).join(w)))
    return rows


def test_the_cover_meets_every_difference():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in cover and (j + d) % p in cover for d in range(p))
    assert substring_dedup.ANCHOR + p - 1 == substring_dedup.WINDOW


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1cab é ", max_size=80))
def test_words_are_cut_at_the_six_signs(text):
    words = substring_dedup.Words(text.encode())
    want = words_of(text)
    assert words.line.decode() == " ".join(want) and len(words) == len(want)
    assert [words.line[a:b].decode() for a, b in zip(words.start, words.end)] == want


@pytest.mark.parametrize("seed", range(6))
def test_windows_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = passages(rng, 60, vocabulary=(1, 2, 5, 8, 8, 8)[seed], share=(0.9, 0.5, 0.7, 0.9, 0.3, 1)[seed])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == plainly_removed(rows)


@pytest.mark.parametrize("batch", [1, 3, 7])
def test_classes_go_on_over_batches(spark, batch):
    """Groups are streamed, so any cut of the sorted rows gives the same."""
    rows = passages(random.Random(20 + batch), 40, share=0.9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set(ARROW_SETTING, batch)
    try:
        assert found(df) == plainly_removed(rows)
    finally:
        spark.conf.unset(ARROW_SETTING)


def test_hot_anchors_change_nothing(spark):
    rng = random.Random(30)
    line = "a line of exactly eight words on pages"
    rows = [(k, f"{' '.join(str(rng.randrange(50)) for _ in range(rng.randint(0, 30)))} {line} " + " ".join(str(rng.randrange(50)) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    rows += passages(rng, 30)[10:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = substring_dedup.keyed(df, "text", "doc_id")
    assert substring_dedup.hot_anchors(texts, 1, 3)
    assert found(df, sample=1, least=2) == found(df) == plainly_removed(rows)


def odd_rows():
    rng = random.Random(1)
    prose = " ".join(rng.choice(["the", "river", "of", "Stone", "and", "light$", "under", "GREEN", "hills", "Über"]) for _ in range(120))
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    return [
        (1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (1, "x y " * 40, "en", "a", 1), (2, prose, None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "b", 3),
        (None, prose + " more", "en", "a", 2), (None, None, None, None, None), (None, prose + " more", "en", "b", 2), (None, "x y " * 30, "de", "b", 2), (6, long, "en", "a", 9), (7, "x " * 9_000, "en", "a", 9),
        (8, "né à 漢字 😀 <|endoftext|> <|im_end|>", "fr", "c", 9), (9, "one two", "en", "c", 7), (substring_dedup.LAST, prose, "en", "d", 1), (10, " ".join(["w"] * 19), "de", "a", 1), (11, " ".join(["w"] * 20), "de", "a", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_rows_and_names(spark, odd, nothing):
    rows = [(k, t) for k, t, *_ in odd_rows()]
    assert found(odd) == plainly_removed(rows)
    assert found(nothing) == [] and substring_dedup.without_repeats(nothing).count() == 0
    clash = odd.withColumns({c: F.lit(7) for c in ("row", "z", "k", "c", "x", "doc", "r", "claims", "spans", "kept", "n_words", "a.b")})
    assert found(clash) == found(odd)
    cut = substring_dedup.without_repeats(clash)
    assert cut.columns == clash.columns
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr)
    kept = {(k, n): t for k, n, _, t in plainly_removed(rows)}
    assert got == sorted(((k, None if t is None else kept[k, len(words_of(t))]) for k, t in rows), key=repr)


def test_digests(spark, odd):
    got = substring_dedup.digests(substring_dedup.removed(odd)).collect()
    want = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in plainly_removed([(k, t) for k, t, *_ in odd_rows()])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# -- filter interactions -----------------------------------------------------------


def plain_audit(docs, labels):
    """The report by running all orders over all documents."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    first = {}
    for key, text, *_ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    parts = defaultdict(list)
    for key, text, lang, *_ in docs:
        t, w = text or "", words_of(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": key is not None and key > first[t],
        }
        parts[lang or ""].append((key, {f for f, x in fails.items() if x}))
    out = []
    for part, rows in parts.items():
        steps, shapley = {}, Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                steps["".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
        out += [(part, o, s, *v, shapley[o[s - 1]]) for (o, s), v in steps.items()]
    return sorted(out)


def audited(docs, labels):
    return sorted(map(tuple, filter_audit.audit(filter_audit.mask_counts(filter_audit.marked(docs, labels))).collect()))


LABELS = "doc_id long, quality int, toxic int"


def test_audit_against_all_orders(spark):
    rng = random.Random(40)
    few = [" ".join(rng.choice(("river", "Stone", "HILL", "a")) for _ in range(n)) for n in (0, 150, 260)]
    many = [" ".join(f"word{rng.randrange(10**4)}" for _ in range(n)) + tail for n in (90, 230, 400) for tail in ("", " #1", " " + "ABC " * 40)]
    docs = [(k, rng.choice(few + many), rng.choice(("en", "de", None, "")), "a", 1) for k in rng.sample(range(900), 150)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(900) if rng.random() < 0.6]
    got = audited(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got == plain_audit(docs, labels) and len(got) == 600 * 3


def test_audit_of_odd_rows(spark, odd, nothing):
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, 1), (6, 1, None), (77, 1, 1)]
    table = spark.createDataFrame(labels, LABELS)
    assert audited(odd, table) == plain_audit(odd_rows(), labels)
    assert audited(nothing, table) == [] and len(audited(odd, table.limit(0))) == 600 * 4
    clash = odd.withColumns({c: F.lit(7) for c in ("part", "key", "own", "t1", "t2", "good", "toxic", "mask", "n", "e", "quality", "first")})
    assert audited(clash, table.withColumn("good", F.lit(9)).withColumn("key", F.lit(9))) == audited(odd, table)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(1, 10**15), max_size=12))
def test_removal_polynomials(counts):
    """Corners count what any set removes; integrals are the values of the definition over all orders."""
    p = filter_audit.removal_polynomial(counts)
    for s in range(32):
        assert filter_audit.at_corner(p, s) == sum(n for m, n in counts.items() if m & s)
    for k in range(5):
        by_size = sum((Fraction(n, m.bit_count()) for m, n in counts.items() if m >> k & 1), Fraction(0))
        assert filter_audit.shapley_value(p, 1 << k) == by_size and (120 * by_size).denominator == 1


# -- divergences ---------------------------------------------------------------------


def plain_divergence(docs, top=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= 3), key=lambda t: t.encode())
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            own = [(t, f(p[s][t], whole[t])) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def diverged(df, **how):
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


def test_divergence_against_loops(spark):
    rng = random.Random(50)
    words = ["The", "the", "river", "Río", "río", "ÜBER", "über", "漢字", "a1b", "x-y", "_", "😀", "z", "I", "İ", "É", "\x00q", "[b]", "word`s"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "", None, "ö", "Z")), 1) for k in range(120)]
    docs.append((500, "###", "lonely", "a", 1))
    docs.append((501, "three words only", "pair", "a", 1))
    docs.append((502, None, "pair", "b", 1))
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    assert diverged(df) == plain_divergence(docs)
    assert diverged(df, top=2) == plain_divergence(docs, 2)
    pair = [r for r in diverged(df) if r[0] == "pair"]
    assert pair == [("pair", "a", "pair", "b", 0, 1), ("pair", "b", "pair", "a", 0, 1)]


def test_divergence_of_odd_rows(spark, odd, nothing):
    assert diverged(odd) == plain_divergence(odd_rows()) and diverged(nothing) == []
    clash = odd.withColumns({c: F.lit(7) for c in ("term", "n", "docs", "i", "j", "p", "q", "item", "value", "rank", "part", "once", "found", "all", "by_source")})
    assert diverged(clash) == diverged(odd)


def test_shares_of_very_large_counts(spark):
    row = spark.createDataFrame([(9 * 10**17, 10**18)], "n long, total long").select(divergence.share(F.col("n"), F.col("total")).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 1) // 10**18


def test_queries_have_sql():
    assert {"op11_cover_anchors", "op12_filter_shapley", "op13_source_divergence"} <= set(queries.QUERIES) & set(queries.ORACLE_SQL)


# -- staged tables -------------------------------------------------------------------


def test_stages_and_runs_live_as_long_as_they_are_held(spark):
    """Two lazy stages, two runs, and tables made from results: none loses its files; what nobody holds goes."""
    import corpus_pipeline
    from ledgerloom.llm import common

    folder = "/root/testdata/sf0.001"
    docs, stages = common.documents(spark, folder), dict(corpus_pipeline.STAGES)
    judged, single = stages["quality rules"](spark, docs, folder), stages["simhash near-dedup"](spark, docs, folder)
    derived = single.where("doc_id >= 0")
    del single
    common.sweep(spark)
    assert 0 < judged.count() < docs.count() and 0 < derived.count() <= docs.count()
    before = len(common._staged)
    one, two = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    rows = lambda df: sorted(map(str, df.select("doc_id", "start", "length").collect()))
    assert rows(one) == rows(two) == rows(one) and derived.count() > 0
    del judged, derived, one, two
    common.sweep(spark)
    assert len(common._staged) <= before


# -- program tables ------------------------------------------------------------------


def test_several_sections_in_a_packet_and_over_packets():
    from ledgerloom.llm import media_ts

    payload = media_ts.padded(random.Random(70).randbytes(3000))
    media = media_ts.mux(payload)
    body = (0xE000 | media_ts.DATA_PID).to_bytes(2) + b"\xf0\0" + bytes([media_ts.PRIVATE_DATA]) + (0xE000 | media_ts.DATA_PID).to_bytes(2) + b"\xf0\0"
    pmt, foreign = media_ts._section(2, media_ts.PROGRAM, body), media_ts._section(0x42, 7, b"other words")
    # a foreign section stands before the program map
    both = media[: media_ts.PACKET] + media_ts._table_packet(media_ts.PMT_PID, foreign + pmt) + media[2 * media_ts.PACKET :]
    s = media_ts.demux(both)
    assert s.streams == {media_ts.DATA_PID: media_ts.PRIVATE_DATA} and s.payload() == payload and s.bad_tables == 0
    # a long section ends in the next packet, where the map begins behind it
    long = media_ts._section(0x42, 7, b"x" * 250)
    first = bytes([media_ts.SYNC]) + (0x4000 | media_ts.PMT_PID).to_bytes(2) + b"\x10\0" + long[:183]
    rest = long[183:]
    second = bytes([media_ts.SYNC]) + (0x4000 | media_ts.PMT_PID).to_bytes(2) + b"\x11" + bytes([len(rest)]) + rest + pmt
    over = media[: media_ts.PACKET] + first + second + b"\xff" * (media_ts.PACKET - len(second)) + media[2 * media_ts.PACKET :]
    s = media_ts.demux(over)
    assert s.payload() == payload and (s.gaps, s.bad_tables, s.damaged) == (0, 0, 0)
    # a map that isn't in force yet names no streams
    later = bytearray(pmt[:-4])
    later[5] &= 0xFE
    coming = bytes(later) + media_ts.crc32_mpeg(bytes(later)).to_bytes(4)
    assert media_ts.demux(media[: media_ts.PACKET] + media_ts._table_packet(media_ts.PMT_PID, coming) + media[2 * media_ts.PACKET :]).streams == {}


def test_terms_are_split_not_extracted(spark, capsys):
    texts = ["".join(chr(k) + x for k in range(0x300) for x in ("aB", " ")), " 1Ab-cD\u00c9\u0130 \U00010400x9", "", " 1 ", "Z", "a\x00b"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", divergence.terms(F.col("text")).alias("t"))
    small = str.maketrans(divergence.UPPER, divergence.LOWER)
    assert {r.k: r.t for r in found.collect()} == {k: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(small)) for k, t in enumerate(texts)}
    found.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out  # extracting took most of the audit's time
