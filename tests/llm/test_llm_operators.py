"""The training-data operators on invented rows: brute force, round trips, and every odd case."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, common, licenses, media_ts, near_copies, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, token_counts, tokens
from ledgerloom.llm.common import documents

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(queries.vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def odd_rows():
    """Nulls everywhere, empty, white space, ties, repeated rows, very long texts."""
    rng = random.Random(1)
    prose = " ".join(rng.choice(["the", "river", "of", "stone", "and", "light", "under", "green", "hills", "sang"]) for _ in range(120))
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    return [
        (1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose, None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "b", 3),
        (None, prose + " more", "en", "a", 2), (None, None, None, None, None), (6, long, "en", "a", 9), (7, "x" * 40_000, "en", "a", 9), (8, "né à 漢字 😀 <|endoftext|> <|im_end|>", "fr", "c", 9), (9, "one two", "en", "c", 7),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- tokens ----------------------------------------------------------------------


def test_tree_concatenation_is_the_whole_encoding(bpe, library):
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "é", "漢", "!!", "<|endoftext|>", " ", "\x1c", "　", "😀", "zq" * 30, "7" * 40, "'" * 9, "\t"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = bpe.encode(s, rng.choice([3, 5, 16, 64, 4096]))
        assert ids == library.encode(s, add_special_tokens=False).ids, s
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False) == s
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "0123456789", "漢字語文", "!?#", "-", " ", "\t \n", "'", "'s", "' ", "a", "é"):
        s = "".join(rng.choice(alphabet) for _ in range(6000))
        assert bpe.encode(s, 200) == library.encode(s, add_special_tokens=False).ids, alphabet
    for c in " -'=a\n":  # halves of runs next to other text, cut at every place of the run's end
        for k in range(90, 130):
            for tail in ("word", "'s", " x", "9", "!"):
                s = "x" * 3 + c * k + tail + c * 70
                assert bpe.encode(s, 50) == library.encode(s, add_special_tokens=False).ids, (c, k, tail)


def test_long_runs_take_little_work(bpe, library, monkeypatch):
    """Runs of one character: windows stay short where halves can agree, and grow to a half's end, once a level, where they can't."""
    seen, plain = [], bpe._plain
    monkeypatch.setattr(bpe, "_plain", lambda t: seen.append(len(t)) or plain(t))
    for c in " -a7'=漢":
        s = c * 200_000
        seen.clear()
        assert bpe.encode(s) == library.encode(s, add_special_tokens=False).ids
        assert sum(seen) < 12 * len(s), c


def test_leaves_of_a_long_text(bpe, library):
    s = "".join(random.Random(3).choice("abcde fgh") for _ in range((1 << 20) + 17))
    assert bpe.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_round_trip_query(spark, odd, nothing, library):
    got = sorted(tuple(r) for r in tokens.roundtrip_digests(odd, queries.vocabulary()).fillna(-1).collect())
    want = []
    for doc, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((-1 if doc is None else doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert tokens.roundtrip_digests(nothing, queries.vocabulary()).count() == 0
    assert tokens.encode_documents(odd.where("doc_id = 9"), queries.vocabulary()).first().decoded == "one two"


def test_length_histogram(spark, odd, nothing, library):
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd, queries.vocabulary())).cache()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in odd_rows()]
    for r in sums.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_ge, r.tokens_ge) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_le, r.truncated_tokens, r.tokens_all) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(lengths))
    for r in token_counts.at_limits(sums, [0, 1, 100, 1000, 10**6]).collect():
        assert (r.docs_over, r.truncated_tokens) == (sum(x > r.context for x in lengths), sum(min(x, r.context) for x in lengths))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    assert token_counts.suffix_sums(token_counts.length_histogram(nothing, queries.vocabulary())).count() == 0


def test_clashing_columns_are_not_read(spark, odd):
    clash = odd.withColumns({c: F.lit(7) for c in ("ids", "n_tokens", "keys", "texts", "vector", "quality", "w", "n", "s0", "block", "_c")})
    path = queries.vocabulary()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(tokens.roundtrip_digests(clash, path)) == rows(tokens.roundtrip_digests(odd, path))
    assert rows(token_counts.length_histogram(clash, path)) == rows(token_counts.length_histogram(odd, path))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    kept = quality_classifier.keep_good(clash, labels)
    assert kept.columns == clash.columns and kept.count() == quality_classifier.keep_good(odd, labels).count()


def test_repeated_keys_train_once(spark):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a text").alias("text")).unionByName(spark.range(40).select("id", F.concat(F.lit("word "), "id")).toDF("doc_id", "text"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    vectors, network = quality_classifier.train(docs, labels, lambda key: key >= 0)
    assert 0 < network.base < 1 and quality_classifier.score(docs, vectors, network).count() == 4040


def test_a_text_of_megabytes(spark, library):
    """One row of 2 MB of prose beside short ones, through the queries' operators."""
    rng = random.Random(20)
    long = " ".join(rng.choice(("river", "stone", "hill", "12", "light.", "--", "né")) + str(rng.randrange(999)) for _ in range(220_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    ids = library.encode(long, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in tokens.roundtrip_digests(docs, queries.vocabulary()).collect()}[1] == len(ids)
    assert sum(r.length for r in packing.pack(docs, queries.vocabulary()).collect()) == len(ids) + 1 + len(library.encode("short", add_special_tokens=False).ids) + 2
    media = {r.doc_id: r for r in media_ts.features(media_ts.store(docs)).collect()}[1]
    assert media.n_bytes == len(long.encode()) and len(media.units) == -(-media.payload_bytes // media_ts.UNIT_BYTES)
    assert {r.doc_id: r._s_fp % (1 << 64) for r in simhash.near_duplicates(docs).collect()}[1] == simhash.fingerprint(long)
    assert suffix_dedup.removed(docs).where("doc_id = 2").first()._d_spans == []


# -- media -----------------------------------------------------------------------


def test_streams_round_trip_and_faults():
    rng = random.Random(4)
    for n in [0, 1, 63, 64, *range(140, 210), 16384, 16385, 16384 * 9 + 5]:
        payload = media_ts.padded(rng.randbytes(n))
        media = media_ts.mux(payload)
        s = media_ts.demux(media)
        assert len(media) % 188 == 0 and s.payload() == payload
        assert (s.gaps, s.damaged, s.bad_tables, s.lost_sync, s.programs, s.streams) == (0, 0, 0, 0, {1: 0x100}, {0x101: 6})
        assert [u[1] for u in s.units] == [k * media_ts.TICKS for k in range(len(s.units))]
        assert [k for k, _ in s.access_points()] == list(range(0, len(s.units), media_ts.GROUP))
    media = media_ts.mux(media_ts.padded(rng.randbytes(5000)))
    cut = media_ts.demux(media[: 188 * 5] + media[188 * 6 :])
    assert cut.gaps == 1 and cut.damaged and cut.payload() == b""  # its only unit lacks a part
    twice = media_ts.demux(b"junk" + media[: 188 * 5] + media[188 * 4 :])
    assert (twice.repeated, twice.gaps) == (1, 0) and twice.lost_sync and len(twice.payload()) == 5056
    bad = bytearray(media)
    bad[20] ^= 1
    assert media_ts.demux(bytes(bad)).bad_tables == 1
    assert media_ts.demux(b"").packets == 0


def read_plainly(media):
    """The units of a stream that has no faults, read packet by packet as the format is written down: (access, PTS, data)."""
    tables, units = {}, []
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        assert packet[0] == 0x47
        pid, body = int.from_bytes(packet[1:3], "big") % 8192, packet[4:]
        access = False
        if packet[3] & 0x20:
            access, body = body[0] > 0 and bool(body[1] & 0x40), body[1 + body[0] :]
        if pid == 0x101:
            if packet[1] & 0x40:
                units.append([access, b""])
            units[-1][1] += body
        else:
            tables.setdefault(pid, body[1:])
    out = []
    for access, pes in units:
        bits = "".join(f"{b:08b}" for b in pes[9:14])
        out.append((access, int(bits[4:7] + bits[8:23] + bits[24:39], 2), pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")]))
    pat, pmt = tables[0], tables[0x100]
    assert int.from_bytes(pat[8:10], "big") == 1 and int.from_bytes(pat[10:12], "big") % 8192 == 0x100
    assert pmt[0] == 2 and int.from_bytes(pmt[13:15], "big") % 8192 == 0x101
    return out


def test_a_plain_reader_reads_the_stream():
    rng = random.Random(16)
    for n in (1, 64, 171, 184, 16384, 16384 * 10 + 77):
        payload = media_ts.padded(rng.randbytes(n))
        units = read_plainly(media_ts.mux(payload))
        assert b"".join(u[2] for u in units) == payload
        assert [(u[0], u[1]) for u in units] == [(k % media_ts.GROUP == 0, k * media_ts.TICKS) for k in range(len(units))]


def test_broken_units_are_left_out_and_whole_ones_kept():
    payload = media_ts.padded(random.Random(17).randbytes(16384 * 4))
    media = media_ts.mux(payload)
    starts = [at for at in range(188 * 2, len(media), 188) if media[at + 1] & 0x40]
    part = [payload[k : k + 16384] for k in range(0, len(payload), 16384)]
    for hurt in (
        lambda at: media[: at + 188] + media[at + 376 :],  # a packet is lost
        lambda at: media[: at + 188] + bytes([0x47, media[at + 189] | 0x80]) + media[at + 190 :],  # a packet is marked as damaged
        lambda at: media[:at] + media[at + 188 :],  # the unit's beginning is lost
    ):
        s = media_ts.demux(hurt(starts[1]))
        assert s.payload() in (b"".join([part[0], *part[2:]]), b"".join(part[2:]))  # a lost beginning also leaves its forerunner's end in doubt
        assert s.gaps + s.damaged and all(u[4] in part for u in s.units)
    end = media_ts.demux(media[: starts[3] + 188 * 3])
    assert end.payload() == b"".join(part[:3]) and end.damaged == 1


def test_stream_query(spark, odd, nothing):
    clash = odd.withColumns({c: F.lit(1) for c in ("media", "n_bytes", "units", "feature")})
    got = media_ts.features(media_ts.store(clash)).collect()
    assert len(got) == len(odd_rows())
    assert all([u.pts for u in r.units] == [k * media_ts.TICKS for k in range(len(r.units))] and r.units[0].random_access for r in got)
    by = {r.doc_id: r for r in got}
    for doc, text, *_ in odd_rows():
        if doc is not None:
            payload = media_ts.padded((text or "").encode())
            r = by[doc]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[1].media_sha256 == by[2].media_sha256
    assert media_ts.features(media_ts.store(nothing)).count() == 0


# -- packing ---------------------------------------------------------------------


def sequences_hold(pieces, lengths, window=1024):
    """Every id in one piece, no gap in a sequence, full windows but for powers of two; how many are short."""
    by_doc, by_sequence = {}, {}
    for key, start, n, sequence, offset in pieces:
        by_doc.setdefault(key, []).append((start, n))
        by_sequence.setdefault(sequence, []).append((offset, n))
    assert sorted(by_doc) == sorted(lengths)
    for key, parts in by_doc.items():
        end = 0
        for start, n in sorted(parts):
            assert start == end and n > 0
            end += n
        assert end == lengths[key]
    short = 0
    for places in by_sequence.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end == window or end & (end - 1) == 0 and end < window
        short += end < window
    return short


@pytest.mark.parametrize("most", [packing.LEVEL_MOST, 1])
def test_packer_minimises_the_squares(most):
    rng, docs = np.random.default_rng(0), {}
    packer = packing.Packer(64, most)
    for k in range(3000):
        docs[k] = int(rng.integers(1, 200)) if k % 3 else 40  # many equal lengths, whose windows nothing completes
        size = docs[k] % 64
        if size:
            def squares(level):
                c = list(packer.counts)
                c[level] -= level > 0
                c[level + size] += level + size < 64
                return sum(x * x for x in c[1:64])

            can = [x for x in range(64 - size + 1) if x == 0 or packer.counts[x]]
            best = min(map(squares, can))
            assert packer.choose(size) == max(x for x in can if squares(x) == best)
        packer.add(k, np.full(docs[k], k, "<u4"))
        assert max(packer.counts) <= most
        assert [len(w) for w in packer.stock] == packer.counts[:64] and all(sum(len(p[2]) for p in w) == level for level, ws in enumerate(packer.stock) for w in ws)
    packer.finish()
    assert sequences_hold([(k, s, len(i), q, o) for k, s, i, _, q, o in packer.out], docs, 64) <= 6 and all((i == k).all() and t == docs[k] for k, _, i, t, _, _ in packer.out)


def test_most_rests_lie_where_the_rule_put_them():
    """Four tasks, their open windows merged: what the last task has to cut is few by level, not by rows."""
    rng = np.random.default_rng(1)
    last, rests = packing.Packer(), 0
    for task in range(4):
        packer = packing.Packer()
        for k in range(10_000):
            n = int(rng.lognormal(6, 1)) + 1
            rests += n % 1024 > 0
            packer.add(k, np.zeros(n, "<u4"))
        for piece in packer.drain():
            last.place(piece)
    assert sum(len(w) for ws in last.stock for w in ws) < rests / 10


def test_pack_query(spark, odd, nothing, library):
    clash = odd.withColumns({c: F.lit(1) for c in ("task", "place", "start", "sequence_id", "ids")})
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in odd_rows()]
    for df, fan in ((clash.repartition(3), 64), (odd.repartition(5), 2)):
        rows = packing.pack(df, queries.vocabulary(), fan=fan).collect()
        assert sum(r.length for r in rows) == sum(map(len, ids)) and all(len(r.ids) == 4 * r.length for r in rows)
        mine = sorted((r.start, r.ids) for r in rows if r.doc_id == 6)
        assert np.frombuffer(b"".join(b for _, b in mine), "<u4").tolist() == ids[8]
        assert sum(r.length for r in rows if r.doc_id is None) == len(ids[6]) + 1
    assert packing.pack(nothing, queries.vocabulary()).count() == 0


def test_pack_many_repeated_rows_and_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same").otherwise(F.repeat(F.lit("word "), F.col("id").cast("int") % 700)).alias("text")).repartition(7)
    lengths = {r.doc_id: r.n_tokens + 1 for r in tokens.roundtrip_digests(docs, queries.vocabulary()).collect()}
    rows = packing.pack(docs, queries.vocabulary(), fan=2).collect()
    assert sequences_hold([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], lengths) <= 10


# -- quality ---------------------------------------------------------------------


def test_rule_counts_by_hand(spark):
    text = "a b c x a b c\n\n# *\n# *\n a"
    r = quality_rules.with_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_lines, r._q_n_dup_lines, r._q_n_repeat_words) == (12, 12, 4, 4, 1, 6)


def test_rules_on_odd_rows(spark, odd, nothing):
    clash = odd.withColumns({"kept": F.lit("mine"), "n_words": F.lit(0)})
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {1, 2, None, 6}
    judged = quality_rules.judge(odd, carry=["doc_id"])
    assert judged.count() == len(odd_rows()) and judged.where("doc_id = 3").first()._q_n_words == 0
    assert quality_rules.judge(nothing).count() == 0


def test_label_model_finds_the_accurate_rules():
    rng, counts = random.Random(6), {}
    for _ in range(5000):
        good = rng.random() < 0.8
        v = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in (0.95, 0.9, 0.9, 0.55, 0.9, 0.9))
        counts[v] = counts.get(v, 0) + 1
    share, tables = quality_rules.estimate(list(counts.items()))
    assert abs(share - 0.8) < 0.05
    assert tables[0][-1] < tables[3][-1] <= 1 <= tables[3][1] < tables[0][1]


def test_classifier_held_out(spark):
    rows = queries.op6_random_indexing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_classifier_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    vectors, network = quality_classifier.train(odd, labels, lambda key: quality_classifier.fold(key) != 1)
    scored = quality_classifier.score(odd, vectors, network).collect()
    assert len(scored) == len(odd_rows()) and len({round(r._c_score, 12) for r in scored if r.doc_id in (1, 2)}) == 1
    vectors, network = quality_classifier.train(odd, labels.limit(0), lambda key: quality_classifier.fold(key) != 1)
    assert {r._c_score for r in quality_classifier.score(odd, vectors, network).collect()} == {0.5}
    assert quality_classifier.keep_good(nothing, labels).count() == 0


# -- chat ------------------------------------------------------------------------


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "start", 10, "user", ""), (1, 1, 0, "delta", 10, None, "Hel"), (1, 2, 0, "delta", 10, None, "lo"), (1, 3, 0, "start", 11, "assistant", "bad"), (1, 4, 0, "start", 12, "user", "then"),
        (1, 5, 0, "regenerate", 11, None, "go"), (1, 6, 0, "delta", 11, None, "od <|im_end|>"), (1, 7, 0, "start", 13, "user", "x"), (1, 8, 0, "edit", 13, None, "y"), (1, 9, 0, "start", 14, "user", "gone"), (1, 10, 0, "delete", 14, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, part int, event string, message_id long, role string, text string")
    turns = chat.parse(chat.render(chat.fold(df))).first()
    assert [(t.role, t.text) for t in turns.turns] == [("user", "Hello"), ("assistant", "good <|im_end|>"), ("user", "y")]
    assert list(turns.loss_texts) == ["good <|im_end|>"]


def replayed(events):
    """Final messages of one conversation, event by event: what a reader of the log would do."""
    messages, order = {}, []
    for seq, event, message, role, text in sorted(events):
        m = messages.get(message)
        if m is None:
            m = messages[message] = {"role": role or "", "text": "", "gone": False}
            order.append(message)
        if event == "delta":
            m["text"] += text or ""
        elif event == "delete":
            m["gone"] = True
        else:
            m["text"], m["gone"] = text or "", False
            if event == "regenerate":  # what had begun after it answered what is gone
                for later in order[order.index(message) + 1 :]:
                    messages[later]["dropped"] = True
        m["role"] = m["role"] or role or ""
    return [(messages[k]["role"], messages[k]["text"]) for k in order if not messages[k]["gone"] and "dropped" not in messages[k]]


def test_random_logs_against_a_replay(spark):
    rng, logs = random.Random(19), {}
    for conv in range(60):
        events, begun = [], []
        for seq in range(rng.randint(1, 60)):
            if not begun or rng.random() < 0.2:
                begun.append(seq)
                events.append((seq, "start", seq, rng.choice(["user", "assistant"]), rng.choice(["", "a"])))
            else:
                kind = rng.choices(["delta", "edit", "regenerate", "delete"], [8, 1, 1, 1])[0]
                events.append((seq, kind, rng.choice(begun), None, None if kind == "delete" else "".join(rng.choice("xy<|\\ ") for _ in range(rng.randint(0, 5)))))
        logs[conv] = events
    rows = [(conv, seq, 0, event, message, role, text) for conv, events in logs.items() for seq, event, message, role, text in events]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, part int, event string, message_id long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(df))).collect()}
    for conv, events in logs.items():
        want = replayed(events)
        assert ([(t.role, t.text) for t in got[conv].turns] if conv in got else []) == want, conv
        assert not want or list(got[conv].loss_texts) == [x for role, x in want if role == "assistant"]


def test_format_is_reversible(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice(["<", "|", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "é", "😀", "assistant"]) for _ in range(rng.randint(0, 30)))
    rows = [(c, t, rng.choice(["user", "assistant", "a\n%0A<|", None]), text()) for c in range(8) for t in range(5)] + [(None, 0, "assistant", None), (9, 0, "assistant", "z" * 3000), (9, 0, "assistant", "z" * 3000)]
    got = chat.parse(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id for r in got} == {*range(8), 9, None}
    for r in got:
        want = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(ro, x) for _, ro, x in want]
        assert list(r.loss_texts) == [x for _, ro, x in want if ro == "assistant"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0


# -- suffix sort -----------------------------------------------------------------


def brute_repeats(texts, size=suffix_dedup.LENGTH):
    seen = {}
    for b in texts:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append((int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60) for _ in range(4)]
    texts = [make(20) + shared[k % 4][: rng.randint(150, 400)] + make(30) for k in range(60)]
    return texts + [make(100)] * 3 + ["ab " * 300, "ab " * 150 + make(10), "x" * 500, None, "", "y" * 199, "y" * 199, "z" * 200, "z" * 200, make(50) + texts[5][30:] * 2]


@pytest.mark.parametrize("run, hot", [(suffix_dedup.RUN, common.HOT_ROWS), (2, 3), (10**6, 1)])
def test_repeats_against_brute_force(spark, monkeypatch, run, hot):
    monkeypatch.setattr(suffix_dedup, "RUN", run)  # 2: anchors are sorted in many runs, which are merged
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # 1, 3: many anchors, contexts and texts are hot
    texts = planted()
    df = spark.createDataFrame([(k if k % 7 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, place long").repartition(5)
    got = {r.place: (sum(s.end - s.begin for s in r._d_spans), len(r._d_spans), hashlib.sha256(r._d_kept).hexdigest()) for r in suffix_dedup.removed(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])


def test_runs_of_one_anchor_are_merged(spark, monkeypatch):
    """One passage with a different neighbour in each of 300 texts: far more contexts at its edges than a run takes."""
    monkeypatch.setattr(suffix_dedup, "RUN", 8)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(420)
    texts = [text(rng.randint(0, 150)) + passage + text(rng.randint(0, 150)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (sum(s.end - s.begin for s in r._d_spans), len(r._d_spans), hashlib.sha256(r._d_kept).hexdigest()) for r in suffix_dedup.removed(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats([t.encode() for t in texts])


@pytest.mark.parametrize("times", [2000, 20_000])
def test_a_row_repeated_many_times(spark, times):
    """Work and results are linear in the rows; the other rows are as brute force has them."""
    rng = random.Random(13)
    row = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    others = [row[:900] + "!" + row[900:], row[300:700], " ".join(str(rng.randrange(10**6)) for _ in range(100))]
    many = spark.range(times).select(F.lit(5).cast("long").alias("doc_id"), F.lit(row).alias("text"))
    df = many.unionByName(spark.createDataFrame([(k, t) for k, t in enumerate(others)], "doc_id long, text string")).repartition(4)
    got = suffix_dedup.removed(df).groupBy("doc_id", "_d_spans").count().collect()
    assert sum(r["count"] for r in got) == times + 3 and len(got) == 4
    want = brute_repeats([row.encode()] * 2 + [t.encode() for t in others])[2:]
    assert [(sum(s.end - s.begin for s in r._d_spans), len(r._d_spans)) for r in sorted(got, key=lambda r: r.doc_id)] == [w[:2] for w in want] + [(len(row), 1)]


def test_lying_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "stretch_hash", lambda sums, down, start, length: np.zeros(len(start), np.uint64))
    rng = random.Random(9)
    a, b = rng.randbytes(300), rng.randbytes(300)
    row, begin, end = suffix_dedup.stretches(*suffix_dedup.covered([(1, 0)] * 3, [50, 50, 50], [1, 1, 1], [a, b, a[:250] + b[250:]]))
    assert sorted(zip(row.tolist(), begin.tolist(), end.tolist())) == [(0, 0, 250), (2, 0, 250)]


def test_lying_digests_within_a_text_are_found_out(monkeypatch):
    data = random.Random(14).randbytes(700)
    monkeypatch.setattr(suffix_dedup, "digest", lambda data, n=[0]: n.__setitem__(0, n[0] + 1) or (bytes(16) if len(data) > 16 else n[0].to_bytes(16)))
    a, *_, n = suffix_dedup._text_items(data)
    assert None not in a and set(n.tolist()) == {1}


def test_repeats_odd_rows(spark, odd, nothing):
    clash = odd.withColumns({c: F.lit(1) for c in ("dk", "rk", "spans", "begin")})
    assert suffix_dedup.without_repeats(clash).columns == clash.columns and suffix_dedup.without_repeats(clash).where("dk = 1").count() == len(odd_rows())
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.dtypes == odd.dtypes
    got = {r.doc_id: r for r in cut.where("doc_id IS NOT NULL").collect()}
    assert got[1].text == "" and got[2].text == "" and got[3].text is None and got[9].text == "one two" and got[7].text == "" and got[6].n_chars == len(odd_rows()[8][1])
    assert cut.count() == len(odd_rows()) and suffix_dedup.without_repeats(nothing).count() == 0


# -- licenses --------------------------------------------------------------------


def test_license_windows(spark, odd, nothing):
    filler = " ".join(f"w{k}" for k in range(200))
    rows = [(k, f"{filler[: 40 * k]} {t.upper()} {filler}") for k, t in enumerate(licenses.TEMPLATES.values())] + [(99, filler), (100, None), (101, "mit license"), (102, list(licenses.TEMPLATES.values())[0])]
    got = {r.doc_id: [m.license for m in r._l_matches] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert name in got[k]
    assert got[99] == got[100] == got[101] == [] and got[102] == ["apache-2.0"]
    half = " ".join(licenses.TEMPLATES["mit-permission"].split()[:30])
    assert licenses.scan(spark.createDataFrame([(1, half)], "doc_id long, text string")).first()._l_matches == []
    clash = odd.withColumns({c: F.lit(1) for c in ("a", "x", "i", "s", "v", "bits", "templates", "sig", "name")})
    found = licenses.scan(clash)
    assert found.count() == len(odd_rows()) and found.columns[:-2] == clash.columns and licenses.scan(nothing).count() == 0


def test_license_windows_sort_plainly_and_hash_words(spark, capsys):
    text = "Licensed under CC BY 4.0 \u00c9t\u00e9 und so weiter und so weiter"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scan(docs).explain()
    assert "array_sort(" not in capsys.readouterr().out  # it compares by an expression, pair by pair
    words = licenses.normal_words(text)
    row = spark.createDataFrame([(words,)], "w array<string>").select(F.xxhash64(*(F.col("w")[k] for k in range(licenses.SHINGLE)))).first()
    assert licenses.bands_of(licenses.shingles_of(words)[:1]) == [row[0]]


def brute_licenses(text, known):
    held = set(licenses.shingles_of(licenses.normal_words(text or "")))
    return sorted(name for name, s in known.items() if sum(g in held for g in s) >= licenses.CONTAINED * len(s))


def damaged(rng, text, share):
    """Single words changed so that about this share of the shingles is lost."""
    words = text.split()
    for _ in range(max(0, round(share * len(words) / licenses.SHINGLE))):
        words[rng.randrange(len(words))] = f"q{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("most", [licenses.MOST_BANDS, 150])
def test_recall_of_damaged_templates(spark, monkeypatch, most):
    """Whole license texts, one of 3,000 words, and short notices, damaged up to what containment allows."""
    monkeypatch.setattr(licenses, "MOST_BANDS", most)  # 150: the list is scanned in several parts
    rng = random.Random(18)
    templates = licenses.TEMPLATES | {"long": " ".join(f"clause{rng.randrange(2000)}" for _ in range(3000))}
    known = licenses.template_shingles(templates)
    filler = lambda: " ".join(f"w{rng.randrange(10**4)}" for _ in range(rng.randint(0, 150)))
    texts = [f"{filler()} {damaged(rng, t, share)} {filler()}" for t in templates.values() for share in (0, 0.05, 0.1, 0.15, 0.2) for _ in range(4)]
    got = {r.doc_id: [m.license for m in r._l_matches] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    want = [brute_licenses(t, known) for t in texts]
    assert all(set(got[k]) <= set(w) and got[k] == sorted(got[k]) for k, w in enumerate(want))
    hit, all_ = sum(len(set(got[k]) & set(w)) for k, w in enumerate(want)), sum(map(len, want))
    assert all_ > 200 and hit >= 0.99 * all_
    assert sum("long" in got[k] for k in got) == sum("long" in w for w in want) > 5


# -- simhash ---------------------------------------------------------------------


def brute_components(values, budget=simhash.BUDGET):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if (int(values[i]) ^ int(values[j])).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_trie_join_against_brute_force():
    rng = random.Random(10)
    for _ in range(5):
        values = set()
        for _ in range(40):
            base = rng.getrandbits(64)
            for _ in range(8):
                v = base
                for _ in range(rng.randint(0, 5)):
                    v ^= 1 << rng.randrange(64)
                values.add(v)
        line = np.array(sorted(values), np.uint64)
        assert simhash.trie_join(line).tolist() == brute_components(line)


def test_fingerprint_by_hand(spark):
    import xxhash

    text = "The  quick\tBROWN fox É the quick brown"
    words = "the quick brown fox É the quick brown".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("one TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_components_against_brute_force(spark, odd, nothing):
    docs = documents(spark, SF)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    want = {r.doc_id: (p, rows[k].doc_id) for r, p, k in zip(rows, prints, brute_components(prints))}
    assert {r.doc_id: (r._s_fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows()) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    # a null key is the last choice: the null-keyed copy of row 1 and the empty null-keyed row go
    left = simhash.keep_one(odd).collect()
    rows = odd_rows()
    roots = brute_components([simhash.fingerprint(t) for _, t, *_ in rows])
    want = [min(rows[k][0] if rows[k][0] is not None else 10**9 for k in range(len(rows)) if roots[k] == r) for r in set(roots)]
    assert sorted(r.doc_id if r.doc_id is not None else 10**9 for r in left) == sorted(want)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    clash = odd.withColumns({c: F.lit(1) for c in ("fp", "root", "least", "a", "b", "k", "head")})
    assert simhash.keep_one(clash).columns == clash.columns and simhash.near_duplicates(clash).count() == len(rows)


@pytest.mark.parametrize("budget, large", [(3, simhash.LARGE), (3, 4), (6, 3)])
def test_links_against_brute_force(spark, budget, large):
    """Small values of ``large`` deal most blocks out again."""
    rng, values = random.Random(15), set()
    for _ in range(30):
        base = rng.getrandbits(64) if rng.random() < 0.5 else rng.getrandbits(40)
        for _ in range(10):
            v = base
            for _ in range(rng.randint(0, 8)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in simhash.near_links(df, budget, large).collect():
        a, b = sorted((find(r.a % (1 << 64)), find(r.b % (1 << 64))))
        label[b] = a
    want = brute_components(values, budget)
    assert [find(v) for v in values] == [values[w] for w in want]


def test_one_fingerprint_of_most_rows(spark):
    """A third of the rows are empty, a third are one text: both keys are hot."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "the very same text").otherwise(F.concat(F.lit("only one "), F.col("id"))).alias("text"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 6000 and all(got[k] == k % 3 for k in got if k % 3 < 2)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


# -- near copies -----------------------------------------------------------------


def brute_kept(rows):
    """Least key of each group that 5-word Jaccard similarity of 0.8 or more connects."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted({min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)})


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 10])
def test_near_copy_stage_against_brute_jaccard(spark, odd, nothing, monkeypatch, chunk):
    monkeypatch.setattr(common, "HOT_ROWS", chunk)
    monkeypatch.setattr(near_copies, "CHUNK", chunk)  # 10: groups under a shingle lie in chunks
    rng, rows = random.Random(11), []
    words = [f"w{k}" for k in range(300)]
    for group in range(6):  # group 0 is larger than one round proposes in full
        base = [rng.choice(words) for _ in range(rng.randint(60, 150))]
        for _ in range(40 if group == 0 else 6):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    passage = [rng.choice(words) for _ in range(60)]  # in documents that are no copies
    rows += [(len(rows) + k, " ".join(passage + [rng.choice(words) for _ in range(20)])) for k in range(30)]
    rows += [(900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) != want  # 3-word shingles and 3 bits are another thing
    docs = documents(spark, SF)
    got = stage(spark, docs, SF)
    assert got.dtypes == docs.dtypes and sorted(r.doc_id for r in got.collect()) == brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    clash = odd.withColumns({c: F.lit(1) for c in ("id", "shingle", "a", "b", "root", "node", "size", "first")})
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near_copies.keep_one(clash).collect()) == [1, 3, 6, 7, 8, 9]
    assert near_copies.keep_one(nothing).count() == 0


def test_parities_leave_similar_sets_open_and_few_others():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 511, 513, 1024, 5000):
        for share in (0.0, 0.5, 0.7, 0.8, 0.9, 1.0):
            pool = np.unique(rng.integers(0, 1 << 64, 4 * n + 8, np.uint64))
            both = round(2 * n * share / (1 + share))
            a, b = (np.sort(np.concatenate([pool[:both], pool[at : at + n - both]])) for at in (both, n))
            x, y = near_copies.parities(a), near_copies.parities(b)
            open_ = near_copies.can_be_similar(x, y, len(a), len(b))
            assert open_ or not near_copies.similar(a.tobytes(), b.tobytes())
            assert not open_ or share > 0.7 or n < 300, (n, share)  # 512 bits alone leave any two sets of 5,000 open
            few = np.bincount((a % np.uint64(near_copies.PARITY)).astype(np.int64), minlength=near_copies.PARITY).astype(np.uint8) & 1
            assert near_copies.folded(x).tobytes() == np.packbits(few).tobytes()


def test_near_copy_stage_fetches_no_sets_that_parities_rule_out(spark, monkeypatch):
    rng = random.Random(5)
    long = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, copy = long(1500), long(3000)
    rows = [(k, " ".join(shared + long(1500))) for k in range(6)] + [(6, " ".join(copy)), (7, " ".join(copy[:-20] + long(20)))]
    none = np.zeros(0, np.uint64)
    monkeypatch.setattr(near_copies, "common_shingles", lambda texts: (none, none.astype(np.int64)))  # any order will do; in this one halves propose pairs
    counts, staged = {}, near_copies.staged

    def counted(df, name):
        out = staged(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "staged", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 5, 6] == brute_kept(rows)
    assert counts["pairs"][0] > 10 and sum(counts["sets"]) == 2


def test_new_words_of_many_texts_are_made_at_once():
    asked = []

    def made(ids, new):
        asked.append(list(new))
        return (quality_classifier.index_vectors(ids),)

    words = quality_classifier.Words(made)
    texts = ["Ab ab 12 x_y", None, "ab \u00e9t\u00e9 \u0663\u0664 !", "12 zz"]
    rows = words.rows(texts)
    want = [quality_classifier._token.findall(t or "") for t in texts]
    assert asked[1:] == [list(dict.fromkeys(w for x in want for w in x))]  # the first call only asks for types
    names = {k: w for w, k in words.row.items()}
    assert [[names[k] for k in r] for r in rows] == want and all(words.ids[k] == quality_classifier.word_id(w) for k, w in names.items())
    every = "".join(chr(k) + x for k in range(128) for x in "a1 _.")
    assert quality_classifier.tokens_of(every) == quality_classifier._token.findall(every)


def test_words_are_cut_and_counted_in_bulk(spark, monkeypatch):
    texts = ["skipped", "Ab ab 12 x_y", None, "", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), " \u00c9t\u00e9\u0663\u06644\u20ac\u20ac ", "AB ab \U0001f600\U0001f600 ab 12", "the end", "\u00d1 the"]
    want = [quality_classifier._token.findall(t or "") for t in texts]

    def one_by_one(text):
        raise AssertionError("a text is cut on its own")

    monkeypatch.setattr(quality_classifier, "tokens_of", one_by_one)
    for kind in (pa.string(), pa.large_string()):
        words, which, edges = quality_classifier.split(pa.array(texts, kind).slice(1))  # a slice keeps what lies before it
        assert [[words[k] for k in which[a:b]] for a, b in zip(edges, edges[1:])] == want[1:] and len(set(words)) == len(words)
    assert [len(x) for x in quality_classifier.split(pa.array([], pa.string()))] == [0, 0, 1] and quality_classifier.split(pa.array([None, " "]))[2].tolist() == [0, 0, 0]
    # counts and context sums against one word at a time
    docs, reach = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), quality_classifier.REACH
    ids = [[quality_classifier.word_id(w) for w in x] for x in want]
    counts = collections.Counter(w for x in ids for w in x)
    assert {r.w: r.n for r in quality_classifier.word_counts(docs).collect()} == counts
    index = dict(zip(counts, quality_classifier.index_vectors(np.array(list(counts))).astype(np.int64)))
    sums = {w: np.zeros(quality_classifier.DIM, np.int64) for w in [None, *counts]}
    for x in ids:
        for at, w in enumerate(x):
            near = sum((index[y] for y in x[max(0, at - reach) : at] + x[at + 1 : at + 1 + reach]), np.zeros_like(sums[None]))
            sums[w] += near
            sums[None] += near
    for frequent in (np.array(sorted(w for w, n in counts.items() if n > 1), np.int64), np.zeros(0, np.int64)):
        found = {r.w: (r.n, list(r[2:])) for r in quality_classifier.context_sums(docs, frequent).collect()}
        assert found == {w: (counts[w] if w is not None else counts.total(), sums[w].tolist()) for w in [None, *frequent.tolist()]}
    # features against one text at a time
    vectors = quality_classifier.Vectors(np.array(sorted(counts))[::2], np.ones((len(counts) + 1 >> 1, quality_classifier.DIM), np.float16))
    for row, x, own in zip(quality_classifier.pooled(pa.array(texts), vectors), want, ids):
        v = vectors.of(np.array(own, np.int64)).astype(np.float64)
        plain = np.concatenate([v.mean(axis=0), v.std(axis=0), [np.log1p(len(x)), len(set(x)) / len(x)], quality_classifier.shapes(x).mean(axis=0)]) if x else np.zeros(quality_classifier.FEATURES)
        assert np.allclose(row, plain, atol=1e-5)


# -- pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark, nothing):
    docs = documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "simhash near-dedup", "suffix-array dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    judged = stage["quality rules"](spark, docs, SF)
    want = {r.doc_id for r in quality_rules.judge(docs).where("_q_kept").collect()}
    assert {r.doc_id for r in judged.collect()} == want and judged.dtypes == docs.dtypes
    cut = {r.doc_id: r.text for r in stage["suffix-array dedup"](spark, docs, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    for (gone, _, digest), r in zip(brute_repeats([(r.text or "").encode() for r in rows]), rows):
        assert gone or cut[r.doc_id] == r.text
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, nothing, SF).count() == 0, name
    assert corpus_pipeline.run(spark, SF).count() > 0
