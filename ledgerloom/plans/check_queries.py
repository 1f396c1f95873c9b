"""Verdict, classification, source and solver queries; the sequential ones have no SQL text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import ledger as L
from ledgerloom.operators import lines as T
from ledgerloom.operators import passbooks as PB
from ledgerloom.operators import reconcile as C
from ledgerloom.operators import solvers as V
from ledgerloom.plans.document_queries import LINES
from ledgerloom.plans.ledger_queries import KEY, M, ORDERED
from ledgerloom.plans.views import view
from ledgerloom.sources import readers as R

BRANDS = ["the", "and", "die", "que", "une"]
WORDS = [("two_words", ["the", "und"]), ("english", ["the"]), ("german", ["(und|der)"]), ("french", ["(une|les)", "des"])]
LAYOUTS = [(n, [C.WORD_START + w + C.WORD_END for w in ws]) for n, ws in WORDS]


def documents(f):
    return lambda spark, d: f(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def printed_pages(ledger):
    return L.page_totals(ledger).select("doc_id", "page", (F.col("debits") + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("printed"))


def printed(ledger):
    t = L.closing_balance(ledger).where("doc_id % 5 <> 0")
    return t.select("doc_id", F.col("debits").alias("printed_debits"), (F.col("credits") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("printed_credits"), F.when(F.col("doc_id") % 2 == 0, F.col("closing")).alias("printed_closing"))


def whole_replies(docs):
    """Replies with boxes for all words of all lines of every document with an even key."""
    word = lambda w: F.struct(w.alias("WordText"), F.lit(1.0).alias("Left"), F.lit(2.0).alias("Top"), F.lit(3.0).alias("Height"), F.lit(4.0).alias("Width"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.struct(x.alias("LineText"), F.transform(F.split(x, " "), word).alias("Words")))
    boxed = F.struct(F.col("text").alias("ParsedText"), F.struct(lines.alias("Lines")).alias("TextOverlay"))
    plain = F.struct(F.col("text").alias("ParsedText"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(boxed)).otherwise(F.to_json(plain)).alias("reply"))


def page_chars(spark, d):
    lines = T.lines_of(spark.read.parquet(f"{d}/documents.parquet"))
    pages = lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    return R.page_preflight(pages.select("doc_id", "page", "chars", (F.col("page") % 5 == 4).alias("has_image")))


def amounts(ledger):
    w = ledger.where("withdrawal IS NOT NULL OR deposit IS NOT NULL")
    return w.select("doc_id", "seq", F.coalesce("withdrawal", "deposit").alias("amount"), "balance")


def with_opening(ledger):
    o = L.closing_balance(ledger).select("doc_id", F.coalesce("opening", F.lit(0)).cast("decimal(18,2)").alias("opening"))
    return amounts(ledger).join(o, "doc_id")


def order_rows(ledger):
    return ledger.select("doc_id", ((F.col("seq") * 7919) % 1009).alias("seq"), (F.col("balance") + F.coalesce("withdrawal", F.lit(0)) - F.coalesce("deposit", F.lit(0))).alias("before"), F.col("balance").alias("after")).where("after IS NOT NULL")


def notes_of_previous(docs):
    """Each document's whole text against the whole text of the document with the key before."""
    return C.word_overlap(docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("note")), "doc_id", "left"))


def notes_of_next(docs):
    """Each document's whole text against the whole text of the document with the next key."""
    return C.word_overlap(docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("note")), "doc_id", "left"))


PLUS = f"try_cast(o_ AS {M}) AS opening"

PAIRS = {
    "chk_05_verdict": (
        lambda s, d: C.verdict(view(s, d, "ledger")),
        f"""WITH {ORDERED},
m AS (SELECT *, (balance - prev)::{M} AS move, abs(balance - prev)::{M} AS size, balance - prev IS NULL OR ((withdrawal IS NOT NULL OR deposit IS NOT NULL) AND abs(greatest(w0, d0) - abs(balance - prev)) > 1.00
    AND (txn_date IS NULL OR prev_date IS NULL OR date_trunc('month', txn_date) <> date_trunc('month', prev_date))) AS keep, coalesce(abs(expected - balance) > 0.05, FALSE) AS broken, min(seq) OVER (PARTITION BY doc_id, {KEY}) AS first_ FROM c),
f AS (SELECT *, CASE WHEN keep THEN w0 WHEN size <= 0.01 THEN 0 WHEN move < 0 THEN size ELSE 0 END AS nw, CASE WHEN keep THEN d0 WHEN size <= 0.01 THEN 0 WHEN move > 0 THEN size ELSE 0 END AS nd FROM m),
s AS (SELECT doc_id, count(*) FILTER (broken) AS breaks, sum(w0)::{M} AS debits, sum(d0)::{M} AS credits, arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS o_, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing,
  count(*) FILTER (w0 <> nw OR d0 <> nd) AS corrections, count(*) FILTER (seq <> first_) AS duplicates, count(*) FILTER ((w0 <> 0 AND d0 <> 0) OR (NOT is_reversal AND (w0 < 0 OR d0 < 0))) AS sides,
  count(*) FILTER (100 - CASE WHEN txn_date IS NULL THEN 40 ELSE 0 END - CASE WHEN withdrawal IS NULL AND deposit IS NULL THEN 40 ELSE 0 END - CASE WHEN broken THEN 30 ELSE 0 END - CASE WHEN ocr_corrected THEN 15 ELSE 0 END < 80) AS weak FROM f GROUP BY doc_id),
t AS (SELECT *, {PLUS} FROM s), u AS (SELECT *, opening + credits - debits - closing AS difference FROM t),
r AS (SELECT doc_id, concat_ws(';', CASE WHEN breaks > 0 THEN 'chain=' || breaks END, CASE WHEN difference IS NOT NULL AND (abs(difference) > 0.05 OR breaks > 0) THEN 'closing' END, CASE WHEN corrections > 0 THEN 'corrected=' || corrections END,
  CASE WHEN duplicates > 0 THEN 'duplicates=' || duplicates END, CASE WHEN sides > 0 THEN 'sides=' || sides END, CASE WHEN weak > 0 THEN 'weak=' || weak END) AS reasons FROM u)
SELECT doc_id, reasons, CASE WHEN reasons = '' THEN 'ok' ELSE 'needs_review' END AS review FROM r""",
    ),
    "chk_06_against_printed": (
        lambda s, d: C.against_printed(view(s, d, "ledger"), printed(view(s, d, "ledger"))),
        f"""WITH {ORDERED}, s AS (SELECT doc_id, sum(w0)::{M} AS debits, sum(d0)::{M} AS c, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing FROM o GROUP BY 1)
SELECT doc_id, debits, (c + CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END)::{M} AS credits, closing, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 AND closing IS NOT NULL THEN 'printed' ELSE 'derived' END AS verified_against,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'credits' ELSE '' END AS differs FROM s""",
    ),
    "chk_14_failing_pages": (
        lambda s, d: C.failing_pages(view(s, d, "ledger"), printed_pages(view(s, d, "ledger"))),
        f"""WITH {ORDERED}, l AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS other FROM c), b AS (SELECT * FROM l WHERE abs(expected - balance) > 0.05)
SELECT DISTINCT doc_id, page, 'sum' AS why FROM ledger WHERE doc_id % 17 = 0 UNION SELECT doc_id, page, 'chain' FROM b UNION SELECT doc_id, other, 'chain' FROM b""",
    ),
    "flt_15_classify": (
        documents(C.classify),
        "WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'minimum') AND contains(t, 'due') AND " + " + ".join(f"contains(t, '{s}')::INT" for s in C.CARD_SIGNS) + " >= 2 THEN 'card' WHEN " + " + ".join(f"contains(t, '{s}')::INT" for s in C.BANK_SIGNS) + " >= 2 THEN 'bank' ELSE 'unknown' END AS kind FROM t",
    ),
    "flt_16_most_mentioned": (
        documents(lambda x: C.most_mentioned(x, BRANDS)),
        "WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{Nd}_]', ' ', 'g') AS t FROM documents), c AS (SELECT doc_id, " + ", ".join(f"len(list_filter(string_split(t, ' '), lambda x: x = '{b}')) AS n{k}" for k, b in enumerate(BRANDS)) + " FROM t), g AS (SELECT *, greatest(" + ", ".join(f"n{k}" for k in range(len(BRANDS))) + ") AS m FROM c) SELECT doc_id, CASE WHEN m = 0 THEN NULL " + " ".join(f"WHEN n{k} = m THEN '{b}'" for k, b in enumerate(BRANDS)) + " END AS brand FROM g",
    ),
    "flt_14_layout": (
        documents(lambda x: C.detect_layout(x, LAYOUTS)),
        "SELECT doc_id, CASE " + " ".join("WHEN " + " AND ".join(rf"regexp_matches(coalesce(text, ''), '(^|[^\p{{L}}\p{{Nd}}_]){w}($|[^\p{{L}}\p{{Nd}}_])')" for w in ws) + f" THEN '{n}'" for n, ws in WORDS) + " ELSE 'generic' END AS layout FROM documents",
    ),
    "flt_21_word_overlap": (
        documents(notes_of_previous),
        r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, coalesce(len(b.w), 0)::INT AS n_words, coalesce(len(b.w) > 0 AND len(list_intersect(b.w, a.w)) >= 0.6 * len(b.w), FALSE) AS repeats FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id - 1""",
    ),
    "flt_21_word_overlap_whole": (
        documents(notes_of_next),
        r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, coalesce(len(b.w), 0)::INT AS n_words, coalesce(len(b.w) > 0 AND len(list_intersect(b.w, a.w)) >= 0.6 * len(b.w), FALSE) AS repeats FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id + 1""",
    ),
    "src_05_json_lines": (
        documents(lambda x: R.lines_from_json(whole_replies(x)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("chars"))),
        r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_split_to_array(coalesce(text, ''), '\r?\n') ELSE list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') END AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars FROM p WHERE len(l) > 0""",
    ),
    "src_05_json_lines_whole": (
        documents(lambda x: R.lines_from_json(whole_replies(x)).select("doc_id", "line_no", F.md5("text").alias("h"))),
        r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_split_to_array(coalesce(text, ''), '\r?\n') ELSE list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') END AS l FROM documents)
SELECT doc_id, (i - 1)::INT AS line_no, md5(l[i]) AS h FROM p, unnest(range(1, len(l) + 1)) AS u(i)""",
    ),
    "src_03_preflight": (
        page_chars,
        f"""WITH {LINES}, p AS (SELECT doc_id, page, sum(length(text)) AS chars FROM lines GROUP BY 1, 2), s AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (chars = 0 AND page % 5 <> 4) AS empty, count(*) FILTER (chars > 200) AS texty FROM p GROUP BY 1)
SELECT doc_id, pages, empty, empty >= 0.75 * pages AS is_empty, texty * 2 < pages AS sparse, CASE WHEN texty * 2 >= pages THEN 'text' WHEN pages > 30 THEN 'local' WHEN pages > 3 THEN 'split' ELSE 'remote' END AS route FROM s""",
    ),
    "src_11_sniff": (
        documents(lambda x: x.select("doc_id", R.sniff(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit(b"%PDF-1.7 ")).when(F.col("doc_id") % 4 == 1, F.lit(b"\xff\xd8\xff\xe0")).when(F.col("doc_id") % 4 == 2, F.lit(b"PK\x03\x04")).otherwise(F.lit(b"??")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("kind"))),
        "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'zip' END AS kind FROM documents",
    ),
    "str_11_mask_cards": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("4111 1111 "), F.lpad((F.col("o_orderkey") * 7919 % 10000).cast("string"), 4, "0"), F.lit(" "), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("n")).select("o_orderkey", S.mask_card(F.col("n")).alias("masked"), S.card_last4(F.col("n")).alias("last4")),
        """WITH n AS (SELECT o_orderkey, '4111 1111 ' || lpad((o_orderkey * 7919 % 10000)::VARCHAR, 4, '0') || ' ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS n FROM orders), d AS (SELECT *, replace(n, ' ', '') AS d FROM n),
c AS (SELECT *, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, i::INT, 1)::INT ELSE (substr(d, i::INT, 1)::INT * 2) // 10 + (substr(d, i::INT, 1)::INT * 2) % 10 END)) AS s FROM d)
SELECT o_orderkey, CASE WHEN s % 10 = 0 THEN repeat('X', 12) || right(d, 4) ELSE n END AS masked, right(d, 4) AS last4 FROM c""",
    ),
    "num_03_rounding": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") % 2001 - 1000) / F.lit(200)).cast("decimal(18,3)").alias("x")).select("o_orderkey", S.round_up_ties(F.col("x")).alias("up"), S.round_half_away(F.col("x")).alias("away")),
        f"""WITH x AS (SELECT o_orderkey, ((o_orderkey % 2001 - 1000) * 5)::BIGINT AS m FROM orders)
SELECT o_orderkey, (floor((m + 5) / 10) / 100)::{M} AS up, (sign(m) * floor((abs(m) + 5) / 10) / 100)::{M} AS away FROM x""",
    ),
    "row_08_split_merged": (
        documents(lambda x: T.split_merged(T.lines_of(x), " The ").groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("text")).cast("long").alias("chars"))),
        f"""WITH {LINES}, p AS (SELECT doc_id, string_split(replace(text, ' The ', chr(1) || ' The '), chr(1)) AS p FROM lines), q AS (SELECT doc_id, unnest(p) AS t FROM p) SELECT doc_id, count(*) AS n_parts, sum(length(t))::BIGINT AS chars FROM q WHERE t <> '' GROUP BY 1""",
    ),
    "num_08_variants": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.array_join(V.variants_of(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), "|").alias("variants")), None),
    "str_09_scan_distance": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", V.scan_distances(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.concat(F.lit("0"), F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "413", "178"))).alias("distance")), None),
    "sol_03_sign_runs": (lambda s, d: V.sign_runs(amounts(view(s, d, "ledger"))), None),
    "sol_01_solve_chains": (lambda s, d: V.solve_chains(with_opening(view(s, d, "ledger"))), None),
    "win_22_chain_order": (lambda s, d: V.order_chains(order_rows(view(s, d, "ledger"))), None),
    "row_01_lines_exact": (lambda s, d: V.lines_exact(view(s, d, "tokens")), None),
    "join_13_align": (lambda s, d: V.align_frame(view(s, d, "tokens").select("doc_id", (F.col("token_id") % 2).cast("int").alias("side"), F.col("token_id").alias("place"), "y")), None),
}


def page_numbers(l):
    """Passbook pages of the ledger: what is brought and carried forward, and each row's date, word, amount (debits left of credits) and balance, some of them misread or missing."""
    total = (F.col("balance") + 5_000_000).cast("decimal(18,2)")
    row = Window.partitionBy("doc_id", "page").orderBy("seq")
    first, last = F.row_number().over(row) == 1, F.lead("seq").over(row).isNull()
    rows = l.where("txn_date IS NOT NULL").withColumns({"_first": first, "_last": last})
    y = (F.col("seq") * 100).cast("double")
    at = lambda x, dy, text: F.struct(F.lit(float(x)).alias("x"), (y + dy).alias("y"), text.alias("text"))
    amount = F.coalesce("withdrawal", "deposit").cast("string")
    garbled = F.when(F.col("seq") % 29 == 7, F.concat(F.substring_index(amount, ".", 1), F.lit(".06"))).otherwise(amount)
    printed = F.when(F.col("seq") % 23 == 5, F.substring_index(total.cast("string"), ".", 1)).when(F.col("seq") % 31 != 9, total.cast("string"))
    before = (total + F.coalesce("withdrawal", F.lit(0)) - F.coalesce("deposit", F.lit(0))).cast("decimal(18,2)").cast("string")
    cells = F.array(
        F.when(F.col("_first"), at(150, -50.0, F.lit("Brought Forward"))), F.when(F.col("_first") & F.col("balance").isNotNull(), at(650, -50.0, before)), at(50, 0.0, F.date_format("txn_date", "dd/MM/yyyy")), at(150, 0.0, F.col("particulars")),
        F.when(F.col("withdrawal").isNotNull(), at(400, 0.0, garbled)).otherwise(at(520, 0.0, garbled)), F.when(printed.isNotNull(), at(650, 0.0, printed)), F.when(F.col("_last"), at(150, 50.0, F.lit("Carried Forward"))), F.when(F.col("_last") & F.col("balance").isNotNull(), at(650, 50.0, total.cast("string"))),
    )
    return rows.select("doc_id", "page", F.inline(F.array_compact(cells))).select("doc_id", "page", "x", "y", "text")


PAIRS["sol_01_page_tokens"] = (lambda s, d: PB.solve_passbook_pages(page_numbers(view(s, d, "ledger"))), None)
