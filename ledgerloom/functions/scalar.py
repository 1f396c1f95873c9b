"""Column functions for text, dates, amounts and identifiers of financial documents.

All are native expressions.  What is parsed from text is null where it can't be read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

def literal(value) -> str:
    """SQL text of a constant: texts, numbers, flags, lists and (by name) structs; one call builds a whole table of them."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    return repr(value)


def lookup(table: dict) -> Column:
    """A constant map."""
    return F.expr("map(" + ", ".join(literal(x) for pair in table.items() for x in pair) + ")")


# -- text ----------------------------------------------------------------------


def clean(x: Column) -> Column:
    """STR-01.  White space of any kind, no-break spaces too, made single spaces; trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s ]+", " "))


def tighten(x: Column) -> Column:
    """STR-03.  No spaces around ``/`` and ``-`` between word characters."""
    return F.regexp_replace(clean(x), r"(?<=\w) *([/-]) *(?=\w)", "$1")


def join_wrapped(lines: Column) -> Column:
    """STR-04.  Wrapped lines as one, glued where a line ends in ``/``."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("/"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


#: Letters that scans confuse with digits, and those digits.
LOOKALIKES = ("OoIlSsB", "0011558")


def ocr_digits(token: Column) -> Column:
    """STR-05.  Letters that are read for digits put right, only where that makes a date or an amount."""
    fixed = F.translate(token, *LOOKALIKES)
    return F.when(fixed.rlike(r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,3}(,?\d{2,3})*\.\d{2})$"), fixed).otherwise(token)


def rejoin_dates(x: Column) -> Column:
    """STR-06.  Dates that spaces cut apart."""
    return F.regexp_replace(x, r"(\d{1,2}) ?([-/]) ?(\d{1,2}) ?\2 ?(\d{4}|\d{2})(?!\d)", "$1$2$3$2$4")


def similarity(a: Column, b: Column) -> Column:
    """STR-10.  1 less the edit distance as a share of the longer text; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


#: Words that say nothing about which company is meant.
COMPANY_WORDS = ("M", "S", "MS", "THE", "PVT", "PRIVATE", "LTD", "LIMITED", "CO", "COMPANY", "AND")


def party_name(x: Column) -> Column:
    """STR-10.  Upper case, ``&`` spelt out, punctuation and company words gone."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.upper(x), F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*COMPANY_WORDS)), " ")


def card_last4(x: Column) -> Column:
    """STR-11.  Last four digits of a card number, masked or not."""
    digits = F.regexp_replace(x, r"\D", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def mask_card(x: Column) -> Column:
    """STR-11, STR-12.  All but the last four digits of a number of 13 to 19 digits hidden, if its check digit is right."""
    digits = F.regexp_replace(x, r"[ -]", "")
    valid = digits.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", digits)
    return F.when(valid, F.concat(F.repeat(F.lit("X"), F.length(digits) - 4), F.right(digits, F.lit(4)))).otherwise(x)


def digit_shape(x: Column) -> Column:
    """STR-18.  The line with ``#`` for each digit, in lower case."""
    return F.lower(F.regexp_replace(x, r"\d", "#"))


def invoice_number(x: Column) -> Column:
    """STR-17.  Upper case, no spaces, no leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), r"\s", ""), r"^0+(?=.)", "")


def unit(x: Column) -> Column:
    """STR-16.  One spelling a unit; null for what is no unit."""
    u = F.regexp_replace(F.upper(F.trim(x)), r"\.$", "")
    return (
        F.when(u.isin("NO", "NOS", "PC", "PCS", "PIECE", "PIECES", "EACH", "EA"), "NOS").when(u.isin("KG", "KGS", "KILO", "KILOGRAM"), "KGS")
        .when(u.isin("LTR", "LTRS", "L", "LITRE", "LITRES"), "LTR").when(u.isin("BOX", "BOXES"), "BOX").when(u.isin("MTR", "MTRS", "M", "METRE", "METRES"), "MTR")
    )


def indian_grouping(x: Column) -> Column:
    """STR-19.  An amount with two decimals and Indian commas: thousands, then pairs."""
    plain = F.abs(x).cast("decimal(38,2)").cast("string")
    whole, cents = F.substring_index(plain, ".", 1), F.substring_index(plain, ".", -1)
    head = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","))).otherwise("")
    return F.concat(F.when(x < 0, "-").otherwise(""), head, F.right(whole, F.lit(3)), F.lit("."), cents)


#: Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"crore": 10_000_000, "lakh": 100_000, "thousand": 1000, "hundred": 100}


def _below_hundred(n: Column) -> Column:
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))
    high, low = F.get(tens, F.floor(n / 10).cast("int")), F.get(units, (n % 10).cast("int"))
    return F.when(n < 20, F.get(units, n.cast("int"))).when(n % 10 == 0, high).otherwise(F.concat(high, F.lit(" "), low))


def amount_words(n: Column) -> Column:
    """STR-14.  A whole number under 100 crore in Indian words."""
    parts, rest = [], n.cast("long")
    for word, size in SCALES.items():
        count = F.floor(rest / size)
        parts.append(F.when(count > 0, F.concat(_below_hundred(count), F.lit(f" {word}"))))
        rest = rest % size
    parts.append(F.when(rest > 0, _below_hundred(rest)))
    return F.when(n == 0, "zero").when((n > 0) & (n < 1_000_000_000), F.array_join(F.array_compact(F.array(*parts)), " "))


def words_amount(x: Column) -> Column:
    """STR-15.  A whole number from its words, Indian or western; null if a word is none."""
    numbers = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS) if i}
    scales = SCALES | {"million": 1_000_000, "billion": 1_000_000_000}
    table = F.create_map(*(F.lit(v) for w, i in (numbers | scales).items() for v in (w, i)))
    words = F.filter(F.split(F.lower(F.regexp_replace(x, r"[^A-Za-z]+", " ")), " "), lambda w: ~w.isin("", "and", "only", "rupees"))

    def step(a, w):
        value = F.element_at(table, w).cast("long")
        total, now = a["total"], a["now"]
        hundred, scale = w == "hundred", w.isin([s for s in scales if s != "hundred"])
        return F.struct(
            F.when(scale, total + F.greatest(now, F.lit(1)) * value).otherwise(total).cast("long").alias("total"),
            F.when(scale, F.lit(0)).when(hundred, F.greatest(now, F.lit(1)) * 100).otherwise(now + value).cast("long").alias("now"),
        )

    return F.when(F.size(words) > 0, F.aggregate(words, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now")), step, lambda a: a["total"] + a["now"]))


#: Fixed value: the characters of a tax number in the order of their values.
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def gstin_check(x: Column) -> Column:
    """STR-13.  The character that the first 14 call for: digits weighted 1 and 2 in turn, base-36 digit sums, modulo 36."""
    def weigh(s, i):
        v = (F.instr(F.lit(GSTIN_ALPHABET), F.substring(x, i, F.lit(1))) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.floor(v / 36).cast("int") + v % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), weigh)
    return F.substring(F.lit(GSTIN_ALPHABET), (36 - total % 36) % 36 + 1, F.lit(1))


def gstin_problem(x: Column) -> Column:
    """STR-13.  Why a tax number can't be right: length, state, shape, check; null if nothing is wrong."""
    g = F.regexp_replace(F.upper(x), r"[^A-Z0-9]", "")
    state = F.substring(g, 1, 2).try_cast("int")
    return (
        F.when(F.length(g) != 15, "length").when(state.isNull() | ~((state.between(1, 38)) | state.isin(97, 99)), "state")
        .when(~g.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), "shape").when(gstin_check(g) != F.substring(g, 15, 1), "check")
    )


# -- dates ---------------------------------------------------------------------


def parse_date(x: Column, pivot: int | None = 69) -> Column:
    """DAT-01, DAT-02, DAT-04.  d/m/y, y-m-d, d-Mon-y; two-digit years up to ``pivot`` are 20xx, later ones 19xx (all 20xx without a pivot).  Impossible dates are null."""
    t = F.trim(x)
    numeric, iso = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    named = r"(?i)^(\d{1,2})[- /](Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[- /,']+(\d{4}|\d{2})$"

    def number(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("int")

    def year(y: Column) -> Column:
        return F.when(y >= 100, y).when(F.lit(pivot is None) | (y <= (pivot or 99)), y + 2000).otherwise(y + 1900)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")

    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(t, named, 2))) + 2) / 3
    return (
        F.when(t.rlike(numeric), made(year(number(numeric, 3)), number(numeric, 2), number(numeric, 1)))
        .when(t.rlike(iso), made(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(t.rlike(named), made(year(number(named, 3)), month.cast("int"), number(named, 1)))
    )


def date_in_period(month: Column, day: Column, start: Column) -> Column:
    """DAT-05.  The year of a day without one: the period's first year from its first month on, else the next."""
    y = F.when(month >= F.month(start), F.year(start)).otherwise(F.year(start) + 1)
    return F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def fiscal_year(d: Column) -> Column:
    """DAT-06.  The year in which the Indian financial year of a date begins (April)."""
    return F.year(d) - (F.month(d) < 4).cast("int")


def fiscal_letter(d: Column) -> Column:
    """DAT-06.  A for April to L for March."""
    return F.char(F.lit(65) + (F.month(d) + 8) % 12)


def days_in_month(d: Column) -> Column:
    """DAT-09."""
    return F.day(F.last_day(d))


# -- numbers -------------------------------------------------------------------


def parse_amount(x: Column) -> Column:
    """NUM-01.  An amount with currency sign, commas and Cr or Dr; Dr or a minus make it negative."""
    t = F.upper(F.regexp_replace(x, r"[₹,\s]|(?i)rs\.?|inr", ""))
    n = F.nullif(F.regexp_extract(t, r"^[-(]?(\d+(?:\.\d+)?)\)?(?:CR|DR)?\.?$", 1), F.lit("")).try_cast("decimal(38,6)")
    negative = t.rlike(r"^[-(]") | t.rlike(r"DR\.?$")
    return F.when(negative, -n).otherwise(n).cast("decimal(18,2)")


def parse_ocr_money(x: Column) -> Column:
    """NUM-02.  The last ``.dd`` is the fraction, other points and commas only group."""
    whole, cents = F.regexp_extract(x, r"^-?([\d.,]*)[.,](\d{2})$", 1), F.regexp_extract(x, r"[.,](\d{2})$", 1)
    return F.concat(F.regexp_replace(whole, r"[.,]", ""), F.lit("."), cents).try_cast(MONEY)


def round_up_ties(x: Column) -> Column:
    """NUM-03.  Two decimals, ties towards positive infinity."""
    return (F.floor(x * 100 + F.lit("0.5").cast("decimal(2,1)")) / 100).cast(MONEY)


def round_half_away(x: Column) -> Column:
    """NUM-04, NUM-05.  Two decimals, ties away from zero, on decimals."""
    return F.round(x, 2).cast(MONEY)


def one_digit_apart(a: Column, b: Column) -> Column:
    """NUM-07.  Whether two numbers of equal length differ in exactly one digit."""
    x, y = F.split(a.cast("string"), ""), F.split(b.cast("string"), "")
    wrong = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))
    return (F.size(x) == F.size(y)) & (wrong == 1)


def confidence_bucket(x: Column) -> Column:
    """NUM-09.  low under 0.6, medium under 0.85, else high; scores over 1 are percent."""
    s = F.when(x > 1, x / 100).otherwise(x)
    return F.when(s < 0.6, "low").when(s < 0.85, "medium").when(s.isNotNull(), "high")
