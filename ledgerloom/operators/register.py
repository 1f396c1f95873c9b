"""Operators on daily meter registers: ``product``, ``day``, ``net``, ``cumulative``, ``sales_by_meter``, ``pump_test``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("product").orderBy("day")


def first_mismatch(register: DataFrame) -> DataFrame:
    """WIN-10.  The first day on which the running total isn't the printed cumulative; null if none."""
    rows = register.withColumn("running", F.sum("net").over(_order()))
    return rows.groupBy("product").agg(F.min(F.when(F.col("cumulative") != F.col("running"), F.col("day"))).alias("first_bad_day"), F.sum("net").cast("long").alias("total"))


def with_previous(register: DataFrame) -> DataFrame:
    """WIN-11.  ``previous``: the last cumulative before the day, 0 if there is none."""
    return register.withColumn("previous", F.coalesce(F.last("cumulative", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def suggestions(register: DataFrame) -> DataFrame:
    """WIN-12, NUM-07.  The net that the cumulative calls for, where it isn't the one written: plausible if one digit apart."""
    from ledgerloom.functions.scalar import one_digit_apart

    rows = with_previous(register).withColumn("suggested", F.col("cumulative") - F.col("previous"))
    return rows.where("suggested >= 0 AND suggested <> net").select("product", "day", "net", "suggested", one_digit_apart(F.col("net"), F.col("suggested")).alias("plausible"))


def serials(registers: DataFrame, letter: str = "A") -> DataFrame:
    """WIN-13.  Numbers A1, A2, … by day and product within each register (``register_id``: one station's month)."""
    n = F.row_number().over(Window.partitionBy("register_id").orderBy("day", "product"))
    return registers.select("register_id", "product", "day", F.concat(F.lit(letter), n.cast("string")).alias("serial"))


def missing_days(register: DataFrame, days) -> DataFrame:
    """SET-03.  Days of the month, which has ``days`` (a number or a column), that a product has no row for."""
    wanted = register.select("product").distinct().select("product", F.explode(F.sequence(F.lit(1), days if isinstance(days, Column) else F.lit(days))).alias("day"))
    return wanted.join(register.select("product", "day"), ["product", "day"], "left_anti")


def meter_flags(register: DataFrame) -> DataFrame:
    """CHK-13.  Flags of each row: meter (sales less pump test isn't net), blank cumulative, with an id."""
    kinds = F.array_compact(F.array(F.when(F.col("sales_by_meter") - F.col("pump_test") != F.col("net"), "meter"), F.when(F.col("cumulative").isNull(), "blank_cumulative")))
    rows = register.select("product", "day", F.explode(kinds).alias("kind"))
    return rows.select(F.concat_ws("|", "kind", "product", F.col("day").cast("string")).alias("id"), "kind", "product", "day")


def merge_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """JOIN-06.  Cells in which two readings differ, null-safe: product, day, column, both values; rows that one reading lacks differ in all cells it would have."""
    columns = ["net", "cumulative", "sales_by_meter", "pump_test"]
    both = first.alias("a").join(second.alias("b"), ["product", "day"], "full")
    cells = both.select("product", "day", F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"a.{c}").alias("read1"), F.col(f"b.{c}").alias("read2")) for c in columns))))
    return cells.where(~F.col("read1").eqNullSafe(F.col("read2")))


def with_rates(register: DataFrame, rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """JOIN-10, NUM-05.  Value of each row at the product's rate; an override wins."""
    o = overrides.select("product", F.col("rate").alias("override"))
    rows = register.join(rates, "product", "left").join(o, "product", "left").withColumn("rate", F.coalesce("override", "rate"))
    return rows.select("product", "day", "net", F.col("rate").cast("decimal(10,2)").alias("rate"), F.round(F.col("net") * F.round("rate", 2), 2).cast("decimal(18,2)").alias("value"))


def fan_out(flags: DataFrame, register: DataFrame) -> DataFrame:
    """JOIN-14.  Rows that each flag touches; a null product or day means all.

    Flags of each kind (both, product only, day only, neither) are put together by what they name and joined by
    equality; those that name nothing are one row, so no row meets a flag that doesn't touch it.
    """
    named = lambda p, d: flags.where((F.col("product").isNotNull() if p else F.col("product").isNull()) & (F.col("day").isNotNull() if d else F.col("day").isNull()))
    rows = register.select("product", "day")
    for k, keys in enumerate((["product", "day"], ["product"], ["day"])):
        some = named("product" in keys, "day" in keys).groupBy(*keys).agg(F.collect_list("id").alias(f"_ids{k}"))
        rows = rows.join(some, keys, "left")
    all_rows = named(False, False).agg(F.collect_list("id").alias("_ids3")).withColumn("_one", F.lit(1))  # one row whatever the input
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(all_rows), "_one", "left")
    ids = F.flatten(F.array_compact(F.array(*(F.col(f"_ids{k}") for k in range(4)))))
    # repeated rows of a product and day are one
    found = rows.select("product", "day", F.array_sort(ids).alias("ids")).where("size(ids) > 0").groupBy("product", "day").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return found.select("product", "day", F.array_join(F.array_sort("ids"), ",").alias("flags"))


def duplicate_days(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """DIS-07.  The second row of each product and day, by ``order``.

    Keys are few and rows many: each task keeps the two first rows a key (a window with a limit is cut before the
    shuffle), so a key's rows never meet in one task.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n <= 2").where("_n = 2").select(*keys, order)


#: The cells of a register's row, in order.
CELLS = ("salesByMeter", "pumpTest", "netSales", "cumulative")


def slots_of(config: DataFrame, pages: DataFrame) -> DataFrame:
    """JOIN-11.  Each product of a register's settings (``reg_id``, ``item``, ``register``, ``nth``, ``rate``) with its page: the nth one of its kind; null if there is none."""
    place = F.row_number().over(Window.partitionBy("reg_id", "product").orderBy("page"))
    own = pages.where("kind = 'register'").withColumn("nth", place).select("reg_id", F.col("product").alias("register"), "nth", "page", "second_read")
    return config.join(own, ["reg_id", "register", "nth"], "left")


def register_flags(pages: DataFrame, rows: DataFrame, rates: DataFrame, config: DataFrame, days: int) -> DataFrame:
    """CHK-13.  All flags of registers: ``reg_id``, ``id``, ``kind``, ``product``, ``day``, ``col``, ``rate_key``, each once.

    ``pages``: ``reg_id``, ``page``, ``kind`` (register, rates, other), ``product``, ``month``, ``other_class`` (what a second reading took it for), ``second_read`` (missing, or null).
    ``rows``: ``reg_id``, ``page``, ``row_no``, ``day``, ``meter``, ``pump``, ``net``, ``cumulative``, ``unreadable`` (cells), ``alt`` (cells that a second reading has otherwise).
    ``rates``: ``reg_id``, ``code``, ``rate``, ``alt``.  Only the first row of a day counts, in the order of days; what a row needs of those before it are windows over its page.
    """
    c = F.col
    none = F.lit(None)
    fields = ("product", "day", "col", "rate_key")

    def flags(df: DataFrame, kind, **of) -> DataFrame:
        cast = {"day": "int"}
        return df.select("reg_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *((of.get(f, none)).cast(cast.get(f, "string")).alias(f) for f in fields))

    slots = slots_of(config, pages)
    own = rows.select("reg_id", "page", "row_no", "day", "meter", "pump", "net", "cumulative", "unreadable", "alt")
    read = own.join(slots.where("page IS NOT NULL").select("reg_id", "page", "item", c("rate").alias("rate_key")), ["reg_id", "page"])
    whole = F.coalesce(c("day").between(1, days), F.lit(False))
    again = F.row_number().over(Window.partitionBy("reg_id", "item", "day").orderBy("row_no")) > 1
    read = read.withColumns({"whole": whole, "again": again})
    w = Window.partitionBy("reg_id", "item").orderBy("day")
    good = read.where("whole AND NOT again").withColumns({
        "running": F.sum(F.coalesce("net", F.lit(0))).over(w), "before": F.coalesce(F.last("cumulative", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    wrong = c("cumulative") != c("running")
    good = good.withColumn("breaks", F.coalesce(wrong, F.lit(False))).withColumn("earlier", F.coalesce(F.bool_or("breaks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    cell = lambda kind, col, ok: F.when(ok, F.struct(F.lit(kind).alias("kind"), (none if col is None else F.lit(col)).cast("string").alias("col")))
    blank = F.coalesce(c("net") == 0, F.lit(True)) & ~F.array_contains("unreadable", "netSales") & (c("cumulative") != c("before"))
    each = F.array(
        *(cell("unreadable", k, F.array_contains("unreadable", k)) for k in CELLS), *(cell("disagree", k, F.array_contains(F.map_keys("alt"), k)) for k in CELLS),
        cell("meter-test", None, c("meter") - c("pump") != c("net")), cell("blank-net", None, blank), cell("chain", None, c("breaks") & ~c("earlier")),
    )
    of_rows = good.select("reg_id", "item", "day", F.inline(F.array_compact(each)))
    wanted = slots.where("page IS NOT NULL").select("reg_id", "item", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    used = pages.where("kind = 'register'").groupBy("reg_id", c("product").alias("register")).agg(F.count("*").alias("n"))
    asked = config.groupBy("reg_id", "register").agg(F.count("*").alias("asked"))
    sold = good.where("net <> 0").select("reg_id", "rate_key").distinct()
    parts = [
        flags(pages.where("kind = 'register'").groupBy("reg_id").agg(F.count_distinct("month").alias("n")).where("n > 1"), "month"), flags(pages.where("other_class IS NOT NULL"), "page-class"),
        flags(pages.where("kind = 'rates' AND second_read = 'missing'"), "single-read"), flags(slots.where("second_read = 'missing'"), "single-read", product=c("item")),
        flags(rates.where("alt IS NOT NULL"), "rate-disagree", rate_key=c("code")), flags(used.join(asked, ["reg_id", "register"], "left").where("n > coalesce(asked, 0)"), "extra-page"),
        flags(slots.where("page IS NULL"), "no-page", product=c("item")), flags(read.where("NOT whole"), "bad-day", product=c("item"), day=c("day")), flags(read.where("whole AND again"), "dup-day", product=c("item"), day=c("day")),
        flags(of_rows, c("kind"), product=c("item"), day=c("day"), col=c("col")), flags(wanted.join(good.select("reg_id", "item", "day"), ["reg_id", "item", "day"], "left_anti"), "missing-day", product=c("item"), day=c("day")),
        flags(sold.join(rates.where("rate IS NOT NULL").select("reg_id", c("code").alias("rate_key")), ["reg_id", "rate_key"], "left_anti"), "no-rate", rate_key=c("rate_key")),
        flags(pages.groupBy("reg_id").agg(F.count_if(c("kind") == "rates").alias("n")).where("n = 0"), "no-rates-page"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    text = F.concat_ws("|", "kind", *(F.coalesce(c(f).cast("string"), F.lit("")) for f in fields))
    return out.withColumn("id", text).dropDuplicates(["reg_id", "id"]).select("reg_id", "id", "kind", *fields)


def unresolved(flags: DataFrame, accepted: DataFrame) -> DataFrame:
    """CHK-13.  How many flags of each register nobody has accepted (``accepted``: ``reg_id``, ``id``), and how many there are."""
    known = accepted.select("reg_id", "id").distinct().withColumn("_ok", F.lit(True))
    return flags.join(known, ["reg_id", "id"], "left").groupBy("reg_id").agg(F.count_if(F.col("_ok").isNull()).alias("unresolved"), F.count("*").alias("flags"))
