"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

#: Rows and bytes of text that one step inside Python handles at once.
STEP_ROWS, STEP_BYTES = 128, 8 << 20
#: Rows of an Arrow batch, and the setting that tells them; its bytes are bounded by Spark's own
#: ``spark.sql.execution.arrow.maxBytesPerBatch``.
ARROW_ROWS, ARROW_SETTING, SPARK_ROWS = 512, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Keys that are treated as hot at most, and rows that a key has at least to be one.
SHARES, HOT_ROWS = 4096, 1024

_run = uuid.uuid4().hex[:12]
#: Staged tables and what tells whether a plan still reads them.
_staged: dict[str, tuple] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set and all runs on this machine, a temporary folder is made and
    set, once a session; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a later stage that loses an executor reads these
    files again and nothing before them.  The files stay while a plan can read
    them: until ``release`` or the first ``sweep`` after the last one that could
    is gone, or the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom-{_run}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # every plan that reads these files, of tables made from this one too, holds this object of the JVM
    files = out._jdf.queryExecution().analyzed().relation().location()
    _staged[path] = (spark, spark.sparkContext._jvm.java.lang.ref.WeakReference(files))
    atexit.register(remove, spark, path)
    out._staged_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM notice which shuffles nothing can read any more, so that executors delete their files now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete the staged tables that no plan of this session can read any more."""
    free_shuffles(spark)
    for path, (owner, files) in list(_staged.items()):
        if owner is spark and files.get() is None:
            remove(spark, path)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    remove(df.sparkSession, df._staged_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table; a stopped session leaves it to the cluster."""
    _staged.pop(path, None)
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands whole texts to Python in small batches, unless its user has chosen a size.

    Results are lazy, so this can't be undone when they are returned: a session that
    has Spark's own value keeps ``ARROW_ROWS``, one with another value keeps that.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_SETTING, SPARK_ROWS) == SPARK_ROWS:
        conf.set(ARROW_SETTING, ARROW_ROWS)
    return df


def portions(batch: pa.RecordBatch, text: int, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of at most ``rows`` rows, and of ``STEP_BYTES`` in column ``text`` if several rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == rows or held + size > STEP_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def tidied(run: Callable) -> Callable:
    """A function of Arrow batches whose worker hands memory back when its task ends: an idle worker else keeps what its largest step took."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return task


def map_steps(df: DataFrame, step: Callable[[list[list]], Iterator | dict], schema: str, text: int = -1) -> DataFrame:
    """``mapInArrow`` in small steps.

    ``step`` gets one list a column of ``df`` (Python values, ``portions`` of column
    ``text``) and returns the result's columns by name.
    """
    def run(batches):
        for batch in batches:
            for part in portions(batch, text % batch.num_columns):
                yield record_batch(step([c.to_pylist() for c in part.columns]), arrow)

    arrow = arrow_schema(schema)
    return small_batches(df).mapInArrow(tidied(run), schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def whole_groups(batches, columns: int, keys: int = 1, least: int = 1 << 14) -> Iterator[list]:
    """Stretches of whole groups of sorted rows as arrays; a group has equal first ``keys`` columns.

    What is held is about ``least`` rows and the longest group, not the partition.
    """
    import numpy as np

    def joined(parts: list) -> list:
        return parts[0] if len(parts) == 1 else [np.concatenate(p) for p in zip(*parts)]

    parts, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([np.array(c.to_pylist(), object) if c.null_count else c.to_numpy(zero_copy_only=False) for c in batch.columns[:columns]])
        held += batch.num_rows
        if held >= least:
            kept = joined(parts)
            changes = np.zeros(held - 1, bool)
            for k in range(keys):
                changes |= kept[k][1:] != kept[k][:-1]
            found = np.flatnonzero(changes)
            if len(found):
                last = int(found[-1]) + 1
                yield [c[:last] for c in kept]
                kept = [c[last:] for c in kept]
            parts, held = [kept], len(kept[0])
    if held:
        yield joined(parts)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """The ``SHARES`` most frequent keys of those that over ``HOT_ROWS`` rows have; None if there are none.

    Their number is bounded whatever the input, so they can be collected and
    broadcast.  Any other key has at most ``HOT_ROWS`` rows or one in ``SHARES`` of all.
    """
    return most_rows(rows.groupBy(*on).agg(F.count("*").alias("_h_n")), on, "_h_n")


def most_rows(counted: DataFrame, on: list[str], rows: str) -> DataFrame | None:
    """As ``hot_keys``, of keys whose rows are counted already in column ``rows``."""
    found = counted.where(F.col(rows) > HOT_ROWS).orderBy(F.desc(rows), *on).limit(SHARES).select(*on).collect()
    return counted.sparkSession.createDataFrame(found, counted.select(*on).schema) if found else None


def join_with_hot(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``keyed``, where ``hot`` holds the keys (``SHARES`` at most) that very many rows have.

    Hot keys' rows stay where they lie and meet a broadcast of what ``keyed`` has for
    them; only the others are shuffled.
    """
    if hot is None:
        return rows.join(keyed, on)
    hot = F.broadcast(hot)
    cold = rows.join(hot, on, "left_anti").join(keyed.join(hot, on, "left_anti"), on)
    return cold.unionByName(rows.join(F.broadcast(keyed.join(hot, on, "left_semi")), on))


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (staged) joined with the one row that ``keyed`` has for each key."""
    return join_with_hot(rows, keyed, on, hot_keys(rows, on))


def join_spread(rows: DataFrame, keyed: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` (staged, narrow) joined with ``keyed`` (staged, one possibly wide row a key).

    A key that over ``HOT_ROWS`` rows have is dealt out to as many tasks as that takes: its
    rows by column ``by``, and a copy of what ``keyed`` has for it to each.
    """
    hot = hot_keys(rows, [on])
    if hot is None:
        return rows.join(keyed, on)
    counts = rows.groupBy(on).agg(F.count("*").alias("_h_n")).where(F.col("_h_n") > HOT_ROWS)
    salts = staged(counts.select(on, F.ceil(F.col("_h_n") / HOT_ROWS).cast("int").alias("_h_s")), "spread-keys")
    many = join_with_hot(rows, salts, [on], hot).withColumn("_h_s", F.pmod(F.xxhash64(by), F.col("_h_s")).cast("int"))
    copies = keyed.join(salts, on).withColumn("_h_s", F.explode(F.sequence(F.lit(0), F.col("_h_s") - 1)))
    few = rows.join(F.broadcast(hot), on, "left_anti").join(salts.select(on), on, "left_anti")
    return few.join(keyed, on).unionByName(many.join(copies, [on, "_h_s"]).drop("_h_s"))


def words_of(text) -> F.Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, in order; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def text_ids(text: Column) -> list[Column]:
    """Two longs that tell texts apart: the first 128 bits of a text's SHA-256."""
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, k, 16), 16, -10).cast("long") for k in (1, 17)]


@F.pandas_udf(BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    """Texts as compressed UTF-8, for a shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return texts.map(lambda t: pack((t or "").encode()))
