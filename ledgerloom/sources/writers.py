"""Sinks: sheets as CSV or Parquet, with read-back verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sheet_name(name):
    """SNK-13.  A file name of safe characters."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[^A-Za-z0-9._-]+", "_")


def write_sheets(sheets: dict[str, DataFrame], folder: str, format_: str = "parquet") -> dict[str, int]:
    """SNK-07.  One table a sheet, empty ones left out; each is read back and counted.  Nothing that lies there is overwritten."""
    out = {}
    for name, df in sheets.items():
        if df.isEmpty():
            continue
        path = f"{folder}/{name}"
        (df.write.option("header", True).csv if format_ == "csv" else df.write.parquet)(path)
        back = (df.sparkSession.read.option("header", True).csv if format_ == "csv" else df.sparkSession.read.parquet)(path)
        out[name] = back.count()
    return out
