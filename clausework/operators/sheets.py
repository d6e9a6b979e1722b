"""Report sheets with row numbers (K7).

A workbook's rows are numbered from 1 through a whole sheet, and a sheet holds
so many rows at most.  A number over all rows needs no task that sees all
rows: they are sorted by range over the cluster, each partition's rows carry
their place in it, and the counts of the partitions before (one number for
each partition, the only thing the driver sees) make places numbers.  The
sorted rows are written first, so that a task which runs again finds the same
partitions.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.session import run_dir

# Rows of a sheet, without its header, that spreadsheet programs read.
SHEET_ROWS = 1_048_575
_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``number``, gapless from 1 in ``order``; rows that tie are numbered as they are sorted."""
    spark = rows.sparkSession
    path = run_dir(spark, "numbered-rows")
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    done = spark.read.parquet(path)
    part = F.shiftright("_at", 33)
    counts = sorted((r.part, r["count"]) for r in done.groupBy(part.alias("part")).count().collect())
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    table = spark.createDataFrame(list(before.items()), "part long, before long")
    # a row for each partition of the sort
    return (done.join(F.broadcast(table), part == F.col("part"))
            .select(*rows.columns, (F.col("before") + F.col("_at").bitwiseAND(F.lit(_PLACE)) + 1).alias("number")))


def in_sheets(rows: DataFrame, order: list[Column | str], sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """``rows`` with ``sheet`` from 0 and ``number`` from 1 through all sheets."""
    return numbered(rows, order).withColumn("sheet", F.floor((F.col("number") - 1) / sheet_rows).cast("bigint"))


def write_sheets(rows: DataFrame, order: list[Column | str], path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """One folder ``sheet=<n>`` for each sheet of at most ``sheet_rows`` rows."""
    in_sheets(rows, order, sheet_rows).write.partitionBy("sheet").parquet(path)
