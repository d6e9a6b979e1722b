"""Top hits of a search that ends early (O2).

Searchable rows are stored by slices of their upload time (days, by default).
A search reads the newest slices first.  Whatever lies in older slices ranks
behind every hit of a newer one, so a query that has its ``n`` hits is
answered; only the others go on, over twice as many slices as in the round
before, until all are answered or no slice is left.  The last rank is taken
over at most ``n`` kept hits per query and round.

Rows without an upload time rank last and lie in a slice behind all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework import constants as C
from clausework.operators import search as S
from clausework.session import run_dir

DAY = 86400
_NO_TIME = -(1 << 40)
HITS = ("query_id bigint, document_id string, file_name string, uploaded_at timestamp_ntz, match_area string, area_rank int, "
        "pos bigint, title string, matched_text string, severity string, rank bigint")


def write_by_time(rows: DataFrame, path: str, slice_seconds: int = DAY) -> None:
    """Store searchable rows (``operators.search.area_rows``) by slices of their upload time."""
    # the difference of two times without a zone: no clock change can reorder slices
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', uploaded_at)")
    sliced = rows.withColumn("slice", F.coalesce(F.floor(seconds / slice_seconds), F.lit(_NO_TIME)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (sliced.repartitionByRange(n, "slice", *S.ROW_KEY).sortWithinPartitions("slice", "document_id")
     .write.mode("append").partitionBy("slice").parquet(path))


def slices_of(spark: SparkSession, path: str) -> list[int]:
    """The slices of a store, newest first: names of folders, no data is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slice=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    return sorted((int(f.getPath().getName().removeprefix("slice=")) for f in found), reverse=True)


class NewestFirst:
    """A store written by ``write_by_time`` and how much of it the last search read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.slices_read: list[int] = []

    def top(self, queries: DataFrame, n: int = C.SEARCH_SHOWN, first: int = 1) -> DataFrame:
        """The first ``n`` hits of each query with their texts, as ``search.top_hits`` gives them."""
        spark, out = self.spark, run_dir(self.spark, "newest-top")
        slices = slices_of(spark, self.path)
        self.slices_read = []
        store = spark.read.parquet(self.path) if slices else None
        asked = queries.select(F.lower("query_text").alias("query_text")).where("query_text <> ''").distinct()
        asked.write.parquet(f"{out}/open=0")
        rounds, done, width = 0, 0, first
        kept: DataFrame | None = None
        while done < len(slices):
            waiting = spark.read.schema("query_text string").parquet(f"{out}/open={rounds}")
            if waiting.isEmpty():
                break
            here = slices[done:done + width]
            rows = store.where(F.col("slice").between(here[-1], here[0]))
            keys = S.hit_keys(rows, S.text_patterns(waiting))
            S.top_keys(keys, n).drop("rank").write.parquet(f"{out}/keys={rounds}")
            found = spark.read.parquet(*(f"{out}/keys={k}" for k in range(rounds + 1)))
            full = found.groupBy("q").count().where(F.col("count") >= n).select(F.col("q").alias("query_text"))
            waiting.join(full, "query_text", "left_anti").write.parquet(f"{out}/open={rounds + 1}")
            kept = found
            self.slices_read += here
            done, width, rounds = done + width, 2 * width, rounds + 1
        if kept is None:
            return spark.createDataFrame([], HITS)
        S.top_keys(kept, n).drop("uploaded_at").write.parquet(f"{out}/top")
        top = spark.read.parquet(f"{out}/top")
        read = store.where(F.col("slice").between(self.slices_read[-1], self.slices_read[0])).drop("slice", "_t1", "_t2")
        shown = read.join(top, S.ROW_KEY)
        return shown.join(queries.select("query_id", F.lower("query_text").alias("q")), "q").select(*S.HIT_COLUMNS, "rank")
