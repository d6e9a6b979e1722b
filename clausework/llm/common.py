"""Helpers shared by the training-data operators.

Intermediate tables are Parquet under the shared folder the cluster names
in ``spark.checkpoint.dir`` (``clausework.session.run_dir``), never a local
folder and never an executor's block store, so a lost executor costs only
its running tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.session import run_dir

# The ASCII white space that parts words: space, \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage
    and computes a costly input once for several readers."""
    path = run_dir(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` returned."""
    spark = df.sparkSession
    jvm = spark._jvm
    seen = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in seen:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column | str) -> Column:
    """Words of a text, null as an empty text: runs free of ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_key(text: Column | str) -> Column:
    """A hash that tells rows of one id apart by their texts; null is as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not among ``gone`` (``id_col`` and ``text_key``):
    a row goes by its own id and text, a null id is an id like any other."""
    out = gone.select(F.col(id_col).alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own_id"), text_key(text_col).alias("_own_key"))
    kept = own.join(out, F.col("_own_id").eqNullSafe(F.col("_gone_id")) & (F.col("_own_key") == F.col("_gone_key")), "left_anti")
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def lower_ascii(text: Column | str) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def bounded_sample(rows: DataFrame, n_rows: int, limit: int, by: list[str]) -> DataFrame:
    """At most ``limit`` of the ``n_rows`` rows, chosen by a hash of the columns ``by``.

    Rows whose hash is not among the lowest twice-``limit`` share are left
    out first, so that the ordering which settles the bound meets about
    twice ``limit`` rows however large the table is.
    """
    order = F.xxhash64(*by)
    if n_rows > 2 * limit:
        rows = rows.where(F.pmod(order, F.lit(1 << 30)) < (2 * limit * (1 << 30)) // n_rows)
    return rows.orderBy(F.pmod(order, F.lit(1 << 30)), *by).limit(limit)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
