"""A store laid out by document.

The parent and child tables of a store are published bucketed by
``document_id`` into the same number of buckets, one sorted file each.  Parent
and children then meet bucket by bucket: a join of them needs no exchange and
no sort, and the children of one document are read from one bucket.

Spark keeps the layout of bucketed tables in its catalogue, which a session
may lose; so it is also written beside the data, and ``Published`` declares
the tables again from there.  Publishing writes a folder of its own and is
done when its layout file is there, so a reader never sees half a store.

A document's children are bounded by its text, so a bucket holds about as
much as any other; ``buckets`` should give files of some 100 MB.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clausework.operators.store import CARRIED, CHILD_COLUMNS, DOCUMENT_COLUMNS, Store

TABLES = ["documents", *CHILD_COLUMNS]
KEY = "document_id"


def publish(store: Store, path: str, buckets: int = 64, children: list[str] | None = None) -> "Published":
    """Write the documents and their children (all kinds by default) under ``path``, bucketed and sorted by document."""
    spark = store.documents.sparkSession
    shapes = {"documents": [*DOCUMENT_COLUMNS, "uploaded_at"], **{name: [c for c in columns] for name, columns in CHILD_COLUMNS.items()}}
    layout = {"buckets": buckets, "tables": {}}
    run = uuid.uuid4().hex[:12]
    for name in TABLES if children is None else ["documents", *children]:
        df = getattr(store, name).drop(*(CARRIED if name != "documents" else ())).select(*shapes[name])
        folder = f"{path}/{name}-{run}"
        # one task a bucket: one file a bucket
        (df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY).format("parquet")
         .option("path", folder).saveAsTable(f"published_{name}_{run}"))
        layout["tables"][name] = {"folder": folder, "schema": df.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(f"{path}/layout")
    return Published(spark, path)


class Published:
    """The tables of a published store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
        for name, made in layout["tables"].items():
            table = f"open_{name}_{uuid.uuid4().hex[:12]}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(made["schema"]).fields)
            folder = made["folder"].replace("'", "\\'")
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                      f"INTO {layout['buckets']} BUCKETS LOCATION '{folder}'")
            setattr(self, name, spark.table(table))

    def children(self, name: str, document_id: str) -> DataFrame:
        """The children of one document (S10-S12): one bucket is read."""
        return getattr(self, name).where(getattr(self, name)[KEY] == document_id)

    def with_documents(self, name: str) -> DataFrame:
        """Children with their document's name and upload time (J1-J3), bucket by bucket."""
        # a merge of sorted buckets: no side is sent anywhere, whatever its size
        meta = self.documents.select(KEY, *CARRIED).hint("merge")
        return getattr(self, name).join(meta, KEY)
