"""Sharding by a K-d tree over document metadata (operator 7, native).

The documents, weighted by their bytes, are split again and again until the
leaves reach the target size.  A node that is to become ``k`` leaves is
split along the dimension in which its documents spread widest (against the
spread of the whole table), at the weighted quantile that gives the left
side ``floor(k / 2)`` leaves' worth of bytes.  All nodes of a level are
split together.

The nodes of a level are a table with a row for each; documents meet their
node in a join.  The weighted medians are found by the cluster: the byte sums
of equal ranges of each node's values are added up (partial sums in every
task), the range that holds the quantile is looked up by a running sum over
the ranges of a node, and parted again, until it is one value.  Documents
that tie with the median are told apart by id and then by the number of their
row in the same manner, and the one at the quantile goes to the side that it
brings nearer to its weight.  Only one row per node and round reaches the
driver.  String dimensions count by the rank of the whole string among the
distinct ones, found by sorting these over the cluster.

A node of one document is a leaf, whatever it was to become, and its other
shards stay empty; a side of a split that no document falls to likewise.

Slots number a shard's documents from 0 without any task seeing a whole
shard: rows are numbered in hash buckets of a shard, whose counts give each
bucket its first slot.

Cases: a null text has no bytes (size 1, CRC 0); a null in a dimension
counts as its least value; a null id sorts before all others; rows equal in
every dimension and id are told apart by their row numbers, so that they can
be split like any others; a text that weighs more than a shard has one for
itself, or with few others; an empty table gives an empty table.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.common import drop_written, written

# Ranges into which the values of all nodes of a level are parted in a round, about.
LEVEL_BINS = 1 << 18
# Documents of a slot bucket, about.
BUCKET_ROWS = 8192
# Rows of a node table that are broadcast at most (some 50 bytes each).
BROADCAST_NODES = 200_000
_LEAST = -(1 << 62)


def ranked(values: DataFrame, col: str) -> DataFrame:
    """The distinct non-null values of a column with their rank from 1.

    They are sorted by range over the cluster; a value's number within its
    partition and the counts of the partitions before give its rank.
    """
    own = values.select(F.col(col).alias("value")).where("value is not null").distinct()
    own = written(own.orderBy("value").withColumn("at", F.monotonically_increasing_id()), "sorted-values")
    parts = own.groupBy(F.shiftright("at", 33).alias("part")).count()
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    return own.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part")).select(
        "value", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def _schema(**types: str) -> pa.Schema:
    return pa.schema([(name, pa.type_for_alias(of)) for name, of in types.items()])


def _node_table(spark, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    # as an Arrow table: a list would be sent through Python on the executors
    table = spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema))
    return F.broadcast(table) if len(rows) <= BROADCAST_NODES else table


def _quantiles(rows: DataFrame, key: str, bounds: dict[int, list], wanted: dict[int, float]) -> dict[int, tuple[int, float, int, int]]:
    """For each node the least value of ``key`` whose weight, with all below it,
    is over the wanted weight (else the last value); the weight below that
    value, its own weight and its rows.  ``bounds``: least and last value."""
    spark = rows.sparkSession
    open_nodes = {n: [lo, hi, 0.0] for n, (lo, hi) in bounds.items()}
    done: dict[int, tuple[int, float, int, int]] = {}
    while open_nodes:
        bins = max(16, LEVEL_BINS // len(open_nodes))
        step = {n: -(-(hi - lo + 1) // bins) for n, (lo, hi, _) in open_nodes.items()}
        table = _node_table(spark, [(n, lo, hi, step[n], float(wanted[n] - below)) for n, (lo, hi, below) in open_nodes.items()],
                            _schema(of="int64", lo="int64", hi="int64", step="int64", wanted="float64"))
        sums = (rows.join(table, F.col("node") == F.col("of")).where(F.col(key).between(F.col("lo"), F.col("hi")))
                .groupBy("of", F.expr(f"({key} - lo) div step").alias("bin"), "wanted").agg(F.sum("size").alias("w"), F.count("*").alias("n")))
        upto = F.sum("w").over(Window.partitionBy("of").orderBy("bin"))
        at = F.struct("bin", (F.col("upto") - F.col("w")).alias("below"), "w", "n")
        over = F.when(F.col("upto") > F.col("wanted"), F.col("bin"))
        found = sums.withColumn("upto", upto).groupBy("of").agg(F.coalesce(F.min_by(F.when(over.isNotNull(), at), over), F.max_by(at, "bin")).alias("at")).collect()
        for r in found:
            lo, hi, below = open_nodes[r["of"]]
            first = lo + r["at"]["bin"] * step[r["of"]]
            last = min(hi, first + step[r["of"]] - 1)
            open_nodes[r["of"]] = [first, last, below + r["at"]["below"]]
            if first == last:
                done[r["of"]] = (first, below + r["at"]["below"], r["at"]["w"], r["at"]["n"])
                del open_nodes[r["of"]]
    return done


def _cuts(rows: DataFrame, bounds: dict[int, list], wanted: dict[int, float]) -> dict[int, list]:
    """Where each node is cut: values of ``value``, ``id`` and ``row`` (null where not asked)
    and whether the row they name goes left.  ``rows``: ``node, size, value, id, row``."""
    spark = rows.sparkSession
    cuts: dict[int, list] = {n: [] for n in bounds}
    left = dict(wanted)
    names = ["value", "id", "row"]
    out: dict[int, list] = {}
    for k, key in enumerate(names):
        if not bounds:
            break
        for n, (cut, below, w, rows_there) in _quantiles(rows, key, bounds, left).items():
            cuts[n].append(cut)
            left[n] -= below
            if rows_there == 1 or k == len(names) - 1:
                out[n] = [*cuts[n], *[None] * (2 - k), abs(w - left[n]) < abs(left[n])]
        tied = [n for n in bounds if n not in out]
        if not tied:
            break
        table = _node_table(spark, [(n, cuts[n][-1]) for n in tied], _schema(of="int64", cut="int64"))
        rows = rows.join(table, (F.col("node") == F.col("of")) & (F.col(key) == F.col("cut"))).select("node", "size", *names)
        after = names[k + 1]
        bounds = {r["node"]: [r["lo"], r["hi"]] for r in rows.groupBy("node").agg(F.min(after).alias("lo"), F.max(after).alias("hi")).collect()}
    return out


def kd_shards(rows: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """``rows`` (``id``, ``size``, ``row``, a number of its own, and integer ``dims``) with
    ``shard`` in ``0 .. n_shards - 1``, shards near equal in size."""
    spark = rows.sparkSession
    spans = rows.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if spans[0] is None or n_shards == 1:
        return rows.withColumn("shard", F.lit(0))
    spread = {d: max(1, spans[f"hi_{d}"] - spans[f"lo_{d}"]) for d in dims}
    nodes = {0: (0, n_shards)}  # open node: its first shard and how many
    leaves: dict[int, int] = {}
    last = None
    rows, made = rows.withColumn("_node", F.lit(0).cast("long")), 1
    while nodes:
        stats = {r["_node"]: r for r in rows.join(_node_table(spark, [(n,) for n in nodes], _schema(of="int64")), F.col("_node") == F.col("of")).groupBy("_node").agg(
            F.sum("size").alias("w"), F.count("*").alias("n"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        for n, (first, k) in nodes.items():
            if n in stats and (k == 1 or stats[n]["n"] == 1):
                leaves[n] = first
        nodes = {n: v for n, v in nodes.items() if n in stats and n not in leaves}  # a side without documents ends here
        if not nodes:
            break
        widest = {n: max(dims, key=lambda d: ((stats[n][f"hi_{d}"] - stats[n][f"lo_{d}"]) / spread[d], d)) for n in nodes}
        wanted = {n: stats[n]["w"] * (k // 2) / k for n, (_, k) in nodes.items()}
        bounds = {n: [stats[n][f"lo_{widest[n]}"], stats[n][f"hi_{widest[n]}"]] for n in nodes}
        table = _node_table(spark, [(n, dims.index(widest[n])) for n in nodes], _schema(of="int64", dim="int32"))
        valued = rows.join(table, F.col("_node") == F.col("of"))
        value = F.element_at(F.array(*(F.col(d) for d in dims)), F.col("dim") + 1)
        cuts = _cuts(valued.select(F.col("_node").alias("node"), "size", value.alias("value"), "id", "row"), bounds, wanted)
        sides, after = [], {}
        for n, (first, k) in nodes.items():
            sides.append((n, dims.index(widest[n]), *cuts[n], made, made + 1))
            after[made], after[made + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            made += 2
        table = _node_table(spark, sides, _schema(of="int64", dim="int32", c0="int64", c1="int64", c2="int64", here="bool", low="int64", high="int64"))
        c = F.col
        left = (F.when(value != c("c0"), value < c("c0")).when(c("c1").isNull(), c("here")).when(c("id") != c("c1"), c("id") < c("c1"))
                .when(c("c2").isNull(), c("here")).when(c("row") != c("c2"), c("row") < c("c2")).otherwise(c("here")))
        node = F.when(c("of").isNull(), c("_node")).when(left, c("low")).otherwise(c("high"))
        # the node of a row is written down each level, so that plans stay short
        moved = written(rows.join(table, c("_node") == c("of"), "left").select(*[x for x in rows.columns if x != "_node"], node.alias("_node")), "kd-level")
        if last is not None:
            drop_written(last)
        rows = last = moved
        nodes = after
    shards = _node_table(spark, list(leaves.items()), _schema(of="int64", shard="int32"))
    return rows.join(shards, F.col("_node") == F.col("of")).drop("_node", "of")


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each ``shard``."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    firsts = (rows.groupBy("shard", "_bucket").count()
              .withColumn("_first", F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count"))
              .select("shard", "_bucket", "_first"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("id", "crc", "size", "row")) - 1)
    return numbered.join(firsts, ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_k")).cast("long")).drop("_bucket", "_first", "_k")


def shard_documents(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", string_dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: ``id_col``, ``size`` (bytes and 1), ``text_crc32``, ``shard`` and ``slot``.

    Either the number of shards is given, or the bytes a shard should reach.
    Dimensions: the length in bytes, the id and the ranks of ``string_dims``.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    read = written(docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.col(id_col).isNull().alias("no_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("row"),
        F.octet_length(text).cast("long").alias("d_bytes"), *(F.col(c).cast("string").alias(f"s_{k}") for k, c in enumerate(string_dims))), "shard-metadata")
    total = read.agg(F.sum("size"), F.count("*")).first()
    if n_shards is None:
        n_shards = max(1, -(-(total[0] or 0) // target_bytes))
    rows = read.withColumn("d_id", F.when(F.col("no_id"), F.lit(0)).otherwise(F.col("id")))
    for k in range(len(string_dims)):
        ranks = ranked(read, f"s_{k}").select(F.col("value").alias(f"v_{k}"), F.col("rank").alias(f"d_{k}"))
        rows = rows.join(ranks, F.col(f"s_{k}") == F.col(f"v_{k}"), "left").withColumn(f"d_{k}", F.coalesce(f"d_{k}", F.lit(0))).drop(f"s_{k}", f"v_{k}")
    if string_dims:
        rows = written(rows, "shard-dimensions")
        drop_written(read)
    placed = kd_shards(rows, ["d_bytes", "d_id", *(f"d_{k}" for k in range(len(string_dims)))], n_shards)
    return with_slots(placed, total[1]).select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
