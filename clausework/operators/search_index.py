"""A stored search index: positional words in immutable segments.

At intake every searchable text (clauses, risks and paragraphs, lowered as a
search lowers them) is cut into grams: a word with the white space before it,
and the white space at the end.  A posting says that a gram stands at a place
of a text of a row, so a text has as many places as words.  The postings of a gram in a
block of neighbouring rows are one record with lists of rows, texts and places: the gram
is written, moved and sorted once for them all.  A batch's
postings are one segment, committed together with the batch's tables
(``operators.snapshots``) and never changed; segments are merged into larger
ones by a commit of their own.

A query needs no text.  It is cut into tiles in the same way.  A query of one
tile stands where it is within a gram; of several, where the first ends a
gram, the last starts one, and those between are grams, at one start.  The
dictionary of the segments' grams, which grows as a vocabulary does, is
matched with the tiles (``operators.matching``) and the postings of the grams so
found are read, shifted by their offsets and counted by row and start.  Queries of one tile
need no dictionary where the tasks can hold them: the records of a block meet in a task, which
looks the queries up in the block's grams and marks them in its rows.
Postings are parted by a hash of the gram and sorted by gram, so that a search for a few grams
reads the parts and row groups of its grams only; the blocks of a part are dealt to
``BLOCK_SALTS`` files, so that a gram that a third of all rows holds is no one task's work.

NULL texts have no postings; a NULL or empty query matches nothing; a query
asked under several ids is searched once.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import search as S
from clausework.operators.matching import Finder, Patterns, distinct_pairs, found_numbers, rows_containing, spans
from clausework.operators.snapshots import Snapshots
from clausework.session import run_dir

# A word with the white space before it, or the white space at the end.
GRAM = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
# Folders into which postings are parted by a hash of their gram.
GRAM_PARTS = 32
# Up to this many grams are pushed into the scan as literals; more meet the postings in a join.
PUSHED_GRAMS = 1024
# Places and rows of a block, about; a row is never cut.
BLOCK_PLACES, BLOCK_ROWS = 500_000, 1 << 20
# Of the index's files: lists of numbers become a good deal smaller than by the default.
CODEC = "zstd"
# Records that a task hands on at a time.
RECORDS_AT_ONCE = 1 << 14
# Files over which the blocks of a part are dealt.
BLOCK_SALTS = 8
# Rows times queries that are marked in one table.
CELLS_AT_ONCE = 1 << 23
ROWS, POSTINGS, GRAMS = "index_rows", "index_postings", "index_grams"
_TEXTS = ["_t1", "_t2"]


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GRAM), F.lit(0))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_PARTS)).cast("int")


_ORDER = ["gram_part", "gram", "segment", "base"]


def _shaped(postings: DataFrame) -> DataFrame:
    """Postings by part, sorted by gram: a gram's records lie together in the files of its part."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("segment", "base"), F.lit(BLOCK_SALTS))
    return postings.repartition(n, "gram_part", salt).sortWithinPartitions(*_ORDER)


_BLOCK = "gram string, base long, area_rank int, places int, row_text_no array<int>, at array<int>"


def _blocks(batches):
    """Rows (``row, area_rank, _t1, _t2``) as records of blocks, each of one area: a gram with the row
    (counted from ``base``, twice, and 1 in the second text) and the place of each posting."""
    import pyarrow as pa

    cut = re.compile(GRAM).findall
    ids: dict[str, int] = defaultdict(count().__next__)
    # of the block: the first row and the area, the gram at each place, and of each text the row and how many places it has
    key, grams, texts, lengths = None, array("i"), [], []

    def block():
        gram, n = np.frombuffer(grams, np.int32), np.array(lengths, np.int32)
        order = np.argsort(gram, kind="stable")
        at = np.arange(len(gram), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
        row = np.repeat(np.array(texts, np.int32), n)
        held = np.bincount(gram, minlength=len(ids))
        starts = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x[order], pa.int32())) for x in (row, at)]
        same = [pa.array(np.full(len(ids), k), t) for k, t in zip(key, (pa.int64(), pa.int32()))]
        whole = pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), *same, pa.array(held, pa.int32()), *lists], names=["gram", "base", "area_rank", "places", "row_text_no", "at"])
        return [whole.slice(k, RECORDS_AT_ONCE) for k in range(0, len(ids), RECORDS_AT_ONCE)]

    for batch in batches:
        for row, area, *both in zip(*(batch.column(c).to_pylist() for c in ("row", "area_rank", *_TEXTS))):
            if texts and (len(grams) >= BLOCK_PLACES or area != key[1] or not 0 <= row - key[0] < BLOCK_ROWS):
                yield from block()
                ids, grams, texts, lengths = defaultdict(count().__next__), array("i"), [], []
            for no, text in enumerate(both):
                if text:
                    if not texts:
                        key = row, area
                    before = len(grams)
                    grams.extend(map(ids.__getitem__, cut(text)))
                    texts.append(2 * (row - key[0]) + no)
                    lengths.append(len(grams) - before)
    if texts:
        yield from block()


def segment_tables(rows: DataFrame, segment: str, path: str | None = None) -> dict[str, DataFrame | Callable]:
    """The tables of a segment of searchable rows (``operators.search.area_rows``).

    The rows are numbered in a table written under ``path``, so that numbers stay what they
    are when a task runs again; it is not needed when the tables are written.  Postings are
    sorted by the tasks that make them, into files of their own; a merge brings these together.
    """
    spark = rows.sparkSession
    path = path or run_dir(spark, "index-rows")
    numbered = rows.select(F.lit(segment).alias("segment"), F.monotonically_increasing_id().alias("row"), *S.ROW_KEY, "uploaded_at", *_TEXTS)
    numbered.write.parquet(path, compression=CODEC)
    numbered = spark.read.parquet(path)
    blocks = numbered.select("row", "area_rank", *_TEXTS).mapInArrow(_blocks, _BLOCK)
    postings = blocks.select("gram", F.lit(segment).alias("segment"), "base", "area_rank", "places", "row_text_no", "at", _part(F.col("gram")).alias("gram_part"))
    return {ROWS: numbered.select("segment", "row", *S.ROW_KEY, "uploaded_at"), POSTINGS: postings.sortWithinPartitions(*_ORDER),
            GRAMS: lambda written: written(POSTINGS).groupBy("gram").agg(F.sum("places").alias("places"))}


def _opened(postings: DataFrame) -> DataFrame:
    """A row for each posting: ``gram, segment, row, text_no, at``."""
    each = postings.select("gram", "segment", "base", F.inline(F.arrays_zip("row_text_no", "at")))
    return each.select("gram", "segment", (F.col("base") + F.shiftright("row_text_no", 1)).alias("row"), F.col("row_text_no").bitwiseAND(F.lit(1)).alias("text_no"), "at")


def _by_block(batches):
    """Records that come one block after another as blocks: ``segment, base, area_rank``, the grams, how many postings each has, and the rows of all."""
    key, parts = None, []

    def joined():
        return key, [g for grams, *_ in parts for g in grams], *(np.concatenate([part[k] for part in parts]) for k in (1, 2))

    for batch in batches:
        if not batch.num_rows:
            continue
        segment, base = batch.column("segment"), batch.column("base").to_numpy()
        # in order of segments: one, if the first is the last
        new = base[1:] != base[:-1] if segment[0] == segment[-1] else np.ones(len(base) - 1, bool)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(base)]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(batch.column(c)[a].as_py() for c in ("segment", "base", "area_rank"))
            if parts and key != here:
                yield joined()
                parts = []
            key, lists = here, batch.column("row_text_no").slice(a, b - a)
            parts.append((batch.column("gram").slice(a, b - a).to_pylist(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy() >> 1))
    if parts:
        yield joined()


def _marks(queries: list[str], counted: bool):
    """The rows of blocks with the numbers of the queries that one of their grams holds, or how many rows of a block each query has."""
    def marked(batches):
        import pyarrow as pa

        many, n = Finder(queries), len(queries)
        for (segment, base, area), grams, sizes, rows in _by_block(batches):
            lengths, held = many.each(grams)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            gram = np.repeat(np.arange(len(grams)), sizes)
            order = np.argsort(rows, kind="stable")
            gram, rows = gram[order], rows[order]
            step = max(1, CELLS_AT_ONCE // max(1, n))
            total = np.zeros(n, np.int64)
            for first in range(0, int(rows[-1]) + 1, step):  # so many rows that the marks fit in a table
                a, b = np.searchsorted(rows, [first, first + step])
                place, at = spans(starts, gram[a:b])
                row, query = distinct_pairs(rows[a:b][place] - first, held[at], min(step, int(rows[-1]) + 1 - first), n)
                if counted:
                    total += np.bincount(query, minlength=n)
                elif len(row):
                    hit, counts = np.unique(row, return_counts=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(query, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(hit), pa.string()), pa.array(hit + first + base, pa.int64()), lists], names=["segment", "row", "ns"])
            if counted:
                asked = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), area), pa.int32()), pa.array(asked, pa.int32()), pa.array(total[asked], pa.int64())], names=["area_rank", "_n", "hits"])
    return marked


PARTITION_BY = {POSTINGS: ["gram_part"]}


class SearchIndex:
    """Searches over the segments of a store's current version, or an earlier one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store, self.version = spark, Snapshots(spark, path), version

    def add(self, batch: str, rows: DataFrame) -> int | None:
        """Commit a segment alone; a batch that is there already adds nothing."""
        if batch in self.store.batches():
            return None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(run_dir(self.spark, "index-rows"))
        try:
            return self.store.commit(batch, segment_tables(rows, batch, path.toString()), PARTITION_BY, codec=CODEC)
        finally:  # the texts are in the store
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def merge(self, batch: str) -> None:
        """Replace all segments by one; rows keep their segment's name and number."""
        self.store.merge(f"{batch}-postings", POSTINGS, _shaped, PARTITION_BY[POSTINGS], CODEC)
        self.store.merge(f"{batch}-rows", ROWS)
        self.store.merge(f"{batch}-grams", GRAMS, lambda df: df.groupBy("gram").agg(F.sum("places").alias("places")))

    def tiles(self, queries: DataFrame) -> DataFrame:
        """``(q, n_tiles, offset, gram)`` of each distinct query text, a row for each gram that may stand
        at a tile; a text with a tile that no gram fits has none."""
        q = queries.select(F.lower("query_text").alias("q")).where("q <> ''").distinct()
        cut = q.withColumn("tiles", _grams(F.col("q"))).select("q", F.size("tiles").alias("n_tiles"), F.posexplode("tiles").alias("offset", "tile"))
        known = self.store.read(GRAMS, self.version).select("gram").distinct()
        held = rows_containing(known, ["gram"], cut.select("tile").distinct(), "tile", "tile")
        first, last = F.col("offset") == 0, F.col("offset") == F.col("n_tiles") - 1
        fits = (F.when(first & last, True).when(first, F.endswith("gram", F.col("tile"))).when(last, F.startswith("gram", F.col("tile")))
                .otherwise(F.col("gram") == F.col("tile")))
        met = held.join(cut, "tile").where(fits).select("q", "n_tiles", "offset", "gram")
        whole = met.where("n_tiles > 1").groupBy("q", "n_tiles").agg(F.count_distinct("offset").alias("here")).where("here = n_tiles").select("q")
        return met.where("n_tiles = 1").unionByName(met.where("n_tiles > 1").join(whole, "q", "left_semi"))

    def _asked(self, queries: DataFrame) -> tuple[list[str] | None, DataFrame, DataFrame]:
        """The one-tile texts that are sent to the tasks (None: too many), the tiles of all others, and the postings they may need."""
        cut = queries.select(F.lower("query_text").alias("q")).where("q <> ''").distinct().withColumn("n_tiles", F.size(_grams(F.col("q"))))
        single = Patterns(cut.where("n_tiles = 1"), "q", "q")
        sent = [q for q, _ in single.literal] if single.literal is not None else single.texts if single.small else None
        path = run_dir(self.spark, "query-tiles")
        others = cut if sent is None else cut.where("n_tiles > 1")
        self.tiles(others.select(F.col("q").alias("query_text"))).write.parquet(path)
        tiles = self.spark.read.parquet(path)
        postings = self.store.read(POSTINGS, self.version)
        asked = {r.gram for r in tiles.select("gram").distinct().limit(PUSHED_GRAMS + 1).collect()}
        if sent and len(asked) <= PUSHED_GRAMS:
            known = self.store.read(GRAMS, self.version).select("gram").withColumn("n", F.size(found_numbers(["gram"], sent)))
            asked.update(r.gram for r in known.where("n > 0").select("gram").limit(PUSHED_GRAMS + 1).collect())
        if len(asked) <= PUSHED_GRAMS:
            asked = sorted(asked)
            parts = [r[0] for r in self.spark.createDataFrame([(g,) for g in asked], "gram string").select(_part(F.col("gram"))).distinct().collect()]
            postings = postings.where(F.col("gram_part").isin(parts) & F.col("gram").isin(asked))
        return sent, tiles, postings

    def _marked(self, sent: list[str], postings: DataFrame, counted: bool) -> DataFrame:
        """``segment, row, ns`` of the rows that one-tile texts hit, or ``area_rank, q, hits`` of parts of them."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = postings.select("segment", "base", "area_rank", "gram", "row_text_no").repartition(n, "segment", "base").sortWithinPartitions("segment", "base")
        return blocks.mapInArrow(_marks(sent, counted), "area_rank int, _n int, hits long" if counted else "segment string, row long, ns array<int>")

    def _named(self, numbered: DataFrame, sent: list[str]) -> DataFrame:
        named = self.spark.createDataFrame(list(enumerate(sent)), "n int, q string")
        return numbered.join(F.broadcast(named), F.col("_n") == F.col("n")).drop("_n", "n")

    def _several(self, tiles: DataFrame, postings: DataFrame) -> DataFrame:
        """``q, segment, row`` of the rows that texts of several tiles hit."""
        met = _opened(postings).join(tiles.where("n_tiles > 1").withColumnRenamed("gram", "g"), F.col("gram") == F.col("g"))
        return (met.groupBy("q", "n_tiles", "segment", "row", "text_no", (F.col("at") - F.col("offset")).alias("start"))
                .agg(F.count("*").alias("n")).where("n = n_tiles").select("q", "segment", "row").distinct())

    def _keys(self, sent: list[str] | None, tiles: DataFrame, postings: DataFrame) -> DataFrame:
        rows, keys = self.store.read(ROWS, self.version), ["q", "uploaded_at", *S.ROW_KEY]
        several = self._several(tiles, postings).join(rows, ["segment", "row"]).select(*keys)
        if sent is not None:
            one = self._marked(sent, postings, counted=False).join(rows, ["segment", "row"]).select(F.explode_outer("ns").alias("_n"), *keys[1:])
            return self._named(one, sent).select(*keys).unionByName(several)
        # a row's grams bring the queries they hold as lists, which meet in the row
        single = tiles.where("n_tiles = 1").groupBy(F.col("gram").alias("g")).agg(F.collect_set("q").alias("qs"))
        one = (_opened(postings).join(single, F.col("gram") == F.col("g")).groupBy("segment", "row")
               .agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs")))
        return one.join(rows, ["segment", "row"]).select(F.explode_outer("qs").alias("q"), *keys[1:]).unionByName(several)

    def hit_keys(self, queries: DataFrame) -> DataFrame:
        """Hits per query text (``q``, the row's key and upload time), from postings alone."""
        return self._keys(*self._asked(queries))

    def counts(self, queries: DataFrame) -> DataFrame:
        """Hits per query and area (J5): a block is of one area, so its task counts what one-tile texts hit."""
        sent, tiles, postings = self._asked(queries)
        if sent is None:
            return S.area_counts(self._keys(sent, tiles, postings), queries)
        one = self._named(self._marked(sent, postings, counted=True), sent)
        rows = self.store.read(ROWS, self.version).select("segment", "row", "area_rank")
        several = self._several(tiles, postings).join(rows, ["segment", "row"]).select("area_rank", F.lit(1).cast("bigint").alias("hits"), "q")
        return S.area_table(one.unionByName(several).groupBy("q", "area_rank").agg(F.sum("hits").alias("hits")), queries)

    def hits(self, queries: DataFrame, rows: DataFrame) -> DataFrame:
        """Every hit of every query with what it shows (U1): only the rows that hit are taken from ``rows``."""
        found = self.hit_keys(queries).drop("uploaded_at").join(rows.drop(*_TEXTS), S.ROW_KEY)
        return found.join(queries.select("query_id", F.lower("query_text").alias("q")), "q").select(*S.HIT_COLUMNS)
