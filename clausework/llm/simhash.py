"""SimHash near-duplicates by BK-trees over shards of fingerprints (operator 3).

1. Every whole text becomes a 64-bit fingerprint of its word shingles.
2. Equal fingerprints are one vertex.  Two fingerprints at most ``max_bits``
   apart agree in at least one of ``max_bits + 1`` disjoint bit blocks, so
   each fingerprint goes to one shard per block, named by the block's bits.
   A shard over ``SHARD_ROWS`` is parted again by blocks of the bits it has
   left (no pair is lost, by the same argument); what is still too large
   after all levels is cut into slices whose pairs of slices are searched.
3. A shard's BK-tree is built in the task that holds the shard: a node's
   children are keyed by their integer Hamming distance to it, and a search
   follows only edges within ``max_bits`` of the query's distance.  All
   trees of a task are built and searched together, level by level.  The
   trees reach their queries through the shuffle and not by a driver
   broadcast, since fingerprints grow with the corpus.
4. A shard gives back a spanning forest of its links, at most one edge per
   row, never all pairs.  Components are found over those edges by large
   and small stars in rounds of joins, each round written to the shared
   folder.

Cases: a null text is an empty one; a text without words has fingerprint
zero and is linked like any other; rows with equal ids each give a row; an
empty table gives an empty table; a null id never is a component id while
its group has another (a group of null ids only has component null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.common import drop_written, text_key, written

SEED = 42
# Rows of a shard before it is parted further, and of a slice of one that can't be.
SHARD_ROWS = 2048
# Rows whose trees are built and searched together in one task, at least.
TASK_ROWS = 1 << 16
# Queries that walk the trees together.
WALKERS = 1024
# Bits of each of the max_bits + 1 blocks, by level; later levels block the bits left over.
BLOCK_BITS = (12, 10, 8)
# Bytes of a text whose words are held at once.
PIECE_BYTES = 4 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


# -- fingerprints ---------------------------------------------------------------------

def _word_runs(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """Words of a text in pieces, each led by the last ``overlap`` words before it."""
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    tail, start = [], 0
    while start < len(data):
        gap = _GAP.search(data, start + PIECE_BYTES)
        stop = gap.end() if gap else len(data)
        run = tail + data[start:stop].split()
        if stop == len(data) or len(run) > overlap:
            yield run
            tail = run[-overlap:] if overlap else []
        else:
            tail = run
        start = stop


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included, as a signed long."""
    import numpy as np
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    votes, n = np.zeros(64, np.int64), 0
    first = None
    for run in _word_runs(data, shingle - 1):
        if len(run) < shingle:
            first = run if first is None else first
            continue
        line = b" ".join(run)
        starts = np.zeros(len(run) + 1, np.int64)
        np.cumsum([len(w) + 1 for w in run], out=starts[1:])
        ends = (starts[shingle:] - 1).tolist()
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)
        for k in range(0, len(hashes), 8192):
            part = hashes[k:k + 8192]
            votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(hashes)
    if not n and first:
        n = 1
        votes += np.unpackbits(np.array([xxh64_intdigest(b" ".join(first), SEED)], np.uint64).view(np.uint8), bitorder="little")
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", out_col: str = "fingerprint",
                 shingle: int = 4) -> DataFrame:
    """``carry`` columns and the fingerprint (a signed long) of each whole text."""
    kept = [c for c in carry if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.LongType(), False)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(len(kept))
            prints = [fingerprint(column[i].as_py(), shingle) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*kept, out_col])

    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


# -- BK-trees -------------------------------------------------------------------------

def grow_trees(keys, prints, member):
    """BK-trees of all shards at once: ``(root row of each row, child rows)``.

    ``keys`` are sorted; a shard's first member is its root, and
    ``children[node, d]`` is the child at distance ``d`` or -1.
    """
    import numpy as np

    n = len(keys)
    children = np.full((n, 65), -1, np.int32)
    rows = np.flatnonzero(member)
    shard_first = np.full(n, -1, np.int64)
    uniq, first = np.unique(keys[rows], return_index=True)
    at = np.searchsorted(uniq, keys)
    at[at == len(uniq)] = 0
    shard_first = np.where(uniq[at] == keys, rows[first][at], -1) if len(uniq) else shard_first
    here = shard_first.copy()
    left = rows[here[rows] != rows]
    while len(left):
        distance = np.bitwise_count(prints[left] ^ prints[here[left]]).astype(np.int64)
        slot = here[left] * 65 + distance
        slots, first = np.unique(slot, return_index=True)
        children.reshape(-1)[slots] = left[first]
        here[left] = children.reshape(-1)[slot]
        left = left[here[left] != left]
    return shard_first, children


def shard_forest(keys, prints, member, query, max_bits: int):
    """A spanning forest of the links in each shard, as row pairs ``(row, root row)``."""
    import numpy as np

    n = len(keys)
    root, children = grow_trees(keys, prints, member)
    label = np.arange(n)
    walkers = np.flatnonzero(query & (root >= 0))
    reach = np.arange(-max_bits, max_bits + 1)
    for k in range(0, len(walkers), WALKERS):
        who = walkers[k:k + WALKERS]
        node = root[who]
        pairs = []
        while len(who):
            distance = np.bitwise_count(prints[who] ^ prints[node]).astype(np.int64)
            near = (distance <= max_bits) & (who != node)
            if near.any():
                pairs.append(np.stack([who[near], node[near]]))
            edge = distance[:, None] + reach
            child = np.where((edge >= 1) & (edge <= 64), children[node[:, None], np.clip(edge, 0, 64)], -1)
            row, col = np.nonzero(child >= 0)
            who, node = who[row], child[row, col].astype(np.int64)
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            while True:  # the smallest row of each group so far
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                label = label[label]
                if (label == before).all() and (label[a] == label[b]).all():
                    break
    while (label != label[label]).any():
        label = label[label]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _search(max_bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(rows):
            key, prints, side = rows
            if len(key):
                a, b = shard_forest(key, prints.view(np.uint64), side != 2, side != 1, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= TASK_ROWS:
                cut = np.searchsorted(held[0], held[0][-1])  # the last shard may go on
                yield from done([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from done(held)

    return run


# -- shards ---------------------------------------------------------------------------

def _blocks(key, rest, bits_left: int, width: int, max_bits: int):
    """A row's shards by the disjoint blocks of its remaining bits: structs of key and bits left."""
    out = []
    for b in range(max_bits + 1):
        off = b * width
        value = F.shiftrightunsigned(rest, off).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftrightunsigned(rest, off + width) if off + width < 64 else F.lit(0)
        below = rest.bitwiseAND(F.lit((1 << off) - 1))
        out.append(F.struct((key * (max_bits + 1 << width) + (b << width) + value).alias("key"),
                            F.shiftleft(above, off).bitwiseOR(below).alias("rest")))
    return F.array(*out)


def links(prints: DataFrame, col: str = "fingerprint", max_bits: int = 4) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints of the table whose
    components are those of all pairs at most ``max_bits`` bits apart."""
    spark = prints.sparkSession
    widths = [w for w in BLOCK_BITS if w * (max_bits + 1) <= 64] or [64 // (max_bits + 1)]
    left, rows = 64, prints.select(F.col(col).alias("fp"), F.lit(0).cast("long").alias("key"), F.col(col).alias("rest"))
    shards, temporary = None, []
    for level, width in enumerate(widths):
        if width * (max_bits + 1) > left:
            break
        rows = rows.select("fp", F.explode(_blocks(F.col("key"), F.col("rest"), left, width, max_bits)).alias("s")).select("fp", "s.*")
        left -= width
        large = written(rows.groupBy("key").count().where(F.col("count") > SHARD_ROWS), f"large-shards-{level}")
        temporary.append(large)
        small = rows.join(large, "key", "left_anti").select(F.lit(level).alias("level"), "key", "fp", F.lit(0).alias("side"))
        shards = small if shards is None else shards.unionByName(small)
        if large.isEmpty():
            rows = None
            break
        rows = rows.join(large, "key").select("fp", "key", "rest", "count")
    if rows is not None:
        # slices of what the blocks can't part: each pair of slices is a shard, side 1 its tree, side 2 its queries
        n = F.ceil(F.col("count") / SHARD_ROWS).cast("int")
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(
            F.xxhash64(F.col("key"), F.least(own, j), F.greatest(own, j)).alias("key"),
            F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))
        sliced = rows.select("fp", F.explode(pairs).alias("s")).select(F.lit(len(widths)).alias("level"), "s.key", "fp", "s.side")
        shards = shards.unionByName(sliced)
    # one integer per shard, so that a task's rows sort as the trees need them
    shards = shards.select(F.xxhash64("level", "key").alias("key"), "fp", F.col("side").cast("long").alias("side"))
    found = shards.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(_search(max_bits), "a long, b long")
    out = written(found.distinct(), "simhash-links")
    for t in temporary:
        drop_written(t)
    return out


# -- components -----------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex of the edges ``(a, b)``: the smallest vertex it can reach."""
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "stars")
    seen = None
    while True:
        # large star: a vertex's larger neighbours join its smallest one
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("v", "u")
        low = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m")), "lows")
        large = written(both.where("u > v").join(low, "v").where("u <> m").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct(), "stars")
        # small star: a vertex and its smaller neighbours join the smallest of them
        low2 = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "lows")
        small = large.join(low2, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(small.union(low2).distinct(), "stars")
        for t in (pairs, low, large, low2):
            drop_written(t)
        pairs = after
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return (pairs.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
            .union(pairs.select("lo", "lo").distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """``(id_col, text_key, fingerprint, component_id, class_print)`` for every row: a
    hash of the text, the signed fingerprint, the smallest id reachable over
    links, and the smallest fingerprint reachable, which names the class also
    where no row has an id."""
    keyed = docs.select(id_col, text_col, text_key(text_col).alias("text_key"))
    of_doc = written(fingerprints(keyed, [id_col, "text_key"], text_col, "fingerprint", shingle), "fingerprints")
    prints = written(of_doc.groupBy("fingerprint").agg(F.min(id_col).alias("first_id")), "distinct-fingerprints")
    edges = links(prints, "fingerprint", max_bits)
    reach = written(components(edges), "components")
    named = reach.join(prints, reach.vertex == prints.fingerprint).select("vertex", "root", "first_id")
    of_root = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = written(reach.join(of_root, "root").select(F.col("vertex").alias("fingerprint"), "component_id", "root"), "linked")
    drop_written(edges)
    classes = written(prints.join(linked.withColumn("_linked", F.lit(True)), "fingerprint", "left").select(
        "fingerprint", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"),
        F.coalesce("root", "fingerprint").alias("class_print")), "classes")
    for t in (reach, linked, prints):
        drop_written(t)
    return of_doc.join(classes, "fingerprint").select(id_col, "text_key", "fingerprint", "component_id", "class_print")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does.

    ``classes`` has ``id_col``, ``text_key`` and ``class_print`` of the rows.
    Of a class that row stays whose id, and at equal ids whose ``text_key``, is
    least; a null id stays where the class has no other.  Rows are told apart by
    id and text, so rows of different texts that share an id, or have none, are
    judged each by its own class; of rows equal in both one stays.
    """
    rows = classes.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "class_print")
    best = written(rows.groupBy("class_print").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))).alias("best"),
                                                   F.count("*").alias("n")), "class-leaders")
    gone = rows.join(best.where("n > 1"), "class_print").where(~(F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_key") == F.col("best.key")))).select("_id", "_key").distinct()
    # a text has one class, so rows equal in id and text stay or go together
    twice = written(rows.groupBy("_id", "_key").count().where("count > 1").select("_id", "_key"), "repeated-rows")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own_id"), text_key(text_col).alias("_own_key"))
    same = lambda t: F.col("_own_id").eqNullSafe(t["_id"]) & (F.col("_own_key") == t["_key"])
    kept = own.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, same(twice), "left_semi").dropDuplicates(["_own_id", "_own_key"])
        kept = kept.join(twice, same(twice), "left_anti").unionByName(again)
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
