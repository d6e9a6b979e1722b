"""Interaction audit of five document filters (operator 12).

A text fails ``A`` with under 200 words, ``B`` when its distinct words are
under half of its words, ``C`` when over 3 % of its characters are A-Z,
``D`` when it holds one of ``#$%&*|``, ``E`` when a smaller document id has
the identical text.  For every order of the five filters and every step the
audit says what that filter removes, what of its failures was gone before,
what it alone would have caught, and what good and toxic documents go.

Duplicates are found with radix tries over the full texts.  A task inserts
the texts of a block of its input into a compressed trie, whose terminals
hold the least id, so a text that a block holds many times leaves it once.
The distinct texts of all blocks are then dealt out by adaptive prefixes: a
prefix under which more bytes lie than a partition's share is split into
longer ones, until each weighs less or is a whole text, and the prefixes are
partitioned by range.  A partition inserts its texts into one trie whose
terminals end up with the least id of all.  A whole text that weighs too much
(a third of all blocks may hold it) is merged in salted groups of at least
``FAN_IN`` copies first, and the survivors again.  Only a terminal's number
and least id go back to the documents.

The five failures of a document are one mask.  Masks are counted by part in
the tasks, so all 600 (order, step) rows of a part follow from 32 counters.

Cases: a null text is an empty one (an empty text fails A only, and E where
a smaller id has none either); a null part is the empty string; a document
with a null id is removed by E when any id has its text, and is never the
smaller one; equal ids are not smaller than each other; a text of any length
is one text; a document that ``labels`` names several times is good or toxic
when any of its rows says so, one without labels neither; an empty table
gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import written

FILTERS = "ABCDE"
# Fixed values of the contract.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Text bytes that one task's trie takes before it hands on its terminals.
BLOCK_BYTES = 16 << 20
# Bytes of distinct text that a range partition should hold at most.
RANGE_BYTES = 32 << 20
# Copies of one text that are merged by one task at least.
FAN_IN = 64
FIRST_PREFIX, LONGER = 4, 4
# Bytes of too heavy prefixes of a level that are sent to every executor at most.
BROADCAST_BYTES = 8 << 20


class TextTrie:
    """A compressed trie of whole texts.  A node is ``[edge label, children by
    first character, terminal]``; terminals are numbered from 0 and hold the
    least id inserted there (None while only null ids were)."""

    def __init__(self):
        self.root: list = ["", {}, -1]
        self.least: list[int | None] = []

    def insert(self, text: str, doc_id: int | None) -> int:
        """The terminal of ``text``, its least id brought up to date."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, -1]
                node[1][text[at]] = child
            elif not text.startswith(child[0], at):
                k = _common(child[0], text, at)
                fork = [child[0][:k], {child[0][k]: child}, -1]
                child[0] = child[0][k:]
                node[1][text[at]] = fork
                child = fork
            node = child
            at += len(node[0])
        if node[2] < 0:
            node[2] = len(self.least)
            self.least.append(doc_id)
        elif doc_id is not None and (self.least[node[2]] is None or doc_id < self.least[node[2]]):
            self.least[node[2]] = doc_id
        return node[2]


def _common(label: str, text: str, at: int) -> int:
    """How many characters of ``label`` stand in ``text`` at ``at``."""
    low, high = 0, len(label)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def own_failures(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes part at the ASCII white space
    n = len(words)
    return ((n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
            | (100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)) << 2
            | (len(data) != len(data.translate(None, MARKS))) << 3)


_BLOCK = "doc_id bigint, part string, fails int, term bigint, text string, least bigint"


def _blocks(docs: DataFrame, id_col: str, text_col: str, part_col: str, block_bytes: int) -> DataFrame:
    """Every document with its own failures and its text's terminal ``term``
    in the block's trie; the first of a terminal carries text and least id."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("term", pa.int64()),
                            ("text", pa.string()), ("least", pa.int64())])
        base = TaskContext.get().partitionId() << 33
        trie, rows, held = TextTrie(), [], 0

        def done():
            nonlocal trie, rows, held, base
            out, carried = [], set()
            for doc, part, fails, t, text in rows:
                first = text is not None and t not in carried
                carried.add(t)
                out.append((doc, part, fails, base + t, text if first else None, trie.least[t] if first else None))
            base += len(trie.least)
            trie, rows, held = TextTrie(), [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            ids, texts, parts = batch.columns
            for i in range(batch.num_rows):
                doc, text = ids[i].as_py(), texts[i].as_py() or ""
                seen = len(trie.least)
                t = trie.insert(text, doc)
                new = t == seen
                rows.append((doc, parts[i].as_py() or "", own_failures(text), t, text if new else None))
                held += len(text) if new else 64
                if held >= block_bytes:
                    yield done()
        if rows:
            yield done()

    read = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(part_col).cast("string").alias("p"))
    return read.mapInArrow(run, _BLOCK)


def _prefix_keys(entries: DataFrame, share: int) -> tuple[DataFrame, bool]:
    """``entries`` with ``key``, a prefix of the text under which at most
    ``share`` bytes lie, or the whole text, and ``salts``, the groups in which
    the copies of a too heavy whole text are merged; and whether there is one.

    A key shorter than its level's length is a whole text.  Only keys that
    are too heavy reach the driver, at most the table's bytes over ``share`` a
    level; they are broadcast while their own bytes are within a bound.
    """
    spark = entries.sparkSession
    weight = F.octet_length("text") + 16
    length, whole = FIRST_PREFIX, False
    keyed = entries.withColumns({"key": F.substring("text", 1, length), "salts": F.lit(1), "open": F.lit(True)})
    while True:
        heavy = (keyed.where("open").groupBy("key").agg(F.sum(weight).alias("bytes"), F.count("*").alias("n"))
                 .where(F.col("bytes") > share).collect())
        if not heavy:
            return keyed.drop("open"), whole
        groups = [(r.key, 0 if len(r.key) == length else max(1, min(-(-r.bytes // share), -(-r.n // FAN_IN)))) for r in heavy]
        whole = whole or any(n > 1 for _, n in groups)
        table = spark.createDataFrame(groups, "heavy string, groups int")
        if sum(4 * len(k) + 32 for k, _ in groups) <= BROADCAST_BYTES:
            table = F.broadcast(table)  # the texts stay where they are
        length *= LONGER
        met = keyed.join(table, F.col("open") & (F.col("key") == F.col("heavy")), "left")
        split = F.coalesce(F.col("groups") == 0, F.lit(False))
        keyed = met.select(*entries.columns, F.when(split, F.substring("text", 1, length)).otherwise(F.col("key")).alias("key"),
                           F.greatest(F.col("salts"), F.coalesce("groups", F.lit(0))).alias("salts"), split.alias("open"))


def _merged(entries: DataFrame, share_bytes: int) -> DataFrame:
    """``term`` and ``least``: the least id of each entry's text over all ``entries`` (``term, text, least``)."""
    spark = entries.sparkSession
    total = entries.agg(F.sum(F.octet_length("text") + 16), F.count("*")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // share_bytes))
    keyed, whole = _prefix_keys(entries, max(1, (total[0] or 0) // n))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("term"), F.col("salts"))).otherwise(F.lit(0))
    dealt = keyed.withColumn("salt", salt).repartitionByRange(n, "key", "salt").select("term", "text", "least", F.col("salts") > 1)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("term", pa.int64()), ("rep", pa.int64()), ("text", pa.string()), ("least", pa.int64())])
        trie, rows, rep, kept = TextTrie(), [], [], {}
        for batch in batches:
            terms, texts, ids, split = batch.columns
            for i in range(batch.num_rows):
                term, text = terms[i].as_py(), texts[i].as_py()
                t = trie.insert(text, ids[i].as_py())
                if t == len(rep):
                    rep.append(term)
                    if split[i].as_py():
                        kept[t] = text
                rep[t] = min(rep[t], term)
                rows.append((term, t))
        for k in range(0, len(rows), 65536):
            part = rows[k:k + 65536]
            cols = ([term for term, _ in part], [rep[t] for _, t in part], [kept.get(t) if rep[t] == term else None for term, t in part], [trie.least[t] for _, t in part])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    found = dealt.mapInArrow(run, "term bigint, rep bigint, text string, least bigint")
    if not whole:
        return found.select("term", "least")
    # texts merged in groups: their survivors, at least FAN_IN times fewer or one, are merged again
    found = written(found, "merged-texts")
    again = _merged(found.where("text is not null").select("term", "text", "least"), share_bytes)
    again = again.select(F.col("term").alias("of"), F.col("least").alias("all"))
    return found.join(again, F.col("rep") == F.col("of"), "left").select("term", F.when(F.col("of").isNotNull(), F.col("all")).otherwise(F.col("least")).alias("least"))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", block_bytes: int = BLOCK_BYTES,
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (bit k: fails the k-th of ``FILTERS``) of every row."""
    rows = written(_blocks(docs, id_col, text_col, part_col, block_bytes), "audit-blocks")
    least = written(_merged(rows.where("text is not null").select("term", "text", "least"), range_bytes), "audit-least")
    repeated = F.when(F.col("doc_id").isNull(), F.col("least").isNotNull()).otherwise(F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    return rows.select("doc_id", "part", "fails", "term").join(least, "term").select(
        "doc_id", "part", (F.col("fails") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def steps() -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of its filter, bits of the filters before)`` of all 600 steps."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), k + 1, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id",
          good_col: str = "quality", toxic_col: str = "toxic", **limits) -> DataFrame:
    """The audit's rows: 600 for each part."""
    said = labels.groupBy(F.col(label_id).cast("long").alias("label_id")).agg(
        F.coalesce(F.max((F.col(good_col) == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col(toxic_col) == 1).cast("int")), F.lit(0)).alias("toxic"))
    found = masks(docs, id_col, text_col, part_col, **limits)
    found = found.join(said, found["doc_id"] == said["label_id"], "left")
    counted = found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
                                                F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))
    counts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    step = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "gone"), x)) for x in steps()])),
                       "array<struct<filter_order:string,step:int,bit:int,gone:int>>")
    rows = counts.select("part", "masks", F.explode(step).alias("s")).select("part", "masks", "s.*")

    def total(count: str, holds) -> Column:
        """The sum of a counter over the masks that ``holds`` is true of."""
        return F.aggregate(F.filter("masks", lambda m: holds(m["mask"])), F.lit(0).cast("long"), lambda a, m: a + m[count])

    bit, gone = F.col("bit"), F.col("gone")
    fails = lambda m: m.bitwiseAND(bit) != 0
    stays = lambda m: m.bitwiseAND(gone) == 0
    first = lambda m: fails(m) & stays(m)
    # in how many of the orders a filter comes before the others that a document fails
    first_in = F.aggregate(F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("long"),
                           lambda a, m: a + m["n"] * F.floor(F.lit(120) / F.bit_count(m["mask"])))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: stays(m) & ~fails(m)).alias("kept"), total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & ~stays(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", first).alias("good_lost"), total("toxic", first).alias("toxic_lost"), first_in.cast("long").alias("shapley"))


__all__ = ["TextTrie", "audit", "masks", "own_failures", "steps"]
