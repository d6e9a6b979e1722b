"""Many-pattern substring matching without a nested-loop join.

``rows_containing(rows, texts, patterns)`` gives one output row per
(input row, pattern) pair where the pattern occurs in at least one of the
row's text columns.  Texts and patterns arrive already lower-cased (by
Spark's ``lower``), so both sides fold alike.  Everything is expressions and
equi-joins; the answer does not depend on which physical way is taken:

* a pattern table of at most ``LITERAL_MAX`` rows becomes one literal
  ``contains`` per pattern inside a single projection (no join, no exchange);
  at most ``LITERAL_MAX + 1`` rows are read to find that out;
* a larger table of up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` is
  sent to the tasks.  A text is met as its distinct words: a pattern is filed
  under the start of its longest run without white space, which must stand
  inside a word, and the words of a text repeat, so what a word holds is
  looked up once per task.  A pattern that is no more than that run is found
  by the word alone, any other is verified in the whole text;
* beyond that an inverted index stays on the cluster: each pattern is filed under one gram
  of up to ``GRAM`` characters, that which is rarest among the patterns.  The rows get a
  number and are written once to the shared folder; only (number, gram) pairs
  are shuffled, salted so that a gram which a third of all texts hold is no
  one task's work, and the candidate pairs fetch the text for the check.

In both ways no row carries its text along for each of its words or grams:
that would copy a text as often as it has words.

A NULL text holds nothing; a NULL or empty pattern matches nothing; a NULL
key is a key like any other; a pattern text under several keys gives each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.session import run_dir

# Up to this many patterns: literal expressions in the plan.
LITERAL_MAX = 64
# Characters of the gram a pattern is filed under (a shorter pattern is its own gram).
GRAM = 4
# The patterns are sent to every executor up to this size.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Parts of one gram's texts when the index is too large to send.
SALTS = 16
# Characters of the run a sent pattern is filed under, at most.
RUN = 8
# Words of up to ``KNOWN_CHARS`` characters whose patterns a task remembers, at most.
KNOWN_WORDS, KNOWN_CHARS = 1 << 18, 64
# Rows whose words, and words whose places, are looked up together.
ROWS_AT_ONCE, WORDS_AT_ONCE = 500, 1 << 16
# Rows times patterns that are marked in one table.
CELLS_AT_ONCE = 1 << 23
# Nodes times letters up to which a trie is a table.
TRIE_CELLS = 1 << 23


def contains_any(texts: list[str], pattern: Column) -> Column:
    """Whether the pattern occurs in one of the text columns (never NULL)."""
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(F.contains(F.col(t), pattern), F.lit(False))
    return found


def literal_matches(rows: DataFrame, texts: list[str], pairs: list[tuple], schema: T.StructType) -> DataFrame:
    """``rows`` plus the columns of ``schema`` for each pattern a row contains.

    ``pairs`` is a short list of ``(pattern, values)``; the values travel as
    literals in the plan, so no join brings them back.
    """
    fields = schema.fields
    hits = [F.when(contains_any(texts, F.lit(pattern)),
                   F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields)]))
            for pattern, values in pairs if pattern]
    if not hits:
        return rows.select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).where(F.lit(False))
    # outer explode + filter after it: an inner explode would make Catalyst
    # infer size(hits) > 0 below the projection and run every test twice
    found = (rows.select(*rows.columns, F.explode_outer(F.array_compact(F.array(*hits))).alias("_hit"))
             .where(F.col("_hit").isNotNull()))
    return found.select(*rows.columns, *[F.col(f"_hit.{f.name}").alias(f.name) for f in fields])


def grams(chars: Column, length: int) -> Column:
    """The substrings of ``length`` characters at every place (NULL near the end) of a
    text given as its characters.  ``chars`` is a column computed before: an
    expression would be evaluated anew for every place."""
    if length == 1:
        return chars
    return F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, length)]))


def _with_grams(rows: DataFrame, texts: list[str], lengths: list[int]) -> DataFrame:
    """One row per distinct gram ``_gram`` of a row's text columns, of the lengths that occur in the index."""
    split = rows.select(*rows.columns, *[F.split(F.coalesce(F.col(t), F.lit("")), "").alias(f"_chars{i}") for i, t in enumerate(texts)])
    every = F.concat(*[grams(F.col(f"_chars{i}"), n) for i in range(len(texts)) for n in lengths])
    arrays = split.select(*rows.columns, F.array_distinct(every).alias("_grams"))
    # outer, so that no filter on the array's size is inferred below, which
    # would make the array a second time; a NULL gram meets no pattern
    return arrays.select(*rows.columns, F.explode_outer("_grams").alias("_gram"))


def spans(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from ``starts[k]`` to ``starts[k + 1]`` of each ``k`` in ``of``, one after another, with the index in ``of``."""
    n = starts[of + 1] - starts[of]
    index = np.repeat(np.arange(len(of)), n)
    return index, np.arange(len(index)) + (starts[of] - np.cumsum(n) + n)[index]


def distinct_pairs(row: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers in order: from a table where they are dense in it, else sorted."""
    if n_rows * n_columns > 32 * len(row):
        return np.divmod(np.unique(row.astype(np.int64) * n_columns + column), max(1, n_columns))
    has = np.zeros((n_rows, n_columns), bool)
    has[row, column] = True
    return np.nonzero(has)


class Finder:
    """Numbers of the patterns, from 0, that occur in texts.

    The runs that patterns are filed under are a trie.  Words that are not known yet are
    walked through it together, all places of all words a character at a time.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        runs: dict[str, list[int]] = {}
        for n, p in enumerate(patterns):
            runs.setdefault(max(p.split(), key=len, default="")[:RUN], []).append(n)
        self.blank = tuple(runs.pop("", ()))
        # of each run: the pattern that is the run, and those that are longer
        self.own = np.array([next((n for n in ns if patterns[n] == r), -1) for r, ns in runs.items()], np.int32)
        self.longer = [tuple(n for n in ns if patterns[n] != r) for r, ns in runs.items()]
        self.has_longer = np.array([bool(ns) for ns in self.longer], bool)
        alphabet = sorted({c for r in runs for c in r})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letters = len(alphabet) + 1
        nodes: dict[str, int] = {"": 0}
        for r in runs:
            for k in range(1, len(r) + 1):
                nodes.setdefault(r[:k], len(nodes))
        steps = sorted((nodes[r[:-1]] * self.letters + int(self.letter[ord(r[-1])]), n) for r, n in nodes.items() if r)
        self.keys, self.next = np.array([x[0] for x in steps], np.int64), np.array([x[1] for x in steps], np.int32)
        self.ends = np.full(len(nodes), -1, np.int32)
        for k, r in enumerate(runs):
            self.ends[nodes[r]] = k
        self.table = None
        if len(nodes) * self.letters <= TRIE_CELLS:
            self.table = np.zeros(len(nodes) * self.letters, np.int32)
            self.table[self.keys] = self.next
        self._forget()

    def _forget(self) -> None:
        # the number of a known word, and from ``starts`` of its number the patterns that it holds;
        # of some words those that a text with it may hold
        self.known: dict[str, int] = {}
        self.starts, self.held = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.maybe: dict[str, list[int]] = {}

    def _runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word and run of all places at which a run stands."""
        lengths = np.array([len(w) for w in words], np.int32)
        letters = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word, end = np.repeat(np.arange(len(words), dtype=np.int32), lengths), np.cumsum(lengths, dtype=np.int32)
        at, node, found = np.arange(len(letters), dtype=np.int32), np.zeros(len(letters), np.int32), []
        left = np.repeat(end, lengths) - at  # characters from here to the word's end
        for k in range(RUN):
            if k:
                here = left > k
                at, node, left = at[here], node[here], left[here]
            letter = letters[at + k]
            if self.table is not None:
                node = self.table[node * self.letters + letter]
            elif len(self.keys):
                step = node.astype(np.int64) * self.letters + letter
                place = np.minimum(np.searchsorted(self.keys, step), len(self.keys) - 1)
                node = np.where(self.keys[place] == step, self.next[place], 0)
            here = node > 0
            at, node, left = at[here], node[here], left[here]
            run = self.ends[node]
            whole = run >= 0
            found.append((word[at[whole]], run[whole]))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))

    def _learn(self, words: list[str]) -> None:
        word, run = self._runs(words)
        own, more, p = self.own[run], self.has_longer[run], self.patterns
        longer = []
        for k, r in set(zip(word[more].tolist(), run[more].tolist())):
            longer += [(k, n) for n in self.longer[r] if p[n] in words[k]]
            if spaced := [n for n in self.longer[r] if [p[n]] != p[n].split()]:  # with white space
                self.maybe.setdefault(words[k], []).extend(spaced)
        longer = np.array(longer, np.int32).reshape(-1, 2)
        word, held = np.concatenate([word[own >= 0], longer[:, 0]]), np.concatenate([own[own >= 0], longer[:, 1]])
        first = len(self.starts) - 1
        self.known.update(zip(words, range(first, first + len(words))))
        self.held = np.concatenate([self.held, held[np.argsort(word, kind="stable")]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(word, minlength=len(words)))])

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The patterns that each text holds, some more than once: how many of each text, and all of them."""
        row, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        p = self.patterns
        for start in range(0, len(texts), WORDS_AT_ONCE):
            split = [t.split() for t in texts[start:start + WORDS_AT_ONCE]]
            if len(self.starts) > KNOWN_WORDS:
                self._forget()
            if new := list(set(chain.from_iterable(split)).difference(self.known)):
                self._learn(new)
            numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
            here, places = spans(self.starts, numbers)
            row.append(np.repeat(np.arange(start, start + len(split)), [len(words) for words in split])[here])
            held.append(self.held[places])
            if self.blank or self.maybe:
                more = [(k, n) for k, words in enumerate(split, start=start) for n in set(self.blank).union(*[self.maybe[w] for w in words if w in self.maybe]) if p[n] in texts[k]]
                more = np.array(more, np.int64).reshape(-1, 2)
                row.append(more[:, 0])
                held.append(more[:, 1].astype(np.int32))
            for w in new:
                if len(w) > KNOWN_CHARS:
                    self.known.pop(w, None)
                    self.maybe.pop(w, None)
        row, held = np.concatenate(row), np.concatenate(held)
        return np.bincount(row, minlength=len(texts)), held[np.argsort(row, kind="stable")]

    def find(self, rows: list[list[str]]) -> Iterator[np.ndarray]:
        """For each row the patterns that one of its texts holds."""
        p, known, maybe = self.patterns, self.known, self.maybe
        many = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // max(1, len(p))))
        for start in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[start:start + ROWS_AT_ONCE]
            split = [set(texts[0].split()) if len(texts) == 1 else {w for t in texts for w in t.split()} for texts in some]
            new = list(set().union(*split).difference(known))
            for k in range(0, len(new), WORDS_AT_ONCE):
                self._learn(new[k:k + WORDS_AT_ONCE])
            for k in range(0, len(some), many):
                part = split[k:k + many]
                numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(part)), np.int64)
                row = np.repeat(np.arange(len(part)), [len(words) for words in part])
                here, places = spans(self.starts, numbers)
                row, held = row[here], self.held[places]
                if self.blank or maybe:
                    more = [(i, n) for i, words in enumerate(part) for n in set(self.blank).union(*[maybe[w] for w in words if w in maybe])
                            if any(p[n] in t for t in some[k + i])]
                    more = np.array(more, np.int64).reshape(-1, 2)
                    row, held = np.concatenate([row, more[:, 0]]), np.concatenate([held, more[:, 1]])
                row, held = distinct_pairs(row, held, len(part), len(p))
                yield from np.split(held.astype(np.int32), np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
            if len(self.starts) > KNOWN_WORDS:
                self._forget()
                known, maybe = self.known, self.maybe
            for w in new:
                if len(w) > KNOWN_CHARS:
                    known.pop(w, None)
                    maybe.pop(w, None)


def finder(patterns: list[str]) -> Callable[[list[str]], list[str]]:
    """The patterns that occur in one of some texts, as a function of the texts."""
    many = Finder(patterns)
    return lambda texts: [patterns[n] for n in next(many.find([texts]))]


def found_numbers(texts: list[str], patterns: list[str]) -> Column:
    """The numbers, as places in ``patterns``, of those that occur in one of the text columns; the tasks hold the patterns."""
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        many = Finder(patterns)
        for batch in batches:
            yield pd.Series(list(many.find([[t for t in row if t] for row in zip(*(batch[c] for c in batch.columns))])), dtype=object)

    return F.pandas_udf(held, "array<int>")(F.struct(*[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)]))


class Patterns:
    """A pattern table resolved once and shared by every matching pass.

    Few patterns: ``literal``, the (pattern, key) pairs.  More: the written
    ``table (n, key)`` with ``texts``, its distinct patterns by their number ``n``.  Many: ``index``,
    the written table ``(gram, p, key)``, with the gram lengths that occur.
    """

    def __init__(self, patterns: DataFrame, pattern_col: str, key_col: str):
        spark = patterns.sparkSession
        self.key_col = key_col
        self.key_type = patterns.schema[key_col].dataType
        table = patterns.select(F.col(pattern_col).alias("p"), F.col(key_col).alias("k")).where("p <> ''")
        few = table.limit(LITERAL_MAX + 1).collect()
        self.literal = [(r.p, r.k) for r in few] if len(few) <= LITERAL_MAX else None
        if self.literal is not None:
            return
        path = run_dir(spark, "patterns")
        table.distinct().write.parquet(f"{path}/patterns")
        table = spark.read.parquet(f"{path}/patterns")
        n_rows, n_bytes = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("p"))).first()
        self.small = n_rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES
        if self.small:
            self.texts = sorted(r.p for r in table.select("p").distinct().collect())
            numbers = spark.createDataFrame(list(enumerate(self.texts)), "n int, p string")
            table.join(numbers, "p").select("n", F.col("k").alias(key_col)).write.parquet(f"{path}/numbers")
            self.table = spark.read.parquet(f"{path}/numbers")
            return
        own = (table.select("p", F.split("p", "").alias("chars")).distinct()
               .select("p", F.explode_outer(F.array_distinct(_by_length(F.col("chars")))).alias("gram")).where("gram is not null"))
        use = own.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
        filed = own.join(use, "gram").groupBy("p").agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram"))
        filed.join(table, "p").select("gram", "p", F.col("k").alias(key_col)).write.parquet(f"{path}/index")
        self.index = spark.read.parquet(f"{path}/index")
        self.lengths = sorted(self.index.agg(F.collect_set(F.char_length("gram"))).first()[0])


def _by_length(chars: Column) -> Column:
    """A pattern's grams of ``GRAM`` characters, or the whole of a shorter one."""
    found = F
    for k in range(1, GRAM):
        found = found.when(F.size(chars) == k, grams(chars, k))
    return found.otherwise(grams(chars, GRAM))


def _sent(rows: DataFrame, texts: list[str], patterns: Patterns) -> DataFrame:
    """Rows met with patterns that every task holds."""
    # outer, so that no filter on the array's size is inferred below, which
    # would make the array a second time; a NULL meets no pattern
    met = rows.select(*rows.columns, F.explode_outer(found_numbers(texts, patterns.texts)).alias("_n"))
    keys = patterns.table.select(F.col("n").alias("_found"), F.col(patterns.key_col).alias("_key"))
    return (met.join(F.broadcast(keys), F.col("_n") == F.col("_found"))
            .select(*rows.columns, F.col("_key").alias(patterns.key_col)))


def _indexed(rows: DataFrame, texts: list[str], patterns: Patterns) -> DataFrame:
    """Rows met with the patterns through the inverted index."""
    index = patterns.index.select(F.col("gram").alias("_gram"), F.col("p").alias("_p"), F.col(patterns.key_col).alias("_key"))
    keep = [*rows.columns, F.col("_key").alias(patterns.key_col)]
    spark = rows.sparkSession
    path = run_dir(spark, "numbered")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
    pairs = _with_grams(numbered.select("_row", *texts), texts, patterns.lengths).select("_row", salt.alias("_salt"), "_gram")
    salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    candidates = pairs.join(salted, ["_gram", "_salt"]).select("_row", "_p", "_key")
    return candidates.join(numbered, "_row").where(contains_any(texts, F.col("_p"))).select(*keep)


def rows_containing(rows: DataFrame, texts: list[str], patterns: DataFrame | Patterns,
                    pattern_col: str | None = None, key_col: str | None = None) -> DataFrame:
    """``rows`` plus the key of each pattern found in any of ``texts``.

    ``patterns`` is a table with a lower-cased ``pattern_col`` and a
    ``key_col`` (resolved here), or a ``Patterns`` resolved once for
    several passes.  A row matching one pattern in two of its texts, or a
    (pattern, key) row given twice, counts once.
    """
    if not isinstance(patterns, Patterns):
        patterns = Patterns(patterns, pattern_col, key_col)
    if patterns.literal is None:
        return (_sent if patterns.small else _indexed)(rows, texts, patterns)
    schema = T.StructType([T.StructField(patterns.key_col, patterns.key_type)])
    return literal_matches(rows, texts, [(p, (k,)) for p, k in dict.fromkeys(patterns.literal)], schema)
