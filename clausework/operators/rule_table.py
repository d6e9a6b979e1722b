"""Rules as data (R1, R2): thousands of keyword rules in one pass.

A rule holds for a document that has every keyword of ``every``, one at least
of ``some`` (where there are any) and none of ``none``; keywords are found as
everywhere here, as substrings of the lowered text.  The distinct keywords of
all rules are numbered and matched once (``operators.matching``), and what a
document has becomes a bitmap.  A rule is a few words of that bitmap, so it is
decided by bit operations and never by its texts.

Up to ``SENT_RULES`` rules travel to the tasks.  A document's keywords are numbers
that leave the task of its text, rows of one document meet over these numbers alone,
and for some documents at once all rules are decided by counts: of each rule's
keywords the document has so many of every list.  Only the rules that hold become rows.

More rules stay on the cluster.  A rule that needs a keyword is asked only where the document has it: rules
are filed under one keyword of ``every``, or each of ``some``, and met through
the hits.  Rules that only forbid hold for most documents; they are decided
in the document's row against the list of their bitmaps, at most
``FORBIDDING_RULES`` of them.

Cases: NULL and empty texts have no keyword; empty and NULL keywords are
left out of a list, and a rule whose lists are then all empty holds for every
document; rules that repeat an id hold when one of them does.  ``id_col`` names a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.matching import found_numbers, rows_containing, spans
from clausework.operators.sheets import numbered
from clausework.session import run_dir

LISTS = ("every", "some", "none")
FORBIDDING_RULES = 100_000
# Rules, their keywords and the bytes of both up to which they are sent to the tasks.
SENT_RULES, SENT_KEYWORDS, SENT_BYTES = 100_000, 1_000_000, 32 << 20
# Documents times rules that are decided at once.
CELLS_AT_ONCE = 1 << 20
_WORDS = "array<struct<word:int,bits:bigint>>"


def _bits(numbers: Column) -> Column:
    """Keyword numbers as the words of a bitmap that are not zero."""
    bit = lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (k % 64).cast("int")))
    words = F.array_distinct(F.transform(numbers, lambda k: F.floor(k / 64).cast("int")))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.aggregate(
        F.filter(numbers, lambda k: F.floor(k / 64).cast("int") == w), F.lit(0).cast("bigint"), bit).alias("bits")))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Decider:
    """Which of some rules, each three lists of keyword numbers below ``n_keywords``, hold."""

    def __init__(self, rules: list[tuple[list[int], list[int], list[int]]], n_keywords: int):
        self.n_rules, self.n_keywords = len(rules), n_keywords
        self.needed = [np.array([len(r[c]) for r in rules], np.int64) for c in range(3)]
        # of a keyword the rules that have it in a list
        self.filed = []
        for c in range(3):
            keyword = np.array([k for r in rules for k in r[c]], np.int64)
            rule = np.repeat(np.arange(len(rules)), self.needed[c])
            starts = np.concatenate([[0], np.cumsum(np.bincount(keyword, minlength=n_keywords))])
            self.filed.append((starts, rule[np.argsort(keyword, kind="stable")]))

    def holding(self, docs: list) -> Iterator[np.ndarray]:
        """For each document, given as its keywords' numbers, the rules that hold."""
        many = max(1, CELLS_AT_ONCE // max(1, self.n_rules, self.n_keywords))
        for k in range(0, len(docs), many):
            some = docs[k:k + many]
            has = np.zeros((len(some), self.n_keywords), bool)
            for i, numbers in enumerate(some):
                has[i, numbers] = True
            doc, keyword = np.nonzero(has)
            counts = []
            for starts, rules in self.filed:
                here, places = spans(starts, keyword)
                counts.append(np.bincount(doc[here] * self.n_rules + rules[places], minlength=len(some) * self.n_rules).reshape(len(some), self.n_rules))
            holds = (counts[0] == self.needed[0]) & ((counts[1] > 0) | (self.needed[1] == 0)) & (counts[2] == 0)
            doc, rule = np.nonzero(holds)
            yield from np.split(rule, np.cumsum(np.bincount(doc, minlength=len(some)))[:-1])


def _sent(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rules that hold, by tasks that have them all."""
    rows = rules.select("rule_id", *LISTS).collect()
    keywords = list(dict.fromkeys(k for r in rows for c in LISTS for k in r[c]))
    ids = list(dict.fromkeys(r.rule_id for r in rows))
    number, name = {k: n for n, k in enumerate(keywords)}, {x: n for n, x in enumerate(ids)}
    lists = [tuple([number[k] for k in r[c]] for c in LISTS) for r in rows]
    named = np.array([name[r.rule_id] for r in rows], np.int32)
    repeated = len(ids) < len(rows)

    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decider = Decider(lists, len(keywords))
        for batch in batches:
            found = (named[rule] for rule in decider.holding(list(batch)))
            yield pd.Series([np.unique(x) if repeated else x for x in found], dtype=object)

    lowered = docs.select(F.col(id_col).alias("doc"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    found = lowered.select("doc", found_numbers(["t"], keywords).alias("ks")) if keywords else lowered.select("doc", F.array().cast("array<int>").alias("ks"))
    # rows of one document meet; what has no id has no keyword
    found = found.groupBy("doc").agg(F.flatten(F.collect_list(F.when(F.col("doc").isNotNull(), F.col("ks")))).alias("ks"))
    rule = F.explode_outer(F.pandas_udf(held, "array<int>")(F.col("ks"))).alias("n")
    named_ids = docs.sparkSession.createDataFrame(list(enumerate(ids)), rules.select(F.lit(0).alias("id_n"), "rule_id").schema)
    return found.select("doc", rule).join(F.broadcast(named_ids), F.col("n") == F.col("id_n")).select(F.col("doc").alias(id_col), "rule_id")


def evaluate(docs: DataFrame, rules: DataFrame, id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
    """``id_col, rule_id`` for each rule (``rule_id, every, some, none``) that holds for a document."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower), lambda k: k.isNotNull() & (k != "")))
    rules = _written(rules.select("rule_id", *(clean(c).alias(c) for c in LISTS)).withColumn("rule", F.monotonically_increasing_id()), "rules")
    keywords = sum(F.size(c) for c in LISTS)
    letters = F.octet_length(F.concat_ws("", F.col("rule_id").cast("string"), *LISTS))
    n, n_keywords, n_bytes = rules.agg(F.count("*"), F.sum(keywords), F.sum(letters)).first()
    small = n <= SENT_RULES and (n_keywords or 0) <= SENT_KEYWORDS and (n_bytes or 0) <= SENT_BYTES
    return (_sent if small else _met)(docs, rules, id_col, text_col)


def _met(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rules that hold, by joins with them."""
    asked = rules.select("rule", *(F.col(c) for c in LISTS))
    uses = None
    for c in LISTS:
        one = asked.select("rule", F.lit(c).alias("list"), F.explode(c).alias("keyword"))
        uses = one if uses is None else uses.unionByName(one)
    keywords = _written(numbered(uses.select("keyword").distinct(), ["keyword"]).select("keyword", (F.col("number") - 1).alias("k")), "rule-keywords")
    masks = uses.join(keywords, "keyword").groupBy("rule").agg(*(F.sort_array(F.collect_list(F.when(F.col("list") == c, F.col("k")))).alias(f"k_{c}") for c in LISTS))
    none = F.array().cast("array<bigint>")
    rules = rules.select("rule", "rule_id").join(masks, "rule", "left").select("rule", "rule_id", *(F.coalesce(f"k_{c}", none).alias(f"k_{c}") for c in LISTS))
    rules = _written(rules.select("*", *(_bits(F.col(f"k_{c}")).alias(c) for c in LISTS)), "rule-masks")
    n_words = keywords.agg(F.coalesce(F.floor(F.max("k") / 64) + 1, F.lit(1)).cast("int")).first()[0]

    lowered = docs.select(F.col(id_col).alias("doc"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    hits = _written(rows_containing(lowered, ["t"], keywords, "keyword", "k").select("doc", "k").distinct(), "rule-hits")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("k") % 64).cast("int"))
    words = hits.groupBy("doc", F.floor(F.col("k") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    sparse = words.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("has"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: F.coalesce(F.col("has")[w], F.lit(0).cast("bigint")))
    maps = _written(sparse.select("doc", dense.alias("map")), "rule-bitmaps")

    has = lambda m: F.get("map", m["word"]).bitwiseAND(m["bits"])
    free = lambda none: F.forall(none, lambda m: has(m) == 0)
    needs = F.size("k_every") + F.size("k_some") > 0
    filed = rules.where(needs).select("rule_id", *LISTS, F.explode(F.when(F.size("k_every") > 0, F.slice("k_every", 1, 1)).otherwise(F.col("k_some"))).alias("k"))
    met = hits.join(filed, "k").join(maps, "doc")
    held = met.where(F.forall("every", lambda m: has(m) == m["bits"]) & ((F.size("some") == 0) | F.exists("some", lambda m: has(m) != 0)) & free("none")).select("doc", "rule_id")

    forbidding = rules.where(~needs).select("rule_id", "none").limit(FORBIDDING_RULES + 1).collect()
    if len(forbidding) > FORBIDDING_RULES:
        raise ValueError(f"more than {FORBIDDING_RULES} rules that only forbid")
    listed = F.from_json(F.lit(json.dumps([{"rule_id": r.rule_id, "none": [m.asDict() for m in r.none]} for r in forbidding])), f"array<struct<rule_id:string,none:{_WORDS}>>")
    zero = F.array_repeat(F.lit(0).cast("bigint"), n_words)
    every = docs.select(F.col(id_col).alias("doc")).distinct().join(maps, "doc", "left").select("doc", F.coalesce("map", zero).alias("map"))
    left = every.select("doc", F.explode(F.transform(F.filter(listed, lambda r: free(r["none"])), lambda r: r["rule_id"])).alias("rule_id"))
    return held.unionByName(left).distinct().select(F.col("doc").alias(id_col), "rule_id")
