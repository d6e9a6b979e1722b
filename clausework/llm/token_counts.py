"""Token counts as delta-maintained rollups (operator 6).

A change row says that a document's token count under one tokenizer
version was inserted, deleted or revised; ``before`` and ``after`` images
make its effect a signed delta, so totals by source, language and tokenizer
version are sums and no document is looked up.  A batch of changes is
reduced to one row per group (partial sums in every task, so a source with
a third of all documents is added up where it is read) and committed under
its batch id.

Commits are idempotent and atomic: a batch is written under an attempt's
name and renamed to its own folder when it is complete.  A batch that is
committed already is left as it is, so sending it again, by a retry or a
second driver, adds nothing, and an attempt that is lost half-way changes
nothing; of two attempts at once the first rename wins.

A change that is delivered twice within a batch counts once.  Changes may
carry an id (``change``), by which repeats are told; without one, rows equal
in all columns are one change, but rows without a document id never are, as
nothing says that they mean the same document.

Cases: a null text has no tokens; a null source or language is a group of
its own; rows that share a document id but differ in anything else are
changes of their own; empty batches commit an empty folder; a group whose
documents all went stays with total 0.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


KEYS = ["source", "lang", "tokenizer"]
CHANGES = "op string, seq long, doc_id long, source string, lang string, tokenizer string, before long, after long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_changes long"

# Counters by tokenizer version: words between white space; the same with
# every ASCII punctuation mark as a token of its own.
MARK = r"[!-/:-@\[-`{-~]"


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a whole text under a tokenizer version; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    if tokenizer == "words@1":
        return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    if tokenizer == "words@2":
        return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+|" + MARK)).cast("long")
    raise ValueError(f"no tokenizer {tokenizer}")


def delta_of(changes: DataFrame) -> DataFrame:
    """A batch's changes as one signed row per group."""
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    rows = changes.select(*columns, F.col("change").cast("string").alias("change") if "change" in changes.columns else F.lit(None).cast("string").alias("change"))
    once = (rows.where("change is not null").dropDuplicates(["change"])
            .unionByName(rows.where("change is null and doc_id is not null").dropDuplicates(columns))
            .unionByName(rows.where("change is null and doc_id is null")))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return once.groupBy(*KEYS).agg(
        F.sum(sign).cast("long").alias("n_docs"),
        F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("long").alias("n_tokens"),
        F.count("*").alias("n_changes"))


class Rollup:
    """Totals kept as the sum of the committed batches under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False when it was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        path, fs = self._fs()
        final = path(f"{self.path}/batch={batch_id}")
        if fs.exists(path(final, "_SUCCESS")):
            return False
        name = f"_attempt-{uuid.uuid4().hex}"
        attempt = path(f"{self.path}/{name}")
        delta_of(changes).write.parquet(attempt.toString())
        if not fs.exists(final) and fs.rename(attempt, final) and not fs.exists(path(final, name)):
            return True
        # another attempt was first: a rename may have put this one inside its folder
        fs.delete(attempt, True)
        fs.delete(path(final, name), True)
        return False

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        path, fs = self._fs()
        found = fs.globStatus(path(f"{self.path}/batch=*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().getName().removeprefix("batch=") for f in found)

    def totals(self) -> DataFrame:
        """Documents, tokens and changes by source, language and tokenizer version."""
        folders = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_changes")))


def inserts(docs: DataFrame, tokenizer: str, seq: int) -> DataFrame:
    n = count_tokens(F.col("text"), tokenizer)
    return _changes(docs, "insert", seq, tokenizer, F.lit(None), n)


def deletes(docs: DataFrame, tokenizer: str, seq: int) -> DataFrame:
    n = count_tokens(F.col("text"), tokenizer)
    return _changes(docs, "delete", seq, tokenizer, n, F.lit(None))


def revisions(docs: DataFrame, new_text: Column, tokenizer: str, seq: int) -> DataFrame:
    """Recounts of documents whose text became ``new_text``."""
    rows = _changes(docs, "revise", seq, tokenizer, count_tokens(F.col("text"), tokenizer), count_tokens(new_text, tokenizer))
    return rows.where("before <> after")


def _changes(docs: DataFrame, op: str, seq: int, tokenizer: str, before: Column, after: Column) -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "doc_id", "source", "lang",
                       F.lit(tokenizer).alias("tokenizer"), before.cast("long").alias("before"), after.cast("long").alias("after"))
