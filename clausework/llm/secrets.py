"""Secret scans with a random forest for false positives (operator 5, native).

Candidates are runs of 16 or more key characters (several joined by dots are
one), and every value assigned to a name such as ``password``, whatever its
length and characters, up to its closing quote or white space.  Each has
features: its length, the transitions between character classes, the shares
of digits, capitals and distinct characters, how much of it dictionary words
cover, whether it stands in a path or address, and what its neighbouring
words say.  A random forest trained from labelled findings decides which
candidates are secrets.

Labelled findings may be given.  Where none are, ``label_findings`` labels
those candidates whose surroundings leave no doubt: assigned to a name such
as ``token`` and no word (a secret); digits only, in a URL or path, named as a
checksum or number, or mostly dictionary words (not one).  The forest learns
each labelled finding twice, once with its neighbours hidden, so that it
also judges candidates by their own look; it judges all candidates.  It is
fitted on at most ``TRAIN_ROWS`` findings chosen by a hash.

Only expressions, joins and Spark's own forest are used, no Python on the
executors.

Cases: null and empty texts hold no candidate; a candidate of any length is
one candidate; each row of a repeated document reports its findings; when
the labelled findings lack one of the classes there is nothing to learn and
the label rule decides; an empty table gives an empty table.  Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.common import bounded_sample, written

TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 6, 7
CONTEXT = 80
LABEL = "[SECRET]"

KEY = r"[A-Za-z0-9+/_-]"
SECRET_NAMES = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|key)s?"
OTHER_NAMES = r"(?:sha1|sha256|sha|md5|etag|checksum|digest|hash|commit|revision|uuid|guid|isbn|order|invoice|phone|card|number|no|id|version)s?"

# What a secret's name and an assignment look like, the identifier that ends in the name
# and an opening quote included, and the value that follows.
NAMED = rf"(?<![A-Za-z])(?i:{SECRET_NAMES})[\"'`]?[\x20\t]*(?:=>|:=|=|:)"
ASSIGN = rf"(?:(?<!{KEY}){KEY}*?)?{NAMED}[\x20\t]*[\"'`]?"
VALUE = (r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)|"
         r"[^\s\"'`]+?(?=&[A-Za-z0-9_.-]++=|[\s\"'`]|$|(?<![.,;)\]}>])[.,;)\]}>]++(?:[\s\"'`]|$)))")
RUN = rf"(?<!{KEY})(?=[+/_-]*+[A-Za-z0-9]){KEY}{{16,}}+(?:\.(?!{KEY}*?{NAMED}){KEY}{{16,}}+)*+={{0,2}}"
# Group 1 is what stands before an assigned value; a candidate is the match without it.
CANDIDATE = rf"({ASSIGN})(?!//){VALUE}|{RUN}"

OWN = ["length", "transitions", "digits", "capitals", "distinct", "vowels", "covered", "hex_only", "digits_only", "slashes", "dashes"]
AROUND = ["named_secret", "named_other", "assigned", "quoted", "in_path", "address", "word_before", "prose"]


def _matched(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``found``, the candidates of the text, and ``gaps`` around them: gap, candidate, gap, ..., candidate, gap.
    Each expression over the text is a column of its own, so that it runs once."""
    names = [c for c in rows.columns]
    rows = rows.select(*names, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)).alias("_heads"),
                       F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_whole"), F.split(text, CANDIDATE, -1).alias("_split"))
    found = F.zip_with("_whole", "_heads", lambda w, h: w.substr(F.length(h) + 1, F.length(w)))
    gaps = F.zip_with("_split", "_heads", lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    return rows.select(*names, found.alias("found"), gaps.alias("gaps"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key`` (a hash of the text), ``start`` (code points before it), ``candidate``,
    ``before`` and ``after`` of every candidate; ``k`` numbers those of a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # an assignment has one of these marks, any other candidate a long run
    might = F.contains("t", F.lit("=")) | F.contains("t", F.lit(":")) | F.col("t").rlike(f"{KEY}{{16}}")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).where(might).where(F.col("t").rlike(CANDIDATE))
    found = _matched(rows.select("id", F.xxhash64("t").alias("text_key"), F.monotonically_increasing_id().alias("row"), "t"), "t").select(
        "id", "text_key", "row", F.col("found").alias("c"), "gaps")
    each = F.transform("c", lambda c, i: F.struct(c.alias("candidate"), F.length(F.get("gaps", i)).alias("gap"),
                                                  F.expr("1").alias("one"), F.get("gaps", i).substr(F.greatest(F.length(F.get("gaps", i)) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("before"),
                                                  F.get("gaps", i + 1).substr(F.lit(1), F.lit(CONTEXT)).alias("after")))
    rows = found.select("id", "text_key", "row", F.posexplode(each).alias("k", "s")).select("id", "text_key", "row", "k", "s.candidate", "s.gap", "s.before", "s.after")
    upto = Window.partitionBy("row").orderBy("k")
    return rows.select("id", "text_key", "row", "k", (F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")).alias("start"), "candidate", "before", "after")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def _flag(c: Column) -> Column:
    return c.cast("double")


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The candidates with their features.  ``dictionary`` (``word``) is a fixed
    word list and is broadcast; the caller bounds it."""
    runs = (found.select("row", "k", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
            .join(F.broadcast(dictionary.select("word").distinct()), "word").groupBy("row", "k").agg(F.sum(F.length("word")).alias("covered_chars")))
    b, a = F.lower("before"), F.lower("after")
    link = r"[\s\"'`=:(\[{<>-]*$"
    out = found.join(runs, ["row", "k"], "left").withColumns({
        "length": F.length("candidate").cast("double"),
        "transitions": _share(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "digits": _share("[0-9]"), "capitals": _share("[A-Z]"), "vowels": _share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "covered": F.coalesce("covered_chars", F.lit(0)) / F.length("candidate"),
        "hex_only": _flag(F.col("candidate").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "digits_only": _flag(F.col("candidate").rlike("^[0-9=/+_-]+$")),
        "slashes": _share("/"), "dashes": _share("[_-]"),
        "named_secret": _flag(b.rlike(rf"(?<![a-z]){SECRET_NAMES}{link}")), "named_other": _flag(b.rlike(rf"(?<![a-z]){OTHER_NAMES}{link}")),
        "assigned": _flag(b.rlike(r"(?:=|:|=>|:=)\s*[\"'`]?$")), "quoted": _flag(b.rlike(r"[\"'`]$") & a.rlike(r"^[\"'`]")),
        "in_path": _flag(b.rlike(r"(?:[a-z]+://|www\.|[/\\])\S*$") | F.col("candidate").rlike("/.*/")),
        "address": _flag(b.rlike(r"[@.]$") | a.rlike(r"^[@]|^\.[a-z]")),
        "word_before": F.length(F.regexp_extract(b, r"([a-z]+)[^a-z]*$", 1)).cast("double"),
        # a word after a colon, or words between quotes
        "prose": _flag((b.rlike(r":\s+$") & F.col("candidate").rlike(r"^\(?[A-Za-z]?[a-z]*[!?:]*$")) | F.col("candidate").rlike(r"\s"))})
    return out.drop("covered_chars")


def label_rule() -> tuple[Column, Column]:
    """When a candidate is a secret, and when not one, beyond doubt."""
    c = F.col
    looks = (c("length") >= 16) | (c("length") >= 8) & ((c("digits") > 0) | (c("transitions") > 0) | c("candidate").rlike(r"[^A-Za-z]"))
    sure = (c("named_secret") == 1) & (c("assigned") == 1) & (c("digits_only") == 0) & (c("covered") < 0.8) & (c("prose") == 0) & looks
    never = (c("digits_only") == 1) | (c("in_path") == 1) | (c("named_other") == 1) | (c("covered") >= 0.8) | (c("address") == 1) | (c("prose") == 1)
    return sure, never


def label_findings(featured: DataFrame) -> DataFrame:
    """The candidates that the label rule is certain of, with ``label`` 1.0 or 0.0."""
    sure, never = label_rule()
    return featured.withColumn("label", F.when(sure, 1.0).when(never, 0.0)).where("label is not null")


def scan(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
         train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id_col, text_key, k, start, length, candidate, score, is_secret`` for every candidate.

    ``labelled`` has the feature columns, ``candidate`` and ``label``.  The forest
    decides over every candidate, those included that it was trained on.
    """
    found = written(features(written(candidates(docs, id_col, text_col), "candidates"), dictionary), "featured")
    labelled = label_findings(found) if labelled is None else labelled
    inputs = [*OWN, *AROUND]
    labelled = labelled.select("candidate", "label", *inputs)
    chosen = bounded_sample(labelled, labelled.count(), train_rows, ["candidate", "label", *inputs])
    hidden = chosen.select("candidate", "label", *OWN, *(F.lit(0.0).alias(c) for c in AROUND))
    train = written(chosen.unionByName(hidden).orderBy("candidate", "label", *inputs).coalesce(1), "labelled-findings")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    if classes == {0.0, 1.0}:
        vector = VectorAssembler(inputCols=inputs, outputCol="x")
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(vector.transform(train))
        scored = model.transform(vector.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.when(label_rule()[0], 1.0).otherwise(0.0))
    return scored.select(F.col("id").alias(id_col), "text_key", "k", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"),
                         "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret of a text replaced by a label, wherever it is a candidate there.

    Findings meet their text by id and text hash, so rows that share an id,
    or have none, are each cleaned by their own findings, and no group is
    larger than one text's candidates.
    """
    each = findings.groupBy(F.col(id_col).alias("id"), "text_key", "candidate").agg(
        F.max("is_secret").alias("secret"), F.collect_set("k").alias("ks"))
    marks = (each.select("id", "text_key", "secret", F.explode("ks").alias("k")).groupBy("id", "text_key")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "secret"))), lambda x: x["secret"]).alias("marks"),
                  F.max("secret").alias("any")).where("any").select(F.col("id").alias("mark_id"), F.col("text_key").alias("mark_key"), "marks"))
    text = F.col("doc")[text_col].cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    met = rows.join(marks, rows["id"].eqNullSafe(marks["mark_id"]) & (rows["text_key"] == marks["mark_key"]), "left")
    met = _matched(met.select("doc", "marks", F.when(F.col("marks").isNotNull(), text).alias("marked")), "marked")
    pieces = F.transform("found", lambda c, i: F.concat(F.get("gaps", i), F.when(F.get("marks", i), F.lit(LABEL)).otherwise(c)))
    clean = F.when(F.col("marks").isNotNull(), F.concat(F.array_join(pieces, ""), F.get("gaps", F.size("found")))).otherwise(text)
    return met.select(*[(clean.cast(docs.schema[c].dataType) if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
