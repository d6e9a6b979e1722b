"""Quality classifier from weak labels (operator 1).

Nine heuristic labellers look at a whole text and vote good (1), bad (-1)
or abstain (0); they overlap, as each kind of junk meets several of them.
Documents with equal votes are counted, and expectation-maximisation over
those counts (at most 3^9 rows, whatever the corpus) estimates each
labeller's accuracy on good documents and on two kinds of bad ones, noisy
and repetitive, and their shares; an abstention says nothing.  This gives every vote pattern a posterior.  A linear scorer over
hashed features (word shapes and binned measures) is trained on the
posteriors as soft labels, each sampled document as a good one and a bad one
weighted by them; it judges every document.  A document whose score is below
``KEEP_SCORE`` is rejected.

The scorer is fitted on at most ``TRAIN_ROWS`` documents, chosen by a hash
of the id; the votes are counted over all documents.  One pass reads the
texts; the rest works on the small feature table in the shared folder.

Cases: a null text is an empty one; a text without words is voted bad and
rejected; a very long text is read whole; equal texts get equal scores; an
empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import WORD_GAP, bounded_sample, text_key, written

TRAIN_ROWS = 20_000
HASHED = 1 << 12
KEEP_SCORE = 0.5
ROUNDS = 100
# The two kinds of bad documents, and which of them each labeller is to tell from good ones.
KINDS = ("noisy", "repetitive")
# A labeller's accuracy before any document is seen, held with the weight of this share of the documents.
FIRST_ACCURACY = 0.8
PRIOR_SHARE = 0.05

# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the and of to in is that it for on with as was are by be this not "
    "le la de et les des en un une que qui pour par sur est pas dans du "
    "der die und das ist von zu mit den nicht ein eine im auf dem sich "
    "el los las y por con para no se su al lo como más").split()


def _measures(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(*carry, text.alias("_t"))
    # plain words: letters with at most one mark of punctuation after them
    plain = F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])[\p{L}'’-]+[.,;:?!]?(?![^\x20\x09-\x0D])"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    t = t.select(*carry, F.length("_t").alias("chars"),
                 (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>{}~^", ""))).alias("symbols"),
                 (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("capitals"),
                 plain.alias("plain"), shape.alias("shape"),
                 F.filter(F.split(F.lower("_t"), WORD_GAP), lambda w: w != "").alias("w"),
                 F.filter(F.split("_t", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    n = F.size("w")
    return t.select(*carry, n.alias("n"), F.col("chars"),
                    (F.col("symbols") / F.greatest("chars", F.lit(1))).alias("symbols"),
                    (F.col("capitals") / F.greatest("chars", F.lit(1))).alias("capitals"),
                    (F.col("plain") / F.greatest(n, F.lit(1))).alias("plain"),
                    (F.size(F.filter("w", lambda x: x.isin(FUNCTION_WORDS))) / F.greatest(n, F.lit(1))).alias("function"),
                    (F.size(F.array_distinct("w")) / F.greatest(n, F.lit(1))).alias("distinct"),
                    (F.size(F.filter("w", lambda x, i: x == F.get("w", i + 1))) / F.greatest(n, F.lit(1))).alias("stutter"),
                    (F.size(F.array_distinct(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1))))) / F.greatest(n, F.lit(1))).alias("pairs"),
                    (F.col("chars") / F.greatest(n, F.lit(1))).alias("length"),
                    F.size("lines").alias("n_lines"),
                    (F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1))).alias("own_lines"),
                    F.array_distinct(F.split("shape", WORD_GAP)).alias("shapes"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def labellers() -> dict[str, Column]:
    """The votes of each labeller, over the measures of a text."""
    n, c = F.col("n"), F.col
    return {
        "plain_words": _vote(c("plain") > 0.85, c("plain") < 0.6),
        "symbols": _vote((c("symbols") < 0.005) & (n > 0), c("symbols") > 0.02),
        "capitals": _vote((c("capitals") < 0.1) & (n >= 5), (c("capitals") > 0.3) & (n >= 5)),
        "function_words": _vote((c("function") > 0.1) & (n >= 10), ((c("function") < 0.04) & (n >= 30)) | (n == 0)),
        "distinct_words": _vote((c("distinct") > 0.3) & (n >= 10), (c("distinct") < 0.15) & (n >= 20)),
        "word_pairs": _vote((c("pairs") > 0.8) & (n >= 10), (c("pairs") < 0.5) & (n >= 10)),
        "stutter": _vote((c("stutter") < 0.05) & (n >= 10), (c("stutter") > 0.2) & (n >= 10)),
        "word_length": _vote(c("length").between(3, 8) & (n >= 10), ((c("length") > 10) & (n >= 10)) | (n == 0)),
        "own_lines": _vote((c("own_lines") > 0.9) & (c("n_lines") >= 3), (c("own_lines") < 0.6) & (c("n_lines") >= 4)),
    }


# In the order of the labellers.
KIND_OF = ("noisy", "noisy", "noisy", "noisy", "repetitive", "repetitive", "repetitive", "noisy", "repetitive")


def _features() -> Column:
    """Hashed features: distinct word shapes, and each measure's bin."""
    bins = {"symbols": 50, "capitals": 10, "plain": 10, "function": 20, "distinct": 10, "stutter": 10, "pairs": 10, "length": 1, "own_lines": 5}
    made = [F.concat(F.lit(f"{m}="), F.least(F.floor(F.col(m) * k), F.lit(20)).cast("string")) for m, k in bins.items()]
    made.append(F.concat(F.lit("n="), F.floor(F.log2(F.col("n") + 1)).cast("string")))
    return F.concat(F.array(*made), F.transform("shapes", lambda s: F.concat(F.lit("shape="), s.substr(1, 12))))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float, list]:
    """Expectation-maximisation over counted vote patterns.

    A document is good, noisy or repetitive.  Returns the posterior of
    ``good`` by pattern, the share of good documents, and how often each
    labeller, where it votes, says good of documents of the three classes.
    """
    import numpy as np

    patterns = sorted(counts)
    votes = np.array(patterns)
    weight = np.array([counts[p] for p in patterns], float)
    # how often each labeller says good (not bad) of good, noisy and repetitive documents
    first = np.array([[FIRST_ACCURACY] * len(KIND_OF), *([1 - FIRST_ACCURACY if k == kind else 0.5 for k in KIND_OF] for kind in KINDS)])
    says_good, prior = first, PRIOR_SHARE * weight.sum()
    share = np.array([0.7, 0.15, 0.15])
    for _ in range(rounds):
        logs = (np.log(says_good) @ (votes > 0).T + np.log(1 - says_good) @ (votes < 0).T) + np.log(share)[:, None]
        odds = np.exp(logs - logs.max(axis=0))
        posterior = odds / odds.sum(axis=0)
        part = posterior * weight
        share = (part.sum(axis=1) + 1) / (weight.sum() + len(share))
        says_good = (part @ (votes > 0) + first * prior) / (part @ (votes != 0) + prior)
    return dict(zip(patterns, posterior[0].tolist())), float(share[0]), says_good.tolist()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id_col, text_key, posterior, score, kept`` for every row; ``text_key`` is a hash of the text."""
    spark = docs.sparkSession
    keyed = docs.select(id_col, text_col, text_key(text_col).alias("text_key"))
    made = _measures(keyed, [id_col, "text_key"], text_col).select(id_col, "text_key", F.array(*(v.cast("int") for v in labellers().values())).alias("votes"), _features().alias("features"))
    table = written(made, "quality-features")
    counts = {tuple(r["votes"]): r["count"] for r in table.groupBy("votes").count().collect()}
    if not counts:
        return table.select(id_col, "text_key", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    posterior, _, _ = estimate(counts)
    # at most 3^9 patterns
    known = spark.createDataFrame([(list(p), x) for p, x in posterior.items()], "votes array<int>, posterior double")
    table = table.join(F.broadcast(known), "votes")
    hashing = HashingTF(numFeatures=HASHED, binary=True, inputCol="features", outputCol="x")
    sample = bounded_sample(table, sum(counts.values()), train_rows, [id_col, "features"])
    both = sample.withColumn("side", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
                                                       F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))))
    train = written(both.select("features", "side.*").where("weight > 0.001"), "quality-train")
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=0.001, maxIter=40).fit(hashing.transform(train))
    if model.numClasses < 2:  # all sampled documents are of one class for certain
        return table.select(id_col, "text_key", "posterior", F.col("posterior").alias("score"), (F.col("posterior") >= KEEP_SCORE).alias("kept"))
    scored = model.transform(hashing.transform(table)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(id_col, "text_key", "posterior", "score", (F.col("score") >= KEEP_SCORE).alias("kept"))
