"""URL filters by association rules (operator 4).

A URL is a set of tokens: scheme, host labels by their place, path segments
and query keys.  Spark's FP-growth mines the token combinations of labelled
URLs that often come with the label ``block``; rules are pruned by support
and confidence, and by a more general rule that is as confident.  A rule is
found for a URL by an inverted index: it is filed under its rarest token,
URLs meet it over that token in a hash join, and the other tokens are
checked on the pair.

Hand-made host and path rules come first: a rule fits its host and all
subdomains when the path starts with the rule's path; the longest that fits
decides.  Only URLs that no such rule judges get the verdict of the mined
rules: block when one of them matches, else allow.

Cases: a null URL, and one without ``://``, has an empty host and path and
no token, fits no rule and is allowed; repeated rows each give a row; empty
tables give empty tables, no labels mean no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import lower_ascii, written

MIN_SUPPORT = 0.002
# A rule rests on so many labelled URLs at least, however few there are.
MIN_URLS = 20
MIN_CONFIDENCE = 0.6
BLOCK = "=block"

# Fixed values of the contract: rule and verdict.
HAND_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^(?s).*?://([^/?#]*)([^?#]*)"
    has = F.instr(url, "://") > 0
    return (F.when(has, lower_ascii(F.regexp_extract(url, parts, 1))).otherwise(""),
            F.when(has, F.regexp_extract(url, parts, 2)).otherwise(""))


def hand_rule(host: Column, path: Column, rules=HAND_RULES) -> Column:
    """The longest rule that fits, as struct ``rule, verdict``; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>") if not rules else None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none without ``://``."""
    host, path = url_parts(url)
    url = F.coalesce(url, F.lit(""))
    scheme = F.concat(F.lit("scheme:"), lower_ascii(F.regexp_extract(url, r"^(?s)(.*?)://", 1)))
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "0")))
    query = F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(F.array(scheme), labels, steps, keys))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """``(rule_id, tokens, confidence, support)`` of the rules ``tokens -> block``."""
    spark = labelled.sparkSession
    tokens = url_tokens(F.col(url_col))
    baskets = labelled.where(F.col(blocked_col).isNotNull()).select(
        F.when(F.col(blocked_col), F.array_append(tokens, F.lit(BLOCK))).otherwise(tokens).alias("items")).where(F.size("items") > 0)
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    baskets = written(baskets, "baskets")
    n = baskets.count()
    if not n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_urls / n)), minConfidence=min_confidence,
                     numPartitions=max(1, baskets.rdd.getNumPartitions())).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens")), "mined-rules")
    # a rule goes when one with a part of its tokens is as confident: that one fires wherever it does
    part = rules.select(F.col("rule_id").alias("part_id"), F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"),
                        F.explode("tokens").alias("token"))
    whole = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    covered = (part.join(whole, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
                                               & (F.col("part_confidence") >= F.col("confidence"))).select("rule_id").distinct())
    return written(rules.join(covered, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support"), "rules")


def matches(urls: DataFrame, rules: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``urls`` joined with the rules whose tokens they all hold (one row per match)."""
    # the inverted index: each rule under its token that is rarest among the rules
    use = rules.select(F.explode("tokens").alias("t")).groupBy("t").count()
    filed = (rules.select("rule_id", F.col("tokens").alias("rule_tokens"), "confidence", F.explode("tokens").alias("t")).join(use, "t")
             .groupBy("rule_id", "rule_tokens", "confidence").agg(F.min_by("t", F.struct("count", "t")).alias("token")))
    return (urls.withColumn("token", F.explode(tokens_col)).join(filed, "token")
            .where(F.size(F.array_except("rule_tokens", tokens_col)) == 0).drop("token", "rule_tokens"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", hand_rules=HAND_RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, mined_rules`` for every row."""
    host, path = url_parts(F.col(url_col))
    # equal URLs get one verdict: their tokens meet the index once
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    base = base.withColumn("_hand", hand_rule(F.col("host"), F.col("path"), hand_rules))
    if rules.isEmpty():
        hit = base.withColumn("mined_rules", F.lit(0).cast("long"))
    else:
        asked = base.where("_hand is null and _url is not null").select("_url").distinct().withColumn("tokens", url_tokens(F.col("_url")))
        found = matches(asked, rules).groupBy("_url").agg(F.countDistinct("rule_id").alias("mined_rules"))
        hit = base.join(found, "_url", "left").withColumn("mined_rules", F.when(F.col("_hand").isNull(), F.coalesce("mined_rules", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return hit.select(id_col, "host", "path", F.col("_hand.rule").alias("rule"),
                      F.coalesce("_hand.verdict", F.when(F.col("mined_rules") > 0, "block").otherwise("allow")).alias("verdict"), "mined_rules")
