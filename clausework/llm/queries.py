"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import bands, bpe, filter_audit, pii, quality, revisits, secrets, sharding, simhash, templates, token_counts, url_rules, vector_codes
from clausework.llm.common import load, written
from clausework.session import run_dir

RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 16


def vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def dictionary(spark: SparkSession) -> DataFrame:
    """Words of four letters and more in a public vocabulary (at most its 50,256 entries)."""
    words = {t.strip().decode().lower() for t in vocabulary().ranks if len(t.strip()) >= 4 and t.strip().isalpha()}
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents")).drop("text_key")


def bpe_digests(docs: DataFrame) -> DataFrame:
    vocab = vocabulary()
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocab, carry=["doc_id"]), vocab)
    return done.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(load(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = load(spark, sf_dir, "pages").select("page_id", "url"), load(spark, sf_dir, "labels")
    blocked = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return url_rules.judge(pages, url_rules.mine(pages.join(blocked, "page_id")))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents"), dictionary(spark))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def token_batches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three batches of changes: all documents are counted under two tokenizer
    versions; those that ``labels`` calls bad are taken down; licence lines
    are removed from the others and these counted again."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    bare = F.when(F.instr("text", "Licensed under ") > 0, F.regexp_replace("text", r"(?m)^Licensed under [^\n]*$", "")).otherwise(F.col("text"))
    counts = [token_counts.count_tokens(c, v).alias(f"{k}{i}") for i, v in enumerate(TOKENIZERS) for k, c in (("n", F.col("text")), ("r", bare))]
    counted = written(docs.select("doc_id", "source", "lang", F.monotonically_increasing_id().alias("row"), *counts), "document-counts")
    bad = load(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    gone, stays = counted.join(bad, "doc_id", "left_semi"), counted.join(bad, "doc_id", "left_anti")

    def rows(part, op, seq, before, after):
        out = None
        for i, version in enumerate(TOKENIZERS):
            value = lambda k: F.col(f"{k}{i}") if k else F.lit(None).cast("long")
            one = part.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"),
                              F.concat_ws(":", F.lit(seq), F.lit(version), "row").alias("change"), value(before).alias("before"), value(after).alias("after"))
            out = one if out is None else out.unionByName(one)
        return out

    return {"1-insert": rows(counted, "insert", 1, None, "n"), "2-delete": rows(gone, "delete", 2, "n", None),
            "3-revise": rows(stays, "revise", 3, "n", "r").where("before <> after")}


TOKENIZERS = ("words@1", "words@2")


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = token_counts.Rollup(spark, run_dir(spark, "llm-token-rollup"))
    batches = token_batches(spark, sf_dir)
    for batch_id, changes in batches.items():
        rollup.commit(batch_id, changes)
    rollup.commit("2-delete", batches["2-delete"])  # a batch sent twice counts once
    return rollup.totals()


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(load(spark, sf_dir, "documents"), n_shards=SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.quality_rules(load(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", *bands.MEASURES, "base_failed", "kept", F.round("whole_ratio", 6).alias("whole_ratio"), "n_chunks", "n_chunks_out")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_key")


def captures(pages: DataFrame) -> DataFrame:
    """WARC records made from a page: its first response and the crawler's
    later visits, which differ by a hash of the URL: an unchanged one, a
    changed page, an unchanged one again by tag or by date, one too early."""
    t, pick = (F.lit(1_700_000_000) + 37 * F.coalesce("page_id", F.lit(0))).cast("long"), F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 7), 16, 10).cast("long")
    body = F.md5(F.coalesce("html", F.lit("")))
    day = 86400

    def headers(seconds, tag, modified, **more):
        pairs = {"Content-Type": F.lit("text/html"), "Date": seconds.cast("string"), "ETag": tag, "Last-Modified": modified.cast("string"), **more}
        entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    none = F.lit(None).cast("string")
    tag = F.concat(F.lit('"'), F.col("_body"), F.lit('"'))
    soon, late = t + 3600 * (1 + pick % 240), t + 20 * day

    def record(k, kind, seconds, head, when=F.lit(True)):
        return F.when(when, F.struct((8 * F.col("page_id") + k).alias("record_id"), F.lit(kind).alias("kind"), F.col("url"), seconds.alias("seconds"), head.alias("headers")))

    records = F.array(
        record(0, "response", t, headers(t, tag, t, **{"Cache-Control": F.lit("max-age=60"), "Content-Length": F.length("html"), "Server": F.lit("a")})),
        record(1, "revisit", soon, headers(soon, F.concat(F.lit("W/"), tag), none, **{"Cache-Control": F.lit("max-age=600"), "Server": F.lit("b")})),
        record(2, "response", t + 10 * day, headers(t + 10 * day, F.concat(F.lit('"2-'), F.col("_body"), F.lit('"')), t + 9 * day), pick % 3 == 0),
        record(3, "revisit", late, headers(late, F.when(pick % 5 != 0, tag), F.when(pick % 5 < 2, t).otherwise(none))),
        record(4, "revisit", t - 1000, headers(t - 1000, tag, t), pick % 7 == 0))
    return (pages.select("page_id", "url", "html", body.alias("_body"))
            .select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve(captures(load(spark, sf_dir, "pages")))
    return done.select("record_id", "canonical_url", "response_id", "status", revisits.header_text(F.col("headers")).alias("headers"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    name = F.array(*(F.lit(k) for k in pii.KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"], s["stop"])), ",")


def op11_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(load(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda s: s["rank"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    return vector_codes.with_label_errors(coded, "label").select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_weak_labels, op2_byte_bpe, op3_simhash, op4_url_filters, op5_secret_forest, op6_token_rollups, op7_kd_shards,
    op8_compression_bands, op9_template_decontamination, op10_revisits, op11_semi_crf, op12_filter_audit, op13_ball_kmeans)}
