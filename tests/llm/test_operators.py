"""The ten operators against brute force, on small and odd tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import bands, bpe, queries, quality, revisits, secrets, sharding, simhash, templates, token_counts, url_rules
from clausework.session import run_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fingerprint string, size string, count string"
PROSE = "the river and the old mill were for a while in the hands of one family that it was said to be kind to all who came by"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(PROSE.split()) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(60, 200))) for _ in range(12)]
    near = [base[0].replace("mill", "barn", 1), base[0] + " end"]
    texts = [None, "", " \n\t ", "word", "two words", "x" * 5000, "a  b\n\n c \u00a0 d\x85e", "日本語 テキスト 😀", *base, *near, base[1], base[1], PROSE * 400]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None, "x", "y", "z", "c") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1, "x", "y", "z", "c"), (None, base[2], "en", "s", 1, "x", "y", "z", "c")]
    return spark.createDataFrame(rows, DOCS)


def test_bpe_equals_the_library_and_decodes(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    vocab = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    done = bpe.decode(bpe.encode(odd, vocab, carry=["doc_id", "text"]), vocab)
    rows = done.withColumn("array", bpe.unpack_ids("ids")).withColumn("n", bpe.n_tokens("ids")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = own.encode_ordinary(r.text or "")
        assert r.array == want and r.n == len(want) and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_pieces_and_small_blocks(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    vocab = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 16)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 20)
    rng = random.Random(5)
    replay = bpe.MergeReplay(vocab.ranks, vocab.pattern)
    for _ in range(200):
        text = "".join(rng.choice(["a", "ab", "ing", " ", "\n", "  ", "'s", "12", "!?", "é", "aaa", " the"]) for _ in range(rng.randint(0, 120)))
        assert np.frombuffer(next(replay.encode([text])), "<u4").tolist() == own.encode_ordinary(text)


def plain_fingerprint(text):
    import xxhash
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints, max_bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= max_bits:
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return [find(i) for i in range(len(prints))]


def test_simhash_classes(spark, odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (p, rows[c].doc_id) for r, p, c in zip(rows, prints, plain_classes(prints, 4))}
    got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_simhash_links_with_large_shards(spark, monkeypatch):
    """Shards parted by further blocks and cut into slices lose no link."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1}
    for _ in range(150):
        p = centre
        for b in rng.sample(range(64), rng.randint(1, 9)):
            p ^= 1 << b
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(150)}
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    roots = {r.vertex: r.root for r in simhash.components(edges).collect()}
    mine = [roots.get(p, p) for p in signed]
    want = plain_classes(prints, 4)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_keep_one_row_of_each_class(spark):
    """One row of a class stays, told by id and text: rows of different texts under one id, or none, are judged apart."""
    long = [" ".join(f"w{k}{i}" for i in range(60)) for k in range(3)]
    docs = spark.createDataFrame([(1, long[0]), (1, long[0]), (2, long[0]), (2, long[1]), (3, long[1]), (None, long[2]), (None, long[2]), (None, long[0]), (7, None), (8, "")],
                                 "doc_id long, text string").withColumn("class_print", F.lit("clash"))
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, long[0]), (2, long[1]), (None, long[2]), (7, None)], key=str)


def test_shards_near_equal_and_slots_gapless(spark, odd):
    docs = odd.where("doc_id is not null").withColumn("doc_id", F.monotonically_increasing_id())
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + (1 << 45)))
    rows = sharding.shard_documents(docs, n_shards=4).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sizes = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    assert len(rows) == len(texts) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in sizes.values())
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(z for _, z in sizes.get(k, [])) - total / 4) <= 2 * most for k in range(4))
    by_target = sharding.shard_documents(docs, target_bytes=total // 3).agg(F.max("shard")).first()[0]
    assert by_target in (2, 3)
    same = odd.select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"), "lang", "source")
    slots = [r.slot for r in sharding.shard_documents(same.limit(5), n_shards=2).where("shard = 1").collect()]
    assert sorted(slots) == list(range(len(slots)))


def test_bands_base_measures(spark, odd):
    for r in bands.quality_rules(odd, ["doc_id", "text"]).collect():
        text = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        counts = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        held = {k for i, g in enumerate(grams) if counts[g] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(held))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(ws) < 50 or 100 * len(held) > 50 * len(ws)) and not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise():
    rng = random.Random(1)
    judge = bands.Bands().judge
    assert judge(" ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)))[3]
    assert not judge("again and again " * 300)[3]
    assert not judge("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(4000)))[3]


def test_em_tells_labellers_apart():
    rng = random.Random(2)
    counts, truth = {}, {}
    for _ in range(4000):
        good = rng.random() < 0.8
        kind = None if good else rng.choice(quality.KINDS)
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < 0.95) == (good or k != kind) else -1) for k in quality.KIND_OF)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(good)
    posterior, share, _ = quality.estimate(counts)
    right = sum(((posterior[v] >= 0.5) == g) for v, gs in truth.items() for g in gs)
    assert right > 0.97 * 4000 and abs(share - 0.8) < 0.05


def test_quality_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.score(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert sum(r.kept for r in got if r.quality == 1) >= 0.98 * sum(r.quality for r in got)


def test_quality_odd_texts(spark, odd):
    kept = {r.doc_id: r.kept for r in quality.score(odd).collect()}
    assert len(kept) == odd.select("doc_id").distinct().count() and not kept[0] and not kept[1]
    assert quality.score(odd.limit(0)).count() == 0


def test_url_parts_and_hand_rules(spark):
    cases = {None: ("", "", None), "no scheme": ("", "", None), "http://A.Net/es/1?x#y": ("a.net", "/es/1", "net/es/"),
             "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/"),
             "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/"), "x://b.com?q=/": ("b.com", "", None),
             "x://b.com/": ("b.com", "/", "com/"), "x://notexample.com/en/": ("notexample.com", "/en/", "com/")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    rules = url_rules.mine(pages.withColumn("blocked", F.lit(None).cast("boolean")))
    rows = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == ("block" if rule in ("net/es/", "example.com/en/") else "allow")


def test_mined_rules_equal_counting(spark):
    rng = random.Random(4)
    urls = [f"http://{rng.choice(['a', 'b', 'win'])}.site{rng.randint(1, 3)}.org/{rng.choice(['x', 'y'])}/{rng.randint(1, 999)}" for _ in range(400)]
    bad = ["win" in u and "/x/" in u for u in urls]
    labelled = spark.createDataFrame([(u, b) for u, b in zip(urls, bad)], "url string, blocked boolean")
    rules = url_rules.mine(labelled, min_support=0.02, min_confidence=0.8)
    baskets = {r.url: set(r.t) for r in labelled.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    found = rules.collect()
    assert found
    for r in found:
        hits = [b for u, b in zip(urls, bad) if set(r.tokens) <= baskets[u]]
        assert abs(sum(hits) / len(hits) - r.confidence) < 1e-9 and r.confidence >= 0.8 and sum(hits) >= 20
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules, hand_rules=()).collect()}
    assert got == {i: "block" if any(set(r.tokens) <= baskets[u] for r in found) else "allow" for i, u in enumerate(urls)}


def test_secrets_spans_and_forest(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(120):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        number = str(rng.randint(10**15, 10**16 - 1))
        text = f'é start {number} mid token = "{key}" then http://h.io/a/{key[:20]} end'
        rows.append((i, text))
        want.add((i, text.index(key), 40))
    rows += [(200, None), (201, ""), (202, "z9" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    words = spark.createDataFrame([("word",)], "word string")
    found = secrets.scan(docs, words)
    texts = dict(rows)
    got = found.collect()
    assert all(texts[r.doc_id][r.start:r.start + r.length] == r.candidate for r in got)
    assert want <= {(r.doc_id, r.start, r.length) for r in got if r.is_secret}
    assert not any(r.candidate.isdigit() and r.is_secret for r in got)
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert clean[200] is None and all(secrets.LABEL in clean[i] and texts[i][s:s + n] not in clean[i] for i, s, n in want)
    assert secrets.scan(docs.limit(0), words).count() == 0


def test_redact_rows_without_or_with_one_id(spark):
    """Rows that share an id or have none are cleaned by the findings of their own text."""
    key, other = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    texts = [f"token = {key} and {key} again", f"sha1 {other} end", f"token = {other}", "nothing", "", None]
    docs = spark.createDataFrame([(i, t, 1, "m") for t in texts for i in (None, 7)] + [(7, texts[0], 1, "m")],
                                 "doc_id long, text string, marks int, text_key string")
    said = [(i, t, k, c, not t.startswith("sha1")) for t in texts[:3] for i in (None, 7) for k, c in enumerate(re.findall("[0-9a-f]{32}", t))]
    findings = spark.createDataFrame(said + said[:1], "doc_id long, t string, k int, candidate string, is_secret boolean").withColumn("text_key", F.xxhash64("t"))
    got = secrets.redact(docs, findings)
    assert got.columns == docs.columns and got.schema["marks"].dataType == docs.schema["marks"].dataType
    clean = [f"token = {secrets.LABEL} and {secrets.LABEL} again", texts[1], f"token = {secrets.LABEL}", "nothing", "", None]
    want = [(i, t) for t in clean for i in (None, 7)] + [(7, clean[0])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_operators_on_odd_tables(spark, odd):
    """Nulls in any column, repeated rows and ids, long texts, extra columns named as outputs."""
    n = odd.count()
    clash = odd.withColumns({c: F.lit("x") for c in ("host", "path", "verdict", "kept", "score", "component_id", "shard", "slot", "op", "n_words")})
    assert simhash.near_duplicates(clash).count() == n
    assert bands.quality_rules(clash, ["doc_id", "n_words"]).count() == n
    assert quality.score(clash).count() == n
    assert sharding.shard_documents(clash, n_shards=3).count() == n
    words = spark.createDataFrame([("word",)], "word string")
    assert secrets.redact(clash, secrets.scan(clash, words)).exceptAll(clash).count() <= n
    items = odd.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("pos"))
    found = templates.contaminated(clash, items)
    # every text of five words and more holds itself
    own = odd.where(F.size(F.split(F.trim("text"), r"\s+")) >= 8).where("doc_id >= 8").select("doc_id").distinct()
    assert own.join(found.where("doc_id = item_id"), "doc_id", "left_anti").count() == 0
    pages = clash.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 == 0, "http://a.com/x").alias("url"), "host", "path", "verdict")
    assert url_rules.judge(pages, url_rules.mine(pages.withColumn("blocked", F.col("page_id") % 2 == 0))).count() == n
    changes = token_counts.inserts(clash, "words@1", 1)
    # rows that differ in anything are changes of their own, and so is every row without an id
    known = changes.where("doc_id is not null").distinct().count()
    assert token_counts.delta_of(changes).agg(F.sum("n_changes")).first()[0] == known + changes.where("doc_id is null").count()
    records = spark.createDataFrame([(None, "revisit", None, None, None), (1, None, None, 5, None), (None, "response", None, 4, None), (3, "revisit", None, 6, None)],
                                    "record_id long, kind string, url string, seconds long, headers map<string,string>").withColumns({"slice": F.lit(1), "found": F.lit(2)})
    assert sorted(r.status for r in revisits.resolve(records).collect()) == ["no_response", "unchecked"]


def test_stages_on_odd_tables(spark, odd, sf):
    import corpus_pipeline
    named = odd.withColumns({c: F.lit(1) for c in ("doc", "marks", "gaps", "text_key", "votes", "features", "posterior", "component_id", "item", "hash")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, named, sf)
        rows = out.collect()
        assert len(rows) <= named.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == named.columns, name
        else:
            assert len(rows) == named.count()


def test_rollup_commits_are_idempotent(spark):
    rollup = token_counts.Rollup(spark, run_dir(spark, "test-rollup"))
    assert rollup.totals().count() == 0
    rows = lambda *r: spark.createDataFrame(r, token_counts.CHANGES)
    first = rows(("insert", 1, 1, "a", "en", "t", None, 10), ("insert", 1, 2, "a", "en", "t", None, 5), ("insert", 1, 2, "a", "en", "t", None, 5),
                 ("insert", 1, 3, None, None, "t", None, 0))
    second = rows(("revise", 2, 1, "a", "en", "t", 10, 7), ("delete", 2, 2, "a", "en", "t", 5, None))
    for batch, changes in (("b1", first), ("b2", second), ("b1", first), ("b2", second), ("b3", second.limit(0))):
        rollup.commit(batch, changes)
    assert {(r.source, r.n_docs, r.n_tokens, r.n_changes) for r in rollup.totals().collect()} == {("a", 1, 7, 4), (None, 1, 0, 1)}
    assert rollup.batches() == ["b1", "b2", "b3"]


def test_changes_that_share_an_id(spark):
    """Null ids are apart, other sources are other changes; a change's own id tells what was delivered twice."""
    rows = [("insert", 1, None, "a", "en", "t", None, 10), ("insert", 1, None, "a", "en", "t", None, 10), ("insert", 1, 7, "a", "en", "t", None, 5), ("insert", 1, 7, "b", "en", "t", None, 6)]
    got = {r.source: (r.n_docs, r.n_tokens, r.n_changes) for r in token_counts.delta_of(spark.createDataFrame(rows, token_counts.CHANGES)).collect()}
    assert got == {"a": (3, 25, 3), "b": (1, 6, 1)}
    named = spark.createDataFrame([(*rows[0], "x"), (*rows[0], "x"), (*rows[0], "y"), (*rows[2], "z"), (*rows[2], None), (*rows[2], None)], token_counts.CHANGES + ", change string")
    assert {r.source: (r.n_docs, r.n_tokens) for r in token_counts.delta_of(named).collect()} == {"a": (4, 30)}


def test_commits_that_die_or_meet(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, run_dir(spark, "test-rollup"))
    rows = spark.createDataFrame([("insert", 1, 1, "a", "en", "t", None, 10)], token_counts.CHANGES)
    bad = rows.withColumn("after", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):
        rollup.commit("b", bad)
    assert rollup.batches() == [] and rollup.totals().count() == 0
    assert rollup.commit("b", rows) is True
    # sent again with other rows, or by a writer that did not see the first: what is committed stays
    more = rows.withColumn("after", F.lit(99).cast("long"))
    assert rollup.commit("b", more) is False
    path, fs = rollup._fs()
    late = path(f"{rollup.path}/_attempt-late")
    token_counts.delta_of(more).write.parquet(late.toString())
    assert not fs.rename(late, path(f"{rollup.path}/batch=b")) or fs.exists(path(f"{rollup.path}/batch=b/_attempt-late"))
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(1, 10)]


def test_templates_slots(spark):
    items = [(1, "If Anna buys 12 apples at 3 euros each and Anna sells 12 apples, how much money does Anna have now"), (2, "too short"), (3, None)]
    docs = [(1, "Intro. " + items[0][1] + " . After."), (2, "If Boris buys 40 apples at 7 euros each and Boris sells 40 apples, how much money does Boris have now"),
            (3, "If Boris buys 40 apples at 7 euros each and Clara sells 55 apples, how much money does Dora have now"),
            (4, "nothing of it is here at all in these many words of mine"), (5, None), (6, ""), (7, items[0][1].upper().replace(" ", " | "))]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")),
                                 spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id: r.reworded for r in got}
    assert found.get(1) is False and found.get(2) is True and not {3, 4, 5, 6} & set(found)
    none = spark.createDataFrame([], "item_id long, text string")
    assert templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_templates_in_long_texts(spark):
    item = "If Anna buys 12 apples at 3 euros each and Anna sells 12 apples, how much money does Anna have now"
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3 * 256)]
    docs = [(k, " ".join([*words[:k], "end.", item.replace("12", "40"), *words[k:]])) for k in (0, 256 - 9, 256, 3 * 256)]
    docs.append((-1, " ".join([*words[:300], "end.", item.replace("sells 12", "sells 41"), *words[300:]])))
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    # the whole item is met wherever a chunk of windows ends; the slots of the last one contradict each other
    assert {r.doc_id for r in got if r.hit_windows == r.item_windows and r.reworded} == {d for d, _ in docs if d >= 0}
    assert -1 not in {r.doc_id for r in got}


def test_revisits_against_brute_force(spark):
    rng = random.Random(8)
    recs = []
    for i in range(400):
        url = "http://www.hot.org/p" if rng.random() < 0.4 else f"https://m.u{rng.randint(1, 5)}.org/a.html#f"
        head = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", rng.choice(["d1", "d2", None])), ("Server", f"s{i}")) if v}
        recs.append((i, rng.choice(["response", "revisit", "metadata"]), url, None if rng.random() < 0.02 else rng.randint(0, 300_000), head or None))
    df = spark.createDataFrame(recs, "record_id long, kind string, url string, seconds long, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve(df, slice_seconds=20_000).collect()}
    assert set(got) == {r[0] for r in recs if r[1] == "revisit"}
    key = lambda u: "hot.org/p" if "hot" in u else re.search(r"u\d\.org", u)[0] + "/a"
    for i, kind, url, sec, head in recs:
        if kind != "revisit":
            continue
        before = [r for r in recs if sec is not None and r[1] == "response" and r[3] is not None and key(r[2]) == key(url) and (r[3], r[0]) < (sec, i)]
        last = max(before, key=lambda r: (r[3], r[0]), default=None)
        assert got[i].canonical_url == key(url)
        if last is None:
            assert (got[i].status, got[i].response_id) == ("no_response", None)
            continue
        a, b = last[4] or {}, head or {}
        if "ETag" in a and "ETag" in b:
            same = a["ETag"].removeprefix("W/") == b["ETag"].removeprefix("W/")
        else:
            same = a["Last-Modified"] == b["Last-Modified"] if "Last-Modified" in a and "Last-Modified" in b else None
        assert got[i].status == {True: "resolved", False: "mismatch", None: "unchecked"}[same]
        assert got[i].response_id == (None if same is False else last[0])
        if same is not False:
            assert got[i].headers["server"] == a["Server"]


def test_pipeline_drops_and_scrubs(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        assert stage(spark, seen.limit(0), sf).count() == 0, name
        seen = corpus_pipeline.written(after, name)
    assert 0 < seen.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() == seen.count()


def test_templates_at_sentence_and_line_starts(spark):
    """Names that open a sentence or a line, names after a number, units joined to a number."""
    items = [(1, "Tom has 5 apples and gives 2 to Anna. Anna eats one apple and keeps the rest. How many apples does Anna have?"),
             (2, "A train runs 60km in 2h and a car runs 80km in 3h on the same road to town"),
             (3, "In the year 1990 Anna and the old man from the mill by Berlin went up to the hills with bread")]
    texts = {1: ["Max has 7 apples and gives 3 to Clara. Clara eats one apple and keeps the rest. How many apples does Clara have?",
                 "Max has 7 apples and gives 3 to\nClara. Clara eats  one apple and keeps the rest. How many apples does\nClara have?",
                 "so how is it: Max has 7 apples and gives 3 to Clara.\nClara eats one apple and keeps the rest. How many apples does\t Clara have?"],
             2: ["A train runs 70 km in 4 h and a car runs 90 km in 5 h on the same road to town", "A train runs 70miles in 4min and a car runs 90miles in 5min on the same road to town"],
             3: ["In the year 1871 Boris and the old man from the mill by Paris went up to the hills with bread"]}
    docs = [(10 * i + k, t) for i, ts in texts.items() for k, t in enumerate(ts)]
    docs += [(100 + i, t) for i, t in items]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    whole = {(r.doc_id, r.item_id): r.reworded for r in got if r.hit_windows == r.item_windows}
    assert whole == {**{(d, d // 10): True for d, _ in docs if d < 100}, **{(100 + i, i): False for i, _ in items}}


def test_templates_leave_out_contradicting_windows_only(spark):
    """A long copy with one of two equal numbers changed; one value held twice by chance."""
    words = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    items = [(1, f"we count 12 apples at noon {words} and in the end 12 apples are left over for all of us here"),
             (2, "a boy buys 2 pens at 2 euros each in the shop and pays at the desk by the door")]
    docs = [(1, items[0][1].replace("end 12", "end 15")), (2, items[1][1].replace("2 pens at 2", "3 pens at 5")), (3, items[0][1])]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.item_windows - r.hit_windows, r.reworded) for r in got}
    # eight windows lie over the changed number of the first; none is left out of the others
    assert found == {(1, 1): (8, False), (2, 2): (0, True), (3, 1): (0, False)}


def test_secrets_of_any_length_and_alphabet(spark):
    """Short passwords, keys without a digit, marks, dotted tokens; prose after a name is none."""
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'start token = "{h}" then http://h.io/a/{h[:20]} and {rng.randint(10**15, 10**16 - 1)} end. The key: this is it') for i, h in enumerate(hexes)]
    odd_ones = {100: ('password = "Tr0ub4.dor!"', "Tr0ub4.dor!"), 101: ("pwd: s3cr$t@~x next", "s3cr$t@~x"), 102: ("api_key = 'KQXWERTYZUIOPLKA'", "KQXWERTYZUIOPLKA"),
                102 + 1: ("token: eyJhbGci.eyJzdWIi.c2lnbmF0 end", "eyJhbGci.eyJzdWIi.c2lnbmF0")}
    rows += [(i, t) for i, (t, _) in odd_ones.items()] + [(200, "found KQXWERTYZUIOPLKAMNBV here"), (201, "The key: nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(docs, spark.createDataFrame([("nothing",), ("this",)], "word string"))
    got, texts = found.collect(), dict(rows)
    assert all(texts[r.doc_id][r.start:r.start + r.length] == r.candidate for r in got)
    assert {(i, v) for i, (_, v) in odd_ones.items()} <= {(r.doc_id, r.candidate) for r in got if r.is_secret}
    assert (200, "KQXWERTYZUIOPLKAMNBV") in {(r.doc_id, r.candidate) for r in got}
    assert not {"nothing", "this"} & {r.candidate for r in got if r.is_secret}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert all(clean[i] == t.replace(v, secrets.LABEL) for i, (t, v) in odd_ones.items())


def test_secrets_assigned_without_blanks(spark):
    """The name of NAME=value is no part of the candidate and counts as its neighbour."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        rows.append((i, [f"export {['TOKEN', 'MY_OWN_SERVICE_API_KEY'][i % 2]}={key} now", f"see http://h.io/x?api_key={key}&user=me now", f"file sha1={key} now"][i % 3], key))
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").drop("key")
    words = spark.createDataFrame([("word",)], "word string")
    found = secrets.scan(docs, words)
    got = {(r.doc_id, r.candidate): r.is_secret for r in found.collect()}
    assert {(i, k): i % 3 < 2 for i, _, k in rows}.items() <= got.items()
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert all(clean[i] == (t.replace(k, secrets.LABEL) if i % 3 < 2 else t) for i, t, k in rows)
    padded = secrets.candidates(spark.createDataFrame([(1, "is QUJDREVGR0hJSktMTU5PUFE9== end")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [r.candidate for r in padded] == ["QUJDREVGR0hJSktMTU5PUFE9=="]


def test_forest_on_held_out_findings(spark):
    """Trained on labelled findings of some documents, the forest judges those of others."""
    rng = random.Random(12)
    names = ["token", "api_key", "password", "secret"]
    others = ["sha1", "etag", "revision", "order id", "see", "file"]
    words = "river mill family kind while hands".split()

    def one(i):
        kind = rng.random()
        if kind < 0.4:
            key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.choice([20, 32, 40])))
            return f"the {rng.choice(words)} {rng.choice(names)} = {key} and", key, True
        if kind < 0.7:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            return f"the {rng.choice(words)} {rng.choice(others)} {key} and", key, False
        if kind < 0.85:
            key = str(rng.randint(10**15, 10**18))
            return f"number {key} of {rng.choice(words)}", key, False
        key = "-".join(rng.choice(words) for _ in range(4))
        return f"see http://host.org/{key}/{key} for", f"{key}/{key}", False

    made = [(i, *one(i)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    truth = {i: (key, secret) for i, _, key, secret in made}
    found = secrets.features(secrets.candidates(docs.where("doc_id < 600")), dictionary)
    label = F.udf(lambda i, c: float(truth[i][1]) if c in truth[i][0] or truth[i][0] in c else None, "double")
    labelled = found.withColumn("label", label("id", "candidate")).where("label is not null")
    judged = [r for r in secrets.scan(docs.where("doc_id >= 600"), dictionary, labelled=labelled).collect() if r.candidate in truth[r.doc_id][0] or truth[r.doc_id][0] in r.candidate]
    hits = sum(r.is_secret and truth[r.doc_id][1] for r in judged)
    assert len(judged) >= 290
    assert hits >= 0.97 * sum(truth[r.doc_id][1] for r in judged) and hits >= 0.97 * sum(r.is_secret for r in judged)


def test_stages_judge_rows_by_id_and_text(spark, sf):
    """Rows that share an id, or have none, stay or go each for itself in every stage."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(1).collect()]
    scores = {r.doc_id: r.kept for r in quality.score(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = next(texts[i] for i, k in sorted(scores.items()) if k and len(texts[i]) > 2000)
    bad = next(texts[i] for i, k in sorted(scores.items()) if not k and len(texts[i] or "") > 500)
    row = docs.first().asDict()
    add = lambda *pairs: docs.unionByName(spark.createDataFrame([{**row, "doc_id": i, "text": t} for i, t in pairs], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda name, d: sorted((str(r.doc_id), r.text) for r in stages[name](spark, d, sf).where("doc_id is null or doc_id = 900001").collect())
    rows = add((None, good), (None, bad), (900001, good), (900001, bad))
    assert seen("quality_classifier", rows) == sorted([("None", good), ("900001", good)])
    held = good[:1500] + " " + items[0]
    rows = add((None, good), (None, held), (900001, good), (900001, held))
    assert seen("benchmark_decontamination", rows) == sorted([("None", good), ("900001", good)])
    fresh = [" ".join(f"new{k}{i}" for i in range(80)) for k in range(2)]
    rows = add((None, fresh[0]), (None, fresh[1]), (900001, fresh[0]), (900001, fresh[0]))
    assert seen("simhash_near_dedup", rows) == sorted([("None", fresh[1]), ("900001", fresh[0])])
