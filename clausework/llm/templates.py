"""Benchmark decontamination by template canonicalisation (operator 9, native).

Texts and benchmark items are read as words without punctuation, lower-cased,
in which a number, a unit after or joined to a number, and a capitalised word
inside a sentence are typed placeholders (slots).  A capitalised word that
opens a sentence or a line may be a name or not, and is compared both as
itself and as a name, so that sentences may open with other names and lines
may be wrapped anew.  Windows of ``WINDOW`` words of documents and items that
agree word by word meet, so a question asked again with other numbers, names
or units still meets its template.  Windows that meet at one alignment of
document and item fill the same slots; the fillings are consistent when each
value of the item is replaced by one value throughout (equal numbers are one
value where the same word follows them: 2 pens at 2 euros are two).  A window
over a value that is replaced by several is dropped unless it is verbatim, and
a document holds an item when the remaining windows make up ``MIN_SHARE`` of
the item.

Most texts never make a window.  Every window of an item has an anchor: that
run of up to ``ANCHOR`` of its plain words whose hash is least, so neighbouring
windows share anchors.  A document can hold the window only where its own
words have the anchor, whatever its slots are, so the whole texts are hashed
once as runs of words and joined with the anchors; the pairs of document and
item that share enough anchors to reach ``MIN_SHARE`` are few, and only these
texts are canonicalised and compared, word by word, where an anchor stands.  A
window of slots alone has no plain words; it is met verbatim only, and its
first words are its anchor.

Only expressions, joins and aggregates of Spark are used, and no expression
repeats a group by backtracking.  Nothing is broadcast by a hint: the anchors
are a table of numbers whose size Spark knows, and past its bound the join is
a shuffle of hashes.

Cases: null and empty texts hold no window; an item with fewer than
``WINDOW`` words is one window of its own length, one below ``MIN_WORDS``
names nothing and is never found; equal items are each reported, items that
share an id by their own texts; a document is an id with a text: rows equal in
both count once, rows that share an id are judged by their own texts and told
apart by ``text_key``, a hash of the text; a null id is reported as null;
empty tables give an empty table.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import WORD_GAP, written

WINDOW = 8
MIN_WORDS = 5
MIN_SHARE = 0.5
# Words of an anchor, at most.
ANCHOR = 3

# A part after a mark belongs to the number unless a letter follows it.
NUMBER = r"(?<![\p{L}\p{N}])[+-]?\p{N}++(?:[.,:/]\p{N}++(?!\p{L}))*+(?![\p{L}\p{N}])"
UNITS = ("%|€|\\$|£|km|kg|cm|mm|m|g|mg|l|ml|s|ms|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|"
         "meters?|metres?|grams?|lit(?:er|re)s?|dollars?|euros?|cents?|percent|degrees?")
# A number joined to its unit.
FUSED = rf"(?<![\p{{L}}\p{{N}}])([+-]?\p{{N}}++(?:[.,:/]\p{{N}}++)*+)(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))"
# The slots of a canonical text: marks no text holds (control characters are blanked first).
NUM, UNIT, NAME = "\x01", "\x02", "\x03"
# Around a word that opens a sentence or line and may be a name.
OPEN, SHUT = "\x04", "\x05"
CONTROL = "".join(map(chr, range(9)))
CAPITALISED = r"\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
PUNCTUATION = r"[^\p{L}\p{N}\x20\x09-\x0D]+"


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key`` and ``t``, the text with control characters blanked and units apart from their numbers."""
    t = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.select("id", F.xxhash64("text").alias("text_key"), F.translate("text", CONTROL, " " * len(CONTROL)).alias("t"))
    return t.withColumn("t", F.when(F.col("t").rlike(r"\p{N}[\p{L}%€$£]"), F.regexp_replace("t", FUSED, "$1 ")).otherwise(F.col("t")))


def _norm(text: Column) -> Column:
    """Words as they are compared before any canonicalisation: lower-cased, without punctuation."""
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


def _canonical(clean: Column) -> Column:
    """The same words as ``clean`` has, lower-cased without punctuation, slots as marks, words that may be names between marks."""
    c = F.when(clean.rlike(r"\p{N}"), F.regexp_replace(F.regexp_replace(clean, NUMBER, NUM), rf"(?<={NUM})({WORD_GAP})(?:{UNITS})(?![\p{{L}}\p{{N}}])", "$1" + UNIT)).otherwise(clean)
    c = F.regexp_replace(c, rf"(?<=[\p{{L}}\p{{N}}{NUM}{UNIT},;][\x20\x09]){CAPITALISED}", NAME)
    c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}\x01-\x03][^\x20\x09-\x0D]?){CAPITALISED}", f"{OPEN}$0{SHUT}")
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\x01-\x05\x20\x09-\x0D]+", ""))


def _tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key`` and ``words`` of every text, a struct for each word:
    ``plain`` and ``named``, hashes of the word as itself and where it may be a
    name as a name; ``value``, the mark and filling of what may be a slot;
    ``maybe``, whether it is one only as a name; ``sure``, whether it is plain in
    any case; ``norm``, the word before canonicalisation, and ``shown``, after it."""
    t = _texts(rows, id_col, text_col)
    # words of mere punctuation are blanked, and one blank stands for several
    t = t.withColumn("t", F.regexp_replace("t", r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D%€$£]+(?![^\x20\x09-\x0D])", " "))
    t = t.withColumn("t", F.regexp_replace("t", r"[\x20\x09]{2,}", " "))
    t = t.withColumn("canon", _canonical(F.col("t")))
    # words stand at equal places in both; those left empty are dropped from both
    t = t.select("id", "text_key", F.split("canon", WORD_GAP).alias("w"), F.split("t", WORD_GAP).alias("raw"))
    t = t.select("id", "text_key", F.filter(F.arrays_zip("w", "raw"), lambda x: x["w"] != "").alias("both"))

    def word(x):
        w, shown = x["w"], F.translate(x["w"], OPEN + SHUT, "")
        maybe = w.startswith(OPEN)
        value = F.concat(F.translate(F.substring(w, 1, 1), OPEN, NAME), F.lower(F.regexp_replace(x["raw"], r"^[^\p{L}\p{N}%€$£+-]+|[^\p{L}\p{N}%€$£]+$", "")))
        return F.struct(F.xxhash64(shown).alias("plain"),
                        F.when(maybe, F.xxhash64(F.regexp_replace(w, f"^{OPEN}[^{SHUT}]*{SHUT}", NAME))).otherwise(F.xxhash64(shown)).alias("named"),
                        F.when(w.rlike(r"^[\x01-\x04]"), value).alias("value"), maybe.alias("maybe"), (~w.rlike(r"[\x01-\x05]")).alias("sure"),
                        _norm(x["raw"]).alias("norm"), shown.alias("shown"))

    return t.select("id", "text_key", F.transform("both", word).alias("words"))


def _gram(words: Column, start: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.xxhash64(length, F.slice(words, start, length))


def _item_windows(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The words of the items (``k, item, pos, plain, named, value, maybe, key, norm``) and their
    windows (``k, item, n, len, item_pos``) with anchors (``size, gram, offset``); ``verbatim`` has no plain word."""
    t = _tokens(items, item_col, text_col).where(F.size("words") >= MIN_WORDS).dropDuplicates(["id", "text_key"])
    t = t.select(F.concat(F.coalesce(F.col("id").cast("string"), F.lit(NUM)), F.lit(" "), F.col("text_key").cast("string")).alias("k"), F.col("id").alias("item"), "words")
    t = written(t, "item-words").withColumn("n", F.size("words"))
    follows = lambda i: F.coalesce(F.get("words", i + 1)["value"], F.get("words", i + 1)["shown"], F.lit(""))
    # the key under which a slot has to be filled alike: its value, of a number with what follows it
    key = lambda x, i: F.when(x["value"].startswith(NUM), F.concat(x["value"], F.lit(NUM), follows(i))).otherwise(x["value"])
    keyed = t.select("k", "item", F.posexplode(F.transform("words", lambda x, i: F.struct(x.alias("x"), key(x, i).alias("key")))).alias("pos", "s"))
    words = keyed.select("k", "pos", *(F.col(f"s.x.{c}").alias(c) for c in ("plain", "named", "value", "maybe", "norm")), "s.key")
    t = t.withColumn("len", F.least("n", F.lit(WINDOW)))
    t = t.select("k", "item", "n", "len", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("item_pos"))
    t = t.select("k", "item", "n", "len", "item_pos", F.slice("words", F.col("item_pos") + 1, F.col("len")).alias("win"))
    told = F.filter(F.transform("win", lambda x, o: F.struct(x["norm"].alias("norm"), o.alias("o"))), lambda x: x["norm"] != "")
    t = written(t.select("*", F.transform("win", lambda x: x["norm"]).alias("norms"), told.alias("told")), "item-windows")

    def runs(size: int) -> Column:
        """The least run of ``size`` plain words; null without one."""
        made = F.transform(F.sequence(F.lit(0), F.col("len") - size), lambda o: F.struct(
            _gram(F.col("norms"), o + 1, size).alias("gram"), o.alias("offset"), F.lit(size).alias("size"),
            F.forall(F.slice("win", o + 1, F.lit(size)), lambda x: x["sure"]).alias("ok")))
        return F.when(F.col("len") >= size, F.array_min(F.filter(made, lambda x: x["ok"])))

    told = F.transform("told", lambda x: x["norm"])
    size = F.least(F.size("told"), F.lit(ANCHOR))
    first = F.when(F.size("told") > 0, F.struct(_gram(told, F.lit(1), size).alias("gram"), F.get("told", F.lit(0))["o"].alias("offset"), size.alias("size"), F.lit(False).alias("ok")))
    t = t.select("k", "item", "n", "len", "item_pos", F.coalesce(*(runs(s) for s in range(ANCHOR, 0, -1)), first).alias("a")).where("a is not null")
    return words, t.select("k", "item", "n", "len", "item_pos", "a.size", "a.gram", "a.offset", (~F.col("a.ok")).alias("verbatim"))


def _grams(sizes: list[int], made) -> Column:
    """``made(i, size)`` at every place ``i`` (from 1) of ``norms`` that starts a run of a size."""
    runs = [F.when(F.size("norms") >= s, F.transform(F.sequence(F.lit(1), F.size("norms") - (s - 1)), lambda i: made(i, s))) for s in sizes]
    return F.flatten(F.array_compact(F.array(*runs)))


def _candidates(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, k``: the documents that have enough anchors of an item to hold it.

    Anchors of the full size decide.  The windows whose plain words give no such
    anchor are few in most items and taken as met; an item that could be held by
    them alone is asked for with all its anchors.
    """
    windows = F.col("n") - F.col("len") + 1
    per = anchors.groupBy("k").agg(F.sum(F.when(F.col("size") < ANCHOR, 1).otherwise(0)).alias("short"), (MIN_SHARE * F.max(windows)).alias("bar"))
    asked = anchors.select("k", "gram", "size").join(per, "k").where((F.col("size") == ANCHOR) | (F.col("short") >= F.col("bar")))
    asked = written(asked.select("k", "gram", "size", F.when(F.col("short") >= F.col("bar"), F.col("bar")).otherwise(F.col("bar") - F.col("short")).alias("bar")), "asked-anchors")
    sizes = sorted(asked.agg(F.collect_set("size")).first()[0])
    t = _texts(docs, id_col, text_col).select("id", "text_key", _norm(F.col("t")).alias("t"))
    t = t.select("id", "text_key", F.filter(F.split("t", WORD_GAP), lambda w: w != "").alias("norms"))
    grams = written(asked.select("gram").distinct(), "anchor-grams")
    met = (t.select("id", "text_key", F.explode(_grams(sizes, lambda i, s: _gram(F.col("norms"), i, s))).alias("gram"))
           .join(grams, "gram", "left_semi").distinct())
    # a window has one anchor, so these are its windows that may be met
    found = met.join(asked.select("gram", "k", "bar"), "gram").groupBy("id", "text_key", "k", "bar").count()
    return written(found.where("count >= bar").select("id", "text_key", "k"), "candidates")


def _met(docs: DataFrame, words: DataFrame, anchors: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """Windows of items met in documents: ``id, text_key, k, item, n, len, item_pos, shift`` and
    ``slots`` with the item's ``key``, the document's ``value``, whether it is an ``other`` value,
    and ``told``: false where the words are equal and may be no name."""
    wanted = _candidates(docs, anchors, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("own_key", F.xxhash64("text"))
    one = wanted.select(F.col("id").alias("wanted_id"), "text_key").distinct()
    rows = rows.join(one, rows["id"].eqNullSafe(one["wanted_id"]) & (F.col("own_key") == F.col("text_key")), "left_semi").dropDuplicates(["id", "own_key"])
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])
    told = F.filter(F.transform("words", lambda x, i: F.struct(x["norm"].alias("norm"), i.alias("pos"))), lambda x: x["norm"] != "")
    texts = written(_tokens(rows, "id", "text").select("id", "text_key", "words", told.alias("told")), "candidate-words")
    texts = texts.select("id", "text_key", F.size("words").alias("m"), "words", F.col("told.norm").alias("norms"), F.col("told.pos").alias("places"))
    made = _grams(sizes, lambda i, s: F.struct(_gram(F.col("norms"), i, s).alias("gram"), F.get("places", i - 1).alias("place")))
    grams = texts.select("id", "text_key", "m", F.explode(made).alias("g")).select("id", "text_key", "m", "g.*")
    starts = (grams.join(anchors, "gram").withColumn("start", F.col("place") - F.col("offset")).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("m"))))
    wanted = wanted.select(F.col("id").alias("c_id"), F.col("text_key").alias("c_key"), F.col("k").alias("c_k"))
    starts = (starts.join(wanted, starts["id"].eqNullSafe(wanted["c_id"]) & (starts["text_key"] == wanted["c_key"]) & (starts["k"] == wanted["c_k"]), "left_semi")
              .select("id", "text_key", "k", "item", "n", "len", "item_pos", "start", "verbatim", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("j")))
    starts = starts.withColumns({"pos": F.col("start") + F.col("j"), "ipos": F.col("item_pos") + F.col("j")})
    own = texts.select("id", "text_key", F.posexplode("words").alias("pos", "x")).select("id", "text_key", "pos", F.col("x").alias("d"))
    theirs = words.select(F.col("k").alias("i_k"), F.col("pos").alias("i_pos"), F.struct("plain", "named", "value", "maybe", "key", "norm").alias("e"))
    pairs = (starts.join(own, same(starts, own) & (starts["pos"] == own["pos"])).drop(own["id"], own["text_key"], own["pos"])
             .join(theirs, (F.col("k") == F.col("i_k")) & (F.col("ipos") == F.col("i_pos"))))
    d, e = (lambda c: F.col(f"d.{c}")), (lambda c: F.col(f"e.{c}"))
    equal, named = d("plain") == e("plain"), d("named") == e("named")
    agree = F.when(F.col("verbatim"), d("norm") == e("norm")).otherwise(equal | named)
    slot = F.when(e("value").isNotNull() & d("value").isNotNull() & named, F.struct(
        e("key").alias("key"), d("value").alias("value"), (d("value") != e("value")).alias("other"), (~(equal & e("maybe"))).alias("told")))
    keys = ["id", "text_key", "k", "item", "n", "len", "item_pos", "start"]
    met = pairs.groupBy(*keys).agg(F.sum(agree.cast("int")).alias("agreed"), F.collect_list(slot).alias("slots")).where(F.col("agreed") == F.col("len"))
    return met.select(*keys[:-1], (F.col("start") - F.col("item_pos")).alias("shift"), "slots")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document (id and text) and item it holds: ``id_col``, ``item_col``,
    ``text_key`` (``xxhash64`` of the text, null as empty), ``hit_windows`` of the item's
    ``item_windows``, and whether it is ``reworded`` (some slot filled otherwise than in the item)."""
    words, anchors = _item_windows(items, item_col, item_text_col)
    anchors = written(anchors, "anchors")
    sizes = sorted(anchors.agg(F.collect_set("size")).first()[0])
    if not sizes:
        return docs.limit(0).select(F.col(id_col), F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(0).cast("long").alias("text_key"),
                                    F.lit(0).cast("long").alias("hit_windows"), F.lit(0).cast("long").alias("item_windows"), F.lit(False).alias("reworded"))
    met = written(_met(docs, words, anchors, sizes, id_col, text_col), "met-windows")
    at = ["id", "text_key", "k", "shift"]
    # the values of an item that an alignment replaces by more than one value
    broken = (met.where(F.size("slots") > 0).select(*at, F.explode("slots").alias("s"))
              .groupBy(*at, "s.key").agg(F.min("s.value").alias("lo"), F.max("s.value").alias("hi")).where("lo != hi")
              .groupBy(*at).agg(F.collect_set("key").alias("broken")))
    told = F.filter("slots", lambda s: s["told"])
    spots = met.select(*at, "item", "item_pos", "n", "len", F.transform(told, lambda s: s["key"]).alias("keys"), F.exists(told, lambda s: s["other"]).cast("int").alias("other"))
    same = [spots[c].eqNullSafe(broken[c]) for c in at]
    held = (spots.join(broken, same[0] & same[1] & same[2] & same[3], "left")
            .where((F.col("other") == 0) | F.col("broken").isNull() | ~F.arrays_overlap("keys", "broken")))
    once = held.groupBy(*(spots[c] for c in at[:3]), "item", "item_pos").agg(F.first("n").alias("n"), F.first("len").alias("len"), F.min("other").alias("other"))
    return (once.groupBy("id", "text_key", "k", "item").agg(F.count("*").alias("hit_windows"), F.max(F.col("n") - F.col("len") + 1).cast("long").alias("item_windows"),
                                                            F.max("other").alias("other"))
            .where(F.col("hit_windows") >= MIN_SHARE * F.col("item_windows"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "text_key", "hit_windows", "item_windows", (F.col("other") == 1).alias("reworded")))
