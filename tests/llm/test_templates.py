"""Template decontamination against a plain restatement, on long and odd texts."""

import random

import regex
from pyspark.sql import functions as F

from clausework.llm import templates as T

GAP = r"[\x20\x09-\x0D]+"


def plain_words(text):
    """``(plain, may be a name, slot mark, value, norm)`` of each canonical word."""
    text = regex.sub(r"[\x00-\x08]+", " ", text or "")
    unit = T.UNITS.replace("\\$", "$").replace("$", r"\$")
    number = r"(?<![\p{L}\p{N}])[+-]?\p{N}+(?:[.,:/]\p{N}+)*(?![\p{L}\p{N}])"
    text = regex.sub(rf"(?<![\p{{L}}\p{{N}}])([+-]?\p{{N}}+(?:[.,:/]\p{{N}}+)*)(?=(?:{unit})(?![\p{{L}}\p{{N}}]))", r"\1 ", text)
    raw = [w for w in regex.split(GAP, text) if regex.search(r"[\p{L}\p{N}%€$£]", w)]
    out = []
    line = regex.sub(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D%€$£]+(?![^\x20\x09-\x0D])", " ", text)
    line = regex.sub(r"[\x20\x09]{2,}", " ", line)
    c = regex.sub(number, "\x01", line)
    c = regex.sub(rf"(?<=\x01)({GAP})(?:{unit})(?![\p{{L}}\p{{N}}])", "\\1\x02", c)
    c = regex.sub(r"(?<=[\p{L}\p{N}\x01\x02,;][\x20\x09])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "\x03", c)
    c = regex.sub(r"(?<![\p{L}\p{N}\x01-\x03][^\x20\x09-\x0D]?)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "\x04\\g<0>\x05", c)
    c = regex.sub(r"[^\p{L}\p{N}\x01-\x05\x20\x09-\x0D]+", "", c).lower()
    for w, r in zip(regex.split(GAP, c), regex.split(GAP, line)):
        if not w:
            continue
        value = regex.sub(r"^[^\p{L}\p{N}%€$£+-]+|[^\p{L}\p{N}%€$£]+$", "", r).lower()
        mark = {"\x04": "\x03"}.get(w[0], w[0]) if w[0] in "\x01\x02\x03\x04" else None
        shown = w.replace("\x04", "").replace("\x05", "")
        named = regex.sub("^\x04[^\x05]*\x05", "\x03", w) if w[0] == "\x04" else shown
        out.append((shown, named, mark + value if mark else None, w[0] == "\x04", regex.search(r"[\x01-\x05]", w) is None,
                    regex.sub(r"[^\p{L}\p{N}]+", "", r).lower()))
    del raw
    return out


def plain_contaminated(docs, items):
    found = {}
    for i, text in items:
        e = plain_words(text)
        if len(e) < T.MIN_WORDS:
            continue
        n = min(len(e), T.WINDOW)
        keys = [v[2] + "\x01" + ((e[k + 1][2] or e[k + 1][0]) if k + 1 < len(e) else "") if v[2] and v[2][0] == "\x01" else v[2] for k, v in enumerate(e)]
        for d, body in docs:
            w = plain_words(body)
            met = []
            for p in range(len(e) - n + 1):
                win = e[p:p + n]
                verbatim = not any(x[4] for x in win)
                for s in range(len(w) - n + 1):
                    if all((a[5] == b[5]) if verbatim else (a[0] == b[0] or a[1] == b[1]) for a, b in zip(w[s:s + n], win)):
                        slots = [(keys[p + j], a[2], a[2] != b[2], not (a[0] == b[0] and b[3])) for j, (a, b) in enumerate(zip(w[s:s + n], win)) if b[2] and a[2] and a[1] == b[1]]
                        met.append((p, s - p, slots))
            values = {}
            for p, shift, slots in met:
                for key, value, _, _ in slots:
                    values.setdefault((shift, key), set()).add(value)
            held = {}
            for p, shift, slots in met:
                told = [x for x in slots if x[3]]
                other = any(x[2] for x in told)
                if not other or not any(len(values[shift, x[0]]) > 1 for x in told):
                    held[p] = min(held.get(p, True), other)
            if held and len(held) >= T.MIN_SHARE * (len(e) - n + 1):
                found[d, i] = (len(held), any(held.values()))
    return found


def test_equals_plain_restatement(spark):
    rng = random.Random(9)
    items = [(1, "Tom has 5 apples and gives 2 to Anna. Anna eats one apple and keeps the rest. How many apples does Anna have?"),
             (2, "A train runs 60km in 2h and a car runs 80km in 3h on the same road to town"), (3, "we like it so"), (4, "one two three four five"),
             (5, "3 5 8 13 21 34 55 89 144 233"), (6, "12 % 15 % 20 % 7 % 9 %"), (7, "Anna Berta Clara Dora Emma Frieda Gerda Hanna Ida"), (8, "the end of the end of the end of the end of the end")]
    names, words = ["Max", "Clara", "Tom", "Anna"], "apples and gives to the rest on same road town how many does have in a of end".split()
    texts = [t for _, t in items]
    for _ in range(60):
        t = rng.choice(texts[:2] + texts[4:])
        for a in ("Tom", "Anna"):
            if rng.random() < 0.5:
                t = t.replace(a, rng.choice(names))
        t = regex.sub(r"\d+", lambda m: m[0] if rng.random() < 0.6 else str(rng.randint(1, 99)), t)
        cut = rng.randint(0, 20)
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice([" ", ". ", "\n", " - "]) + t[rng.choice([0, 0, cut]):]
        texts.append(t.replace(" ", rng.choice([" ", "  ", "\n"]), 3))
    docs = list(enumerate(texts)) + [(900, None), (901, "")]
    got = T.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.hit_windows, r.reworded) for r in got} == plain_contaminated(docs, items)
    assert len(got) > 20


def test_texts_that_no_regex_may_recurse_on(spark):
    """A million groups of a number, and names at every line start."""
    item = "If Anna buys 12 apples at 3 euros each and Anna sells 12 apples, how much money does Anna have now"
    docs = [(1, "1" + ",2" * 1_000_000 + " " + item), (2, "Paris\n" * 100_000 + item), (3, "If " * 50_000), (4, "-" * 200_000 + "a"), (5, "1:" * 200_000 + item.replace("12", "40"))]
    got = T.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.reworded for r in got} == {1: False, 2: False, 5: True}


def test_rows_that_share_an_id(spark):
    item = "If Anna buys 12 apples at 3 euros each and Anna sells 12 apples, how much money does Anna have now"
    docs = spark.createDataFrame([(None, item), (None, "something else that is not in it at all"), (7, item), (7, "another text"), (7, item)], "doc_id long, text string")
    got = T.contaminated(docs, spark.createDataFrame([(1, item), (1, "quite another item of the benchmark with some more words"), (None, item)], "item_id long, text string")).collect()
    key = docs.select(F.xxhash64(F.lit(item))).first()[0]
    assert sorted(((r.doc_id, r.item_id, r.text_key) for r in got), key=str) == sorted([(d, i, key) for d in (None, 7) for i in (None, 1)], key=str)
