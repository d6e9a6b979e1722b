"""Base rules, dynamic programming and the trained field against brute force."""

import itertools
import math
import random
import re

from clausework.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {0: lambda s: True, 1: lambda s: all(int(p) <= 255 for p in s.split(".")), 3: lambda s: 9 <= len(digits(s)) <= 15,
          2: lambda s: 12 <= len(digits(s)) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits(s)))) % 10 == 0}
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if ok[k](m[0]))


def test_base_spans_equal_the_expressions():
    rng = random.Random(4)
    bits = ["1", "25", "0", "999", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "x_y%", "4111111111111111", "4111 1111 1111 1111", "+1 (826) 555-4081", "é", "\n", "²"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text)[0] == plain_base(text), text


def test_long_runs_take_time_in_proportion():
    n = 300_000
    for text in ("a" * n, "1" * n, "1 " * n, "1." * n, "+1" * n, "a@" * n, "a@b." * n, "+1 " + "-" * n, "." * n, "1,2," * n):
        pii.base_spans(text)
        pii.regions(text)
    assert len(pii.base_spans("1.2.3.4." * 10_000)[0]) >= 10_000


def all_segmentations(lattice):
    n = len(lattice)
    ways = [[] for _ in range(n + 1)]
    ways[0] = [[]]
    for j in range(1, n + 1):
        segs = [(j - 1, pii.OUTSIDE, lattice.outside[j - 1]), *lattice.ending[j]]
        ways[j] = [w + [(i, j, k, f)] for i, k, f in segs for w in ways[i]]
    return ways[n]


def test_programming_equals_enumeration():
    rng = random.Random(2)
    for text in ("+1 (826) 555-4081", "1.2.3.4 1.2.3.4", "4111111111111111 12345678", "a.b@c.de", "1234567", "x at y dot z"):
        lattice = pii.Lattice(text, "call ", "")
        names = {f for segs in lattice.ending for *_, made in segs for f in made} | {f for o in lattice.outside for f in o}
        names |= {f"{a}>{b}" for a, b in itertools.product(pii.SemiCRF.LABELS, repeat=2)}
        model = pii.SemiCRF({f: rng.gauss(0, 1) for f in names})
        score, best = {}, None
        for way in all_segmentations(lattice):
            before, total = pii.OUTSIDE, 0.0
            for _, _, k, made in way:
                total += sum(model.weights[f] for f in made) + model.weights[f"{model.LABELS[before]}>{model.LABELS[k]}"]
                before = k
            spans = tuple((lattice.starts[i], k, lattice.ends[j - 1]) for i, j, k, _ in way if k != pii.OUTSIDE)
            score[spans] = total
            best = total if best is None else max(best, total)
        assert math.isclose(model.log_partition(lattice), math.log(sum(map(math.exp, score.values()))), rel_tol=1e-9)
        assert math.isclose(score[tuple(model.decode(lattice))], best, rel_tol=1e-9)
        # the gradient is that of the log likelihood
        gold = list(rng.choice(sorted(score)))
        grad = model.gradient(lattice, gold)
        for f in rng.sample(sorted(names), min(8, len(names))):
            def likelihood(step):
                moved = pii.SemiCRF({**model.weights, f: model.weights[f] + step})
                way = next(w for w in all_segmentations(lattice) if tuple((lattice.starts[i], k, lattice.ends[j - 1]) for i, j, k, _ in w if k != pii.OUTSIDE) == tuple(gold))
                before, total = pii.OUTSIDE, 0.0
                for _, _, k, made in way:
                    total += sum(moved.weights[x] for x in made) + moved.weights[f"{model.LABELS[before]}>{model.LABELS[k]}"]
                    before = k
                return total - moved.log_partition(lattice)
            assert abs((likelihood(1e-4) - likelihood(-1e-4)) / 2e-4 - grad[f]) < 1e-4


def corpus(n, seed):
    rng = random.Random(seed)

    def card():
        head = "".join(rng.choice("0123456789") for _ in range(15))
        return next(head + c for c in "0123456789" if pii.luhn(head + c))

    make = [lambda: f"the.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"]
    words = "rest of the and tion ingsh that on year 2024 in 12 with".split()
    rows = []
    for i in range(n):
        text, spans = "", []
        for _ in range(rng.randint(0, 3)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + " "
            for _ in range(rng.choice([1, 1, 2])):
                kind = rng.randrange(4)
                one = make[kind]()
                spans.append((len(text), kind, len(text) + len(one)))
                text += one + " "
        text += "order " + "".join(rng.choice("0123456789") for _ in range(rng.choice([7, 8, 9]))) + " end"
        rows.append((i, text, spans))
    return rows


def test_field_finds_what_adjacent_matches_hide(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    base_hits = hits = wanted = extra = 0
    for i, text, spans in rows:
        base = {(s.start, s.rank, s.stop) for s in got[i].base}
        added = {(s.start, s.rank, s.stop) for s in got[i].added}
        assert sorted(base) == plain_base(text)
        assert not any(a[0] < b[2] and b[0] < a[2] for a in added for b in base)
        wanted += len(spans)
        base_hits += len(base & set(spans))
        hits += len((base | added) & set(spans))
        extra += len(added - set(spans))
    assert base_hits < 0.9 * wanted and hits >= 0.97 * wanted and extra <= 0.01 * wanted


def test_odd_tables(spark):
    texts = [None, "", "\n", "no data here", "1" * 5000, "+1 (826) 555-4081 190.137.223.204 du", "²²²²²²²²²", "a@b.c_d@e.f", "9" * 12 + " ퟿ 😀 1.2.3.4"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "c", 1) for i, t in enumerate(texts)] + [(5, texts[5], "c", 1)], "doc_id long, text string, regions string, added int")
    rows = pii.scan(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: [(s.start, s.rank, s.stop) for s in r.base] for r in rows if r.doc_id is not None} == {i: plain_base(t or "") for i, t in enumerate(texts) if i != 3}
    assert pii.scan(docs.limit(0)).count() == 0
    # nothing to learn from: base spans only
    plain = pii.scan(docs.where("doc_id in (0, 1, 2)")).collect()
    assert len(plain) == 3 and all(r.base == [] and r.added == [] for r in plain)


def test_query_columns(spark, sf):
    rows = queries.op11_semi_crf(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import hashlib
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
