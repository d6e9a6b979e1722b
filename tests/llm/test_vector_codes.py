"""Ball k-means against plain k-means, on small and odd tables."""

import random

import numpy as np

from clausework.llm import vector_codes as V


def plain(rows, parts, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry; rows in id order."""
    x = [[int(np.floor(4096 * float(np.float32(c)))) for c in v] for _, v in rows]
    cuts = V.cuts_of(len(x[0]), parts)
    codes, errors, books = [[] for _ in x], [0] * len(x), []
    for a, b in zip(cuts, cuts[1:]):
        cut = [v[a:b] for v in x]
        book = [list(v) for v in cut[:entries]]
        near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            own = [near(v)[1] for v in cut]
            for k in range(len(book)):
                held = [v for v, o in zip(cut, own) if o == k]
                if held:
                    book[k] = [sum(c) // len(held) for c in zip(*held)]
        for i, v in enumerate(cut):
            d, k = near(v)
            codes[i].append(k)
            errors[i] += d
        books.append(book)
    return codes, errors, books


def vectors(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.02 if i % 3 else 0.2) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_plain_kmeans(spark):
    for dim, parts, entries, n in ((16, 8, 16, 300), (11, 4, 5, 120), (8, 2, 16, 7)):
        rows = vectors(n, dim, n)
        rows += [(n + i, rows[i % n][1]) for i in range(n // 3)]  # repeated vectors
        df = spark.createDataFrame([(i, v, i % 4 if i % 5 else None, "x") for i, v in rows], "vec_id long, v array<float>, label int, codes string").repartition(5)
        coded, books = V.compress(df, "vec_id", "v", ["label"], parts=parts, entries=entries, rounds=4)
        codes, errors, want = plain(rows, parts, entries, 4)
        assert [b.tolist() for b in books.entries] == want
        got = {r.vec_id: r for r in V.with_label_errors(coded, "label").collect()}
        assert {i: (list(r.codes), r.error) for i, r in got.items()} == {i: (c, e) for (i, _), c, e in zip(rows, codes, errors)}
        totals = {}
        for (i, _), e in zip(rows, errors):
            key = i % 4 if i % 5 else None
            totals[key] = totals.get(key, 0) + e
        assert all(r.label_error == totals[r.label] for r in got.values())


def test_rings_leave_out_entries_and_keep_ties():
    """Equal distances go to the lower index, also between equal entries; cores are not compared."""
    entries = np.array([[0, 0], [10, 0], [10, 0], [200, 0]], np.int64)
    x = np.array([[5, 0], [9, 0], [1, 0], [199, 0], [105, 0]], np.int64)
    for own in ([0, 2, 0, 3, 3], [0, 0, 0, 0, 0], [1, 2, 2, 2, 2]):
        own = np.array(own)
        far = np.array([max([np.hypot(*(x[i] - entries[k])) for i in np.flatnonzero(own == k)], default=0) for k in range(4)])
        code, best = V.nearest(x, own, entries, far, np.zeros(4, bool))
        assert code.tolist() == [0, 1, 0, 3, 1] and best.tolist() == [25, 1, 1, 1, 9025]
    asked = []
    held = V._squares
    V._squares = lambda a: asked.append(a.shape) or held(a)
    try:
        V.nearest(x, np.array([0, 1, 0, 3, 1]), entries, np.array([5.0, 95.0, 0.0, 1.0]), np.zeros(4, bool))
    finally:
        V._squares = held
    # the gaps, the own distances, and only rows outside a stable core against neighbours
    assert len(asked) > 2 and all(len(s) == 2 and s[0] < len(x) for s in asked[2:])


def test_odd_rows(spark):
    good = [(i, [float(i % 7), float(i % 3)], 1) for i in range(20)]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None], 1), (93, [float("nan"), 1.0], 1), (94, [float("inf"), 1.0], 1),
           (95, [1.0], 1), (96, [1.0, 2.0, 3.0], 1), (97, [1e30, 0.0], 1)]
    rows = [*good, *bad, (None, [3.0, 3.0], None), (4, [0.5, 0.25], 2), (4, [0.5, 0.25], 2)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int").selectExpr("*", "'c' AS x", "1 AS error", "2 AS id", "3 AS dists")
    coded, _ = V.compress(df, "vec_id", "v", ["label"], parts=2, entries=4, rounds=2)
    got = coded.collect()
    assert sorted(map(str, (r.vec_id for r in got))) == sorted(map(str, [*range(20), None, 4, 4]))
    none, books = V.compress(df.limit(0), "vec_id", "v", ["label"])
    assert V.with_label_errors(none, "label").count() == 0 and books.entries == [] and len(books.sha256()) == 64
    assert V.with_label_errors(V.compress(df.where("vec_id = 95"), "vec_id", "v", ["label"], parts=1)[0], "label").count() == 1
