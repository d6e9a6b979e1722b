"""Chunks by content: round trips, and bytes stored once."""

import random

from pyspark.sql import functions as F

from clausework.operators import landing as L
from clausework.operators.snapshots import Snapshots

FILES = "document_id string, file_name string, content binary"


def test_cuts_are_bounded_and_local():
    rng = random.Random(1)
    data = rng.randbytes(600_000)
    ends = L.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(L.LEAST <= s <= L.MOST for s in sizes[:-1]) and 20 < len(sizes) < 200
    pieces = {data[a:b] for a, b in zip([0, *ends], ends)}
    changed = data[:300_000] + b"a new page" + data[300_000:]
    ends = L.cuts(changed)
    again = [changed[a:b] for a, b in zip([0, *ends], ends)]
    assert sum(p not in pieces for p in again) <= 3  # only what lies at the change
    assert L.cuts(b"") == [] and L.cuts(b"x") == [1]
    assert L.cuts(b"\x07" * 200_000) == [L.MOST, 2 * L.MOST, 3 * L.MOST, 200_000]  # no cut in its content


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    data = random.Random(2).randbytes(100_000)
    whole = L.cuts(data)
    monkeypatch.setattr(L, "BLOCK", 1000)
    assert L.cuts(data) == whole


def test_round_trip_and_repeats(spark, tmp_path):
    rng = random.Random(3)
    big = rng.randbytes(300_000)
    files = [("a", "a.pdf", big), ("b", "b.txt", b"short"), ("c", "c.txt", b""), ("d", "d.doc", None), ("e", "e.txt", big[:150_000] + b"!" + big[150_000:]), ("b", "b.txt", b"short")]
    store = str(tmp_path / "s")
    df = spark.createDataFrame(files, FILES)
    assert L.land(df, store, "one") == 1 and L.land(df, store, "one") is None
    got = lambda: sorted((r.document_id, r.file_name, bytes(r.content)) for r in L.landed(spark, store).collect())
    want = sorted({(i, n, c or b"") for i, n, c in files})
    assert got() == want
    stored = lambda: Snapshots(spark, store).read(L.CHUNKS).agg(F.sum(F.octet_length("data"))).first()[0]
    first = stored()
    assert first < 1.4 * len(big)  # the changed copy shares its chunks
    # the same files as other documents: all are there, no byte more is stored
    assert L.land(df.withColumn("document_id", F.concat(F.lit("x"), "document_id")), store, "two") == 2
    assert stored() == first and got() == sorted(want + [(f"x{i}", n, c) for i, n, c in want])
    # a chunk that two batches stored at once is read once
    log = Snapshots(spark, store)
    log.commit("race", {L.CHUNKS: log.read(L.CHUNKS)})
    assert len(got()) == 2 * len(want) and got()[0][2] == big
    assert L.land(df.limit(0), store, "none") == 4 and len(got()) == 2 * len(want)
