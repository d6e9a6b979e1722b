"""Streams that share a store."""

from pyspark.sql import functions as F

from clausework.sources.intake import document_id
from clausework.streaming.intake_stream import start_intake_stream


def test_a_second_stream_adds_to_the_store(spark, tmp_path):
    store = str(tmp_path / "store")

    def intake(name, checkpoint):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.txt").write_text(f"Payment of the {name} parcel falls due in spring.")
        start_intake_stream(spark, str(folder), store, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r.file_name for r in spark.read.parquet(f"{store}/documents").collect())

    assert intake("one", "first") == ["one.txt"]
    assert intake("two", "second") == ["one.txt", "two.txt"]
    # the first stream started again has nothing new to take in
    start_intake_stream(spark, str(tmp_path / "one"), store, str(tmp_path / "first")).awaitTermination()
    assert spark.read.parquet(f"{store}/documents").count() == 2


def test_files_of_a_batch_are_read_once(spark, tmp_path):
    """F2: many files are one micro-batch by default, and each is opened once."""
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(1200):
        (folder / f"f{i}.txt").write_text(f"Payment of parcel {i} falls due in the spring.")
    query = start_intake_stream(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1200]
    assert spark.read.parquet(str(tmp_path / "store/documents")).count() == 1200


def test_the_driver_holds_listings_and_not_files(spark, tmp_path):
    """the source's log names a listing of a batch's files, not each of them; folders, hidden and empty files read as before."""
    folder = tmp_path / "landing"
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "_left").mkdir()
    names = [f"a {i}%41é.txt" for i in range(40)] + [f"deep/er/b{i}.txt" for i in range(20)]
    for n in [*names, "_hidden.txt", ".dot.txt", "_left/out.txt", "half._COPYING_", "_k=v.txt"]:
        (folder / n).write_text(f"Payment of parcel {n} falls due in the spring.")
    (folder / "empty.txt").write_text("")
    query = start_intake_stream(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "ckpt"), max_files_per_trigger=25)
    query.awaitTermination()
    log = [line for f in (tmp_path / "ckpt/sources/0").iterdir() if f.name.isdigit() for line in f.read_text().splitlines() if line.startswith("{")]
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(batches) == 61 and max(batches) <= 25 and len(log) == len(batches)
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).collect()
    ids = spark.createDataFrame([(r.path, int(r.modificationTime.timestamp() * 1000 + 0.5) * 1000, r.length) for r in want], "path string, mtime_micros long, length long")
    ids = {r[0] for r in ids.select(document_id(F.col("path"), F.col("mtime_micros"), F.col("length"))).collect()}
    assert {r.document_id for r in spark.read.parquet(str(tmp_path / "store/documents")).collect()} == ids and len(ids) == 61
