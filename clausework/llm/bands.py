"""Quality rules by compression bands (operator 8).

A text's zstandard ratio (bytes in, over bytes out) is taken over the whole
text and over fixed chunks of ``CHUNK_BYTES``.  Prose of a given length
compresses within a band: a ratio above it is repetitive text, below it text
that does not compress.  The bands widen with the length, since a longer
text gives the compressor more to refer to.  A document is kept when its
whole ratio and nearly all its chunks lie within their bands.

Beside the bands stand the base measures of a document (``BASE_COLUMNS``);
a document below 50 words, or with over half its words in repeated 3-word
windows, is rejected before any band is asked.

Cases: a null text is an empty one (no words: rejected by the base rule); a
text of any length is read whole, its chunks one after another; repeated
rows each give a row; an empty table gives an empty table.  Input columns
named as an output column are replaced by it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = 3
CHUNK_BYTES = 2048
# A last chunk shorter than this goes with the one before.
LEAST_CHUNK = 1024
# (bytes from, least ratio, most ratio) of a whole text.
WHOLE_BANDS = ((0, 0.0, 4.0), (128, 0.75, 3.2), (256, 1.0, 3.2), (512, 1.3, 3.2), (1024, 1.5, 3.6), (4096, 1.7, 4.0),
               (16384, 1.9, 4.6), (65536, 2.0, 6.0))
CHUNK_BAND = (1.3, 3.6)
# Share of a text's chunks that must lie in the band.
CHUNK_SHARE = 0.75
# Fixed values of the contract.
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE_COLUMNS = [*MEASURES, "base_failed"]


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split()]
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(ids, ids[1:], ids[2:]))
    repeated = {w for w, n in Counter(windows).items() if n > 1}
    covered = 0
    if repeated:
        reach = 0
        for k, w in enumerate(windows):
            if w in repeated:
                covered += k + 3 - max(k, reach)
                reach = k + 3
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), covered


def band_of(n_bytes: int) -> tuple[float, float]:
    return WHOLE_BANDS[bisect_right(WHOLE_BANDS, n_bytes, key=lambda b: b[0]) - 1][1:]


class Bands:
    """Ratios of a text against their bands, with one compressor for a task."""

    def __init__(self):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def ratio(self, data) -> float:
        return len(data) / len(self.packer.compress(data))

    def judge(self, text: str) -> tuple[float, int, int, bool]:
        """Whole ratio, chunks, chunks out of their band, and whether both laws hold."""
        data = memoryview(text.encode("utf-8", "surrogatepass"))
        if not len(data):
            return 0.0, 0, 0, False
        whole = self.ratio(data)
        least, most = band_of(len(data))
        starts = list(range(0, len(data), CHUNK_BYTES))
        if len(starts) > 1 and len(data) - starts[-1] < LEAST_CHUNK:
            starts.pop()
        out = 0
        if len(starts) > 1:  # one chunk is the whole text again
            low, high = CHUNK_BAND
            for a, b in zip(starts, [*starts[1:], len(data)]):
                out += not low <= self.ratio(data[a:b]) <= high
        n = len(starts)
        return whole, n, out, least <= whole <= most and out <= (1 - CHUNK_SHARE) * n


def quality_rules(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, the base measures, ratios and verdicts of each whole text."""
    made = [*[T.StructField(c, T.LongType()) for c in MEASURES], T.StructField("whole_ratio", T.DoubleType()),
            T.StructField("n_chunks", T.LongType()), T.StructField("n_chunks_out", T.LongType()), T.StructField("in_bands", T.BooleanType())]
    kept = [c for c in carry if c not in {*(f.name for f in made), "base_failed", "kept"}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *made])

    def run(batches):
        import pyarrow as pa

        bands = Bands()
        types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            column = batch.column(len(kept))
            rows = []
            for i in range(batch.num_rows):
                text = column[i].as_py() or ""
                rows.append((*base_measures(text), *bands.judge(text)))
            cols = zip(*rows) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), t) for c, t in zip(cols, types))], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
            .withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_bands")))
