"""Vector code compression by ball k-means (operator 13).

Vectors become integers (``floor(SCALE * x)``) and are cut into equal parts;
each part position has a codebook of a few entries, refined by Lloyd rounds
whose assignments are exact.  The assignments are those of ball k-means: the
parts of an entry lie in a ball around it, whose radius is known from the
round before (the farthest member, and how far the entry has moved since).
Only entries at most two radii away are its neighbours.  A part at distance
``d`` can change only to neighbours at most ``2 d`` away: parts below half
the nearest gap are the stable core and cost one distance, those farther out
lie in rings, and a part in the m-th ring is compared with the m nearest
neighbours and no others.  An entry that stands still with all its neighbours
keeps its whole ball.  All comparisons are on integers, ties go to the
lower index.

Each round is one pass over a written table that holds every vector with its
codes; counts, sums and radii are added up in the tasks and by Spark, so the
driver sees ``parts * entries`` small rows whatever the corpus.  A round's
table is deleted when the next one is written.

Cases: rows without a vector, with an empty one, or with a null, NaN or
infinite component are dropped, and so are components of ``MAX_COMPONENT``
or more, whose squared distances would not fit 64 bits.  The vector with the
smallest id (nulls last, ties by the vectors) gives the dimension; vectors of
another length are dropped.  A dimension that the parts do not divide is cut
at ``part * dimension // parts``.  With fewer rows than entries there are as
many entries as rows.  Repeated ids are rows of their own; null labels are
one label; an empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import drop_written, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MAX_COMPONENT = float(1 << 14)


@dataclass
class Codebooks:
    """The entries of each part position, as integers."""
    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for entry in book.tolist() for v in entry).encode()).hexdigest()


def cuts_of(dim: int, parts: int) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, a)


def nearest(x: np.ndarray, own: np.ndarray, entries: np.ndarray, radii: np.ndarray, still: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row of ``x`` and its squared distance.

    ``own`` is each row's entry so far, ``radii`` bounds the distances of an
    entry's rows to it, ``still`` says which entries are where they were when
    ``own`` was found.
    """
    gaps = _squares(entries[:, None, :] - entries[None, :, :])
    code, best = own.copy(), _squares(x - entries[own])
    for i in np.unique(own):
        near = [j for j in range(len(entries)) if j != i and gaps[i, j] <= 4 * radii[i] ** 2]
        if not near or (still[i] and still[near].all()):
            continue
        near.sort(key=lambda j: (gaps[i, j], j))
        rows = np.flatnonzero(own == i)
        # how many neighbours are near enough to be as near as the entry: 0 in the stable core
        ring = np.searchsorted(gaps[i, near], 4 * best[rows], side="right")
        out = np.argsort(-ring, kind="stable")
        rows, ring = rows[out], ring[out]
        for m, j in enumerate(near):
            asked = rows[:np.searchsorted(-ring, -m, side="left")]
            if not len(asked):
                break
            d = _squares(x[asked] - entries[j])
            won = (d < best[asked]) | ((d == best[asked]) & (j < code[asked]))
            code[asked[won]], best[asked[won]] = j, d[won]
    return code, best


_ROW = "codes binary, dists array<bigint>"


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def _assign(rows: DataFrame, books: list[np.ndarray], radii: list[np.ndarray], still: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """``rows`` with the codes of every part under ``books``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("codes", "dists")) + ", " + _ROW
    parts = len(books)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            x, own = _matrix(batch.column(names.index("x")), cuts[-1]), _codes(batch.column(names.index("codes")), parts)
            found = [nearest(x[:, cuts[p]:cuts[p + 1]], own[:, p], books[p], radii[p], still[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            dists = np.stack([d for _, d in found], axis=1)
            offsets = pa.array(np.arange(0, dists.size + 1, parts), pa.int32())
            kept = [n for n in names if n not in ("codes", "dists")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(n)) for n in kept), pa.array([r.tobytes() for r in codes], pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(dists.ravel(), pa.int64()))], names=[*kept, "codes", "dists"])

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, parts: int, entries: int, cuts: list[int]) -> list:
    """Per part, entry and position the sum of the components; at position -1
    the rows and the largest squared distance."""
    def run(batches):
        import pyarrow as pa

        widest = max(b - a for a, b in zip(cuts, cuts[1:]))
        total = np.zeros((parts, entries, widest + 1), np.int64)
        most = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes, dists = _matrix(batch.column(0), cuts[-1]), _codes(batch.column(1), parts), _matrix(batch.column(2), parts)
            for p in range(parts):
                total[p, :, -1] += np.bincount(codes[:, p], minlength=entries)
                np.maximum.at(most[p], codes[:, p], dists[:, p])
                np.add.at(total[p, :, :cuts[p + 1] - cuts[p]], codes[:, p], x[:, cuts[p]:cuts[p + 1]])
        p, e, k = np.nonzero(total)  # an entry without members has no rows
        value, far = total[p, e, k], np.where(k == widest, most[p, e], 0)
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in (
            (p, pa.int32()), (e, pa.int32()), (np.where(k == widest, -1, k), pa.int32()), (value, pa.int64()), (far, pa.int64()))],
            names=["part", "entry", "pos", "total", "far"])

    added = rows.select("x", "codes", "dists").mapInArrow(run, "part int, entry int, pos int, total bigint, far bigint")
    return added.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.max("far").alias("far")).collect()


def integers(rows: DataFrame, id_col: str, vec_col: str, carry: list[str]) -> DataFrame:
    """``id``, the columns of ``carry`` as ``c0, c1, ...`` and ``x``, the integer vector, of every valid row."""
    fits = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MAX_COMPONENT)  # noqa: E731  NaN is above every number
    return (rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, fits))
            .select(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
                    F.transform(vec_col, lambda c: F.when(fits(c), F.floor(c.cast("double") * SCALE).cast("int"))).alias("x")))


def compress(rows: DataFrame, id_col: str, vec_col: str, carry: list[str] = (), parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``id_col``, the columns of ``carry``, ``codes`` (a byte for each part) and ``error`` of every valid vector, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    whole = written(integers(rows, id_col, vec_col, carry), "integer-vectors")
    order = [F.col("id").asc_nulls_last(), "x"]
    first = whole.orderBy(*order).select("x").limit(1).collect()
    names = [id_col, *carry]
    back = [F.col(c).alias(n) for c, n in zip(["id", *(f"c{i}" for i in range(len(carry)))], names)]
    if not first:
        return whole.select(*back, F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), Codebooks([])
    dim = len(first[0].x)
    cuts = cuts_of(dim, parts)
    whole = whole.where(F.size("x") == dim)
    start = np.array([r.x for r in whole.orderBy(*order).select("x").limit(entries).collect()], np.int64)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:])]
    n = len(start)
    radii, still = [np.full(n, np.inf)] * parts, [np.zeros(n, bool)] * parts
    table = whole.withColumn("codes", F.lit(bytes(parts)))
    for k in range(rounds + 1):
        done = written(_assign(table, books, radii, still, cuts), "coded-vectors")
        if k:
            drop_written(table)
        table = done
        if k == rounds:
            break
        moved = [b.copy() for b in books]
        found = _sums(table, parts, n, cuts)
        count = {(r.part, r.entry): r.total for r in found if r.pos < 0}
        far = np.zeros((parts, n))
        for r in found:
            if r.pos < 0:
                far[r.part, r.entry] = r.far
        sums = {(r.part, r.entry, r.pos): r.total for r in found if r.pos >= 0}
        for (p, e), members in count.items():
            if members:
                moved[p][e] = [sums.get((p, e, i), 0) // members for i in range(cuts[p + 1] - cuts[p])]
        # the farthest member lies at most this far from where the entry is now (rounded up)
        shift = [np.sqrt(_squares(b - a).astype(float)) for a, b in zip(books, moved)]
        radii = [(np.sqrt(far[p]) + shift[p]) * (1 + 1e-9) + 1e-6 for p in range(parts)]
        still = [s == 0 for s in shift]
        books = moved
    return table.select(*back, "codes", F.aggregate("dists", F.lit(0).cast("long"), lambda a, d: a + d).alias("error")), Codebooks(books)


def with_label_errors(coded: DataFrame, label_col: str) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over all rows of an equal label (nulls are one label)."""
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
