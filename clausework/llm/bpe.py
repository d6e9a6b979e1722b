"""Byte-level BPE encoding and decoding by merge replay (operator 2).

The corpus is encoded block by block.  A block's distinct words are laid
end to end; an inverted index maps each mergeable token pair (named by the
token it makes) to the positions where it stands.  The index is drained in
rank order: every merge of the lowest rank is applied at all its positions,
and only the two touched neighbours of each merge enter the index again.
Each distinct word of a block is merged once however often it occurs, and
the words a task has met are kept for its next blocks (a bounded table that
is let go when the task ends, so that an idle worker holds little), so the
work follows the distinct words.

Why blocks and not one index over the whole corpus: joining the merged
words back to their occurrences would shuffle every word of the corpus
twice.  Blocks give the same ids with no shuffle at all, in memory bounded
by ``BLOCK_CHARS``, ``BLOCK_BYTES`` and ``TABLE_WORDS``, and a lost executor
costs only its running tasks.

Ids are packed as little-endian unsigned 32-bit integers in a binary
column, the form a token shard stores; ``unpack_ids`` gives the array.

Cases: a null text encodes as an empty one (no ids, no bytes); null ids
decode to no bytes; a text of any length is cut into pieces only where the
split pattern parts it anyway, so no merge is lost; repeated rows each give
their row; an empty table gives an empty table.  Input columns named as an
output column are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of text whose words are looked up together.
BLOCK_CHARS = 3 << 20
# Bytes of distinct unseen words replayed in one index.
BLOCK_BYTES = 1 << 19
# Words a task remembers with their ids; a full table starts anew.
TABLE_WORDS = 400_000

# Space-led words, and runs of blanks without the blank that leads a word.
_UNITS = re.compile(r" ?[^ \n]+|[ \n]+(?=[ \n][^ \n])|[ \n]+")
_OTHER_BLANK = re.compile(r"[^\S \n]")
_STOPS = frozenset(".,;:!?|")
_PARTING = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that parts a text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        digest = hashlib.sha256(pattern.encode())
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            digest.update(b"%d " % rank + token)
        self.name = digest.hexdigest()

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)


class Tokens:
    """Decodes ids by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def decode(self, packed: bytes) -> bytes:
        import numpy as np

        ids, look, step = np.frombuffer(packed, "<u4"), self.token.__getitem__, 1 << 18
        return b"".join(b"".join(map(look, ids[k:k + step].tolist())) for k in range(0, len(ids), step))


    def forget(self) -> None:
        """Nothing is kept of the values."""


class MergeReplay:
    """Encodes texts, each distinct word once, by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.parts = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every pair of tokens that makes a token, sorted by the pair
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.append((1 << 62, -1))
        pairs.sort()
        self.pairs, self.makes = (np.array(x, np.int64) for x in zip(*pairs))
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Let go of the words met so far."""
        self.known = {}

    def made(self, a, b):
        """The token (its rank) that each pair of tokens makes, or -1."""
        import numpy as np

        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.makes[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each (non-empty) word."""
        import numpy as np

        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        n = len(raw)
        sym = self.byte_id[raw]
        # right and left neighbour of a position in its word, or the spare position n
        last = np.zeros(n, bool)
        last[np.cumsum(size) - 1] = True
        right = np.append(np.where(last, n, np.arange(1, n + 1)), n)
        left = np.append(np.where(np.concatenate([[True], last[:-1]]), n, np.arange(-1, n - 1)), n)
        sym = np.append(sym, 0)
        makes = np.full(n + 1, -1, np.int64)  # what the pair at a position makes now
        inner = np.flatnonzero(~last)
        makes[inner] = self.made(sym[inner], sym[inner + 1])

        index: dict[int, list] = {}  # the inverted index: token made -> positions
        heap: list[int] = []

        def enter(places):
            rank = makes[places]
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(places)]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        if (found := np.flatnonzero(makes >= 0)).size:
            enter(found)
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            places = held[0] if len(held) == 1 else np.concatenate(held)
            places = places[makes[places] == rank]
            if not places.size:
                continue
            if len(places) > 1:
                if len(held) > 1:
                    places = np.unique(places)
                # the leftmost place of each word now, its others after what this merge makes
                new_word = owner[places[1:]] != owner[places[:-1]]
                if not new_word.all():
                    first = np.concatenate([[True], new_word])
                    index[rank] = [places[~first]]
                    heapq.heappush(heap, rank)
                    places = places[first]
            gone = right[places]
            after, before = right[gone], left[places]
            sym[places], makes[gone] = rank, -1
            sym[gone] = -1
            right[places], left[after] = after, places
            makes[places] = np.where(after < n, self.made(rank, sym[after]), -1)
            led = before[before < n]
            makes[led] = self.made(sym[led], rank)
            touched = np.concatenate([places, led])
            touched = touched[makes[touched] >= 0]
            if touched.size:
                enter(touched)

        alive = sym[:n] >= 0
        packed = sym[:n][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def words_of(self, unit: str) -> list[str]:
        """The matches of the split pattern in a unit."""
        core = unit[1:] if unit[0] == " " else unit
        if core.isalpha():
            return [unit]
        if core[-1:] in _STOPS and core[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.parts(unit)

    def learn(self, new: set[str]) -> None:
        """Replay the words of units that are not known yet."""
        known = self.known
        if len(known) + len(new) > TABLE_WORDS:
            known.clear()
        of_unit = [(u, self.words_of(u)) for u in new]
        ids: dict[str, bytes] = {}
        block: list[str] = []
        coded: list[bytes] = []
        held = 0

        def flush():
            nonlocal held
            ids.update(zip(block, self.replay(coded)))
            block.clear()
            coded.clear()
            held = 0

        for word in {w for _, ws in of_unit for w in ws}:
            block.append(word)
            coded.append(word.encode())
            held += len(coded[-1])
            if held >= BLOCK_BYTES:
                flush()
        if block:
            flush()
        for u, ws in of_unit:
            known[u] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        split = [self.units(t) for t in texts]
        new = {u for us in split for u in us if u not in known}
        if new and len(known) + len(new) > TABLE_WORDS:  # the table starts anew with all words of these texts
            new = set().union(*split)
        if new:
            self.learn(new)
        look = known.__getitem__
        for us in split:
            yield b"".join(map(look, us))

    def units(self, piece: str) -> list[str]:
        """Stretches of a piece that the split pattern parts from each other."""
        return self.parts(piece) if _OTHER_BLANK.search(piece) else _UNITS.findall(piece)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; ``texts`` hold about a block, or are one longer text."""
        if sum(map(len, texts)) <= 2 * BLOCK_CHARS:
            yield from self._ids(texts)
        else:
            for text in texts:
                yield b"".join(next(self._ids([p])) for p in pieces(text))


def pieces(text: str) -> Iterator[str]:
    """A text cut at single spaces between words, about a block apart."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        cut = _PARTING.search(text, start + BLOCK_CHARS)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


# What this Python worker has made of a vocabulary, kept between its tasks.
_READY: dict[tuple, MergeReplay | Tokens] = {}


def _ready(kind, name: str, shipped):
    if (kind, name) not in _READY:
        _READY.clear()
        _READY[kind, name] = kind(*shipped.value)
    return _READY[kind, name]


def _mapped(df: DataFrame, vocab: Vocabulary, carry: list[str], in_col: str, out_col: str, kind, work) -> DataFrame:
    """``carry`` columns and the binary ``out_col``: what ``work(kind(vocabulary), values)``
    yields for lists of input values that hold about a block."""
    kept = [c for c in carry if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out_col, T.BinaryType(), True)])
    name, shipped = vocab.name, df.sparkSession.sparkContext.broadcast((vocab.ranks, vocab.pattern))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ready = _ready(kind, name, shipped)
        for batch in batches:
            column, n = batch.column(len(kept)), batch.num_rows
            # rows whose values fill a block go together
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            start = 0
            while start < n:
                stop, held = start + 1, sizes[start]
                while stop < n and held + sizes[stop] <= BLOCK_CHARS:
                    held += sizes[stop]
                    stop += 1
                values = work(ready, column.slice(start, stop - start).to_pylist())
                out = pa.array(list(values), pa.binary())
                del values
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, stop - start) for k in range(len(kept))), out],
                                                 names=[*kept, out_col])
                del out
                start = stop
        ready.forget()
        pa.default_memory_pool().release_unused()

    return df.select(*kept, F.col(in_col).alias("_in")).mapInArrow(run, schema)


def encode(df: DataFrame, vocab: Vocabulary, text_col: str = "text", out_col: str = "ids",
           carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) and ``out_col``, the packed ids of ``text_col``."""
    return _mapped(df.withColumn(text_col, F.coalesce(text_col, F.lit(""))), vocab,
                   df.columns if carry is None else carry, text_col, out_col, MergeReplay, MergeReplay.encode)


def decode(df: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out_col: str = "decoded",
           carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) and ``out_col``, the bytes of the packed ``ids_col``."""
    return _mapped(df.withColumn(ids_col, F.coalesce(ids_col, F.lit(b""))), vocab,
                   df.columns if carry is None else carry, ids_col, out_col,
                   Tokens, lambda tokens, values: map(tokens.decode, values))


def n_tokens(ids: Column | str) -> Column:
    """How many ids a packed column holds."""
    return (F.octet_length(ids) / 4).cast("long")


def unpack_ids(ids: Column | str) -> Column:
    """Packed ids as an array of long."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = F.octet_length(ids) / 4

    def at(k):
        h = F.hex(ids.substr((4 * k + 1).cast("int"), F.lit(4)))
        return F.conv(F.concat(*(h.substr(i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")

    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), at)).otherwise(F.array().cast("array<bigint>"))
