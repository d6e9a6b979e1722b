"""Personal data by a semi-Markov conditional random field (operator 11).

Base rules find e-mail addresses, IP addresses, cards and phone numbers, each
kind leftmost and without overlap; what fails its check (parts over 255, Luhn,
number of digits) is dropped and not tried again.  So two cards with a blank
between them, or a phone number before an IP address, are one failing match.

The random field reads the regions where personal data may stand: runs of
digits and their separators, and words around an ``@`` or a spelled-out
``at``.  A region is cut into tokens; a candidate segment is a span of at most
``MAX_TOKENS`` tokens that could be an entity of a kind at all.  Features are
of whole spans: digits, the lengths of digit groups, separators, Luhn and
octet checks, brackets, the characters at both ends and the words before.
Dynamic programming over the segments ending at each token chooses
boundaries and kinds of a whole region together; all other tokens are outside.
Spans that the field finds and that overlap no base span are added.

The field is trained here, by the conditional likelihood of segmentations
(forward-backward over the same segments), on at most ``TRAIN_REGIONS``
regions chosen by a hash.  Their labels are the base spans; regions in which
a base match was dropped for its length are left out, as nobody knows what
they hold.  Pairs of labelled regions are also joined by separators, phone
numbers told without country code, and addresses spelled out, with the
segmentation that is known from how they were made.

One pass reads the texts, in time in proportion to their length; training and
decoding work on the regions it wrote to the shared folder.

Cases: a null or empty text holds nothing; texts of any length are read whole,
as no expression backtracks over a run; spans of equal start are ordered by kind; rows
that repeat each have their spans; where no sampled region holds an entity
nothing is learnt and the base spans are all; an empty table gives an empty
table.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import bounded_sample, written

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
TRAIN_REGIONS = 500
EPOCHS, RATE, DECAY = 8, 0.4, 1e-3
MAX_TOKENS = 24
LEAST_DIGITS = 7
CONTEXT = 24

# The contract's expressions, possessive where that changes no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Regions: digits with up to three separators between them; words around an @ or a spelled-out one.
_NUMBERS = re.compile(r"[+(]{0,3}[0-9](?:[\x20().+,;/:|-]{0,3}[0-9])*+")
_AT = r"(?:[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?|[\x20]at[\x20])"
_DOT = r"(?:[\x20]?[\[({][\x20]?dot[\x20]?[\])}][\x20]?|[\x20]dot[\x20]|\.)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^A-Za-z0-9\s]")
_WORD = re.compile(r"[A-Za-z]+")
# What stands beside the blanks of a spelled-out address.
_SPELLING = frozenset(("at", "dot", "[", "(", "{", "]", ")", "}"))
_FULL = re.compile(r"\S*")

# Words that say what follows.
CUES = {
    "phone": "phone tel telephone call fax mobile cell sms whatsapp telefon telefono téléphone",
    "email": "mail email e contact write correo courriel",
    "ip": "ip host server address addr client from gateway",
    "card": "card visa mastercard amex credit debit karte carte tarjeta pan",
    "other": "order invoice id no nr number version isbn ref sha hash token key serial page section",
}
_CUE = {w: kind for kind, words in CUES.items() for w in words.split()}


# -- base rules -----------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """``(start, kind, end)`` of the base spans in order, and the matches dropped for too many digits."""
    found = [(a, 0, b) for a, b in _emails(text)]
    dropped = []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if octets(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
        elif len(digits) > 19:
            dropped.append(m.span())
    for m in _PHONE.finditer(text):
        n = sum(map(m[0].count, "0123456789"))
        if 9 <= n <= 15:
            found.append((m.start(), 3, m.end()))
        elif n > 15:
            dropped.append(m.span())
    return sorted(found), dropped


# -- regions and segments -------------------------------------------------------------

def regions(text: str) -> list[tuple[int, int]]:
    """Spans in which personal data may stand, in order and apart."""
    found = []
    for m in _NUMBERS.finditer(text):
        n = 0
        for c in "0123456789":
            n += m[0].count(c)
        if n >= LEAST_DIGITS:
            found.append(m.span())
    done, at = 0, text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > done and not text[a - 1].isspace():
            a -= 1
        m = _FULL.match(text, b)
        found.append((a, m.end()))
        done = m.end()
        at = text.find("@", done)
    low = text.lower() if "at" in text else ""
    if (" at " in low and " dot " in low) or re.search(r"[\[({] ?at ?[\])}]", low):
        found += [m.span() for m in _SPELLED.finditer(text) if not re.search(r"\sat\s[A-Za-z0-9-]+\.", m[0], re.I)]
    return _union(found)


def _side(c: str) -> str:
    if not c:
        return "edge"
    return "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "+-.,()\"'=:/@_" else "mark"


def _outside(token: str) -> str:
    if token.isdigit():
        return f"O:9x{min(len(token), 20)}"
    return "O:" + ("a" if token[0].isalpha() else "blank" if token[0].isspace() else token[0])


class Lattice:
    """The tokens of a region and its candidate segments with their features."""

    def __init__(self, text: str, left: str = "", right: str = ""):
        self.text = text
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.ends = [b for _, b in spans]
        self.tokens = [text[a:b] for a, b in spans]
        cues = [_CUE[w] for w in (x.lower() for x in _WORD.findall(left)[-3:]) if w in _CUE]
        self.cue = cues[-1] if cues else "none"
        self.left, self.right = left, right
        n = len(spans)
        # by end token: (start token, kind, features)
        self.ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(n + 1)]
        self.outside = [[_outside(t)] for t in self.tokens]
        for i in range(n):
            self._from(i, n)

    def _from(self, i: int, n: int) -> None:
        tokens = self.tokens
        first = tokens[i][0]
        if not (first.isascii() and (first.isalnum() or first in "+(._%")):
            return
        digits, groups, seps, numeric, at, dots = 0, [], [], True, "", 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            t = tokens[j]
            number = t.isascii() and t.isdigit()
            if number:
                digits += len(t)
                groups.append(len(t))
            else:
                numeric = numeric and t in (" ", "-", ".", "(", ")") or (numeric and t == "+" and j == i)
                seps.append(t)
                low = t.lower()
                if t == "@" or low == "at" and j > i:
                    if at:
                        return  # two addresses
                    at = "@" if t == "@" else "at"
                elif at and (t == "." or low == "dot"):
                    dots += 1
            if not numeric and not at and (t.isspace() or t in "()+,;:/|") and not (t in " ([{" and "at" in map(str.lower, tokens[j + 1:j + 4])):
                return  # neither a number nor before an @
            if at == "@" and (t.isspace() or t in "()[]{}<>,;:|/"):
                return  # an address has ended
            if at == "at" and t.isspace() and not _SPELLING.intersection(map(str.lower, tokens[j - 1:j + 2])):
                return
            if not (t.isascii() and t.isalnum()):
                continue
            end = j + 1
            if numeric and number and digits <= 19:
                if digits >= LEAST_DIGITS and digits <= 15 and first in "+(0123456789":
                    self._add(i, end, 3, digits, groups, seps)
                if 12 <= digits and first.isdigit() and all(s in " -" for s in seps):
                    self._add(i, end, 2, digits, groups, seps)
                if len(groups) == 4 and seps == [".", ".", "."] and end - i == 7:
                    self._add(i, end, 1, digits, groups, seps)
            if at and dots and t.lower() not in ("at", "dot"):
                self._add(i, end, 0, digits, groups, seps, at)

    def _add(self, i: int, end: int, kind: int, digits: int, groups: list[int], seps: list[str], at: str = "") -> None:
        k = KINDS[kind]
        span = self.text[self.starts[i]:self.ends[end - 1]]
        before = self.text[self.starts[i] - 1] if i else self.left[-1:]
        after = self.text[self.ends[end - 1]] if end < len(self.tokens) else self.right[:1]
        made = [k, f"{k}:<{_side(before)}", f"{k}:>{_side(after)}", f"{k}:cue={self.cue}"]
        if kind:
            plain = "".join(c for c in span if c in "0123456789")
            made += [f"{k}:n={digits}", f"{k}:groups={'-'.join(map(str, groups[:8]))}", f"{k}:marks={''.join(sorted(set(''.join(seps))))}",
                     f"{k}:plus={span[0] == '+'}", f"{k}:open={span.count('(') == span.count(')') and '() ' not in span}"]
            if kind == 1:
                made.append(f"{k}:octets={octets(span)}")
            if kind == 2:
                made.append(f"{k}:luhn={luhn(plain)}")
                made.append(f"{k}:even={len(set(groups)) == 1}")
        else:
            tail = self.tokens[end - 1]
            made += [f"{k}:at={at}", f"{k}:tail={tail.isalpha()}{min(len(tail), 5)}", f"{k}:blanks={sum(s.isspace() for s in seps)}",
                     f"{k}:head={_side(span[0])}"]
        self.ending[end].append((i, kind, made))

    def __len__(self) -> int:
        return len(self.tokens)


# -- the random field -----------------------------------------------------------------

def _sum_exp(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


class SemiCRF:
    """Weights by feature name; a transition is the feature ``before>after``."""

    LABELS = (*KINDS, "O")

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(weights or {})

    def _scored(self, lattice: Lattice) -> tuple[list[list[tuple[int, int, float, list[str]]]], list[list[float]]]:
        w = self.weights.get
        ending: list[list[tuple[int, int, float, list[str]]]] = [[]]
        for j in range(1, len(lattice) + 1):
            o = lattice.outside[j - 1]
            ending.append([(j - 1, OUTSIDE, sum(w(f, 0.0) for f in o), o),
                           *((i, k, sum(w(f, 0.0) for f in made), made) for i, k, made in lattice.ending[j])])
        labels = self.LABELS
        moves = [[w(f"{a}>{b}", 0.0) for b in labels] for a in labels]
        return ending, moves

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` of the entities of the best segmentation, in characters of the region."""
        n, size = len(lattice), len(self.LABELS)
        ending, moves = self._scored(lattice)
        best = [[-math.inf] * size for _ in range(n + 1)]
        back: list[list[tuple[int, int] | None]] = [[None] * size for _ in range(n + 1)]
        best[0][OUTSIDE] = 0.0
        for j in range(1, n + 1):
            for i, k, s, _ in ending[j]:
                for y in range(size):
                    v = best[i][y] + moves[y][k] + s
                    if v > best[j][k]:
                        best[j][k], back[j][k] = v, (i, y)
        found, j, y = [], n, max(range(size), key=lambda y: best[n][y])
        while j:
            i, before = back[j][y]
            if y != OUTSIDE:
                found.append((lattice.starts[i], y, lattice.ends[j - 1]))
            j, y = i, before
        return found[::-1]

    def log_partition(self, lattice: Lattice) -> float:
        return _sum_exp(self._forward(lattice, *self._scored(lattice))[len(lattice)])

    def _forward(self, lattice: Lattice, ending, moves) -> list[list[float]]:
        size = len(self.LABELS)
        alpha = [[-math.inf] * size for _ in range(len(lattice) + 1)]
        alpha[0][OUTSIDE] = 0.0
        for j in range(1, len(lattice) + 1):
            into: list[list[float]] = [[] for _ in range(size)]
            for i, k, s, _ in ending[j]:
                into[k].append(s + _sum_exp([alpha[i][y] + moves[y][k] for y in range(size)]))
            alpha[j] = [_sum_exp(v) if v else -math.inf for v in into]
        return alpha

    def gradient(self, lattice: Lattice, gold: list[tuple[int, int, int]]) -> dict[str, float] | None:
        """Observed less expected features under the gold entities (characters);
        None where no segmentation of the lattice has them."""
        n, size, labels = len(lattice), len(self.LABELS), self.LABELS
        ending, moves = self._scored(lattice)
        grad: dict[str, float] = defaultdict(float)
        starts = {lattice.starts[i]: i for i in range(n)}
        by_start = {starts.get(a): (k, b) for a, k, b in gold}
        i, y = 0, OUTSIDE
        while i < n:
            k, end, made = OUTSIDE, i + 1, lattice.outside[i]
            if i in by_start:
                k, stop = by_start.pop(i)
                found = [(j, m) for j in range(i + 1, n + 1) if lattice.ends[j - 1] == stop for s, kk, m in lattice.ending[j] if s == i and kk == k]
                if not found:
                    return None
                end, made = found[0]
            for f in made:
                grad[f] += 1
            grad[f"{labels[y]}>{labels[k]}"] += 1
            i, y = end, k
        if by_start:
            return None
        alpha = self._forward(lattice, ending, moves)
        whole = _sum_exp(alpha[n])
        beta = [[-math.inf] * size for _ in range(n)] + [[0.0] * size]
        leaving: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for j in range(1, n + 1):
            for i, k, s, _ in ending[j]:
                leaving[i].append((j, k, s))
        for i in range(n - 1, -1, -1):
            for y in range(size):
                beta[i][y] = _sum_exp([moves[y][k] + s + beta[j][k] for j, k, s in leaving[i]])
        for j in range(1, n + 1):
            for i, k, s, made in ending[j]:
                tail = s + beta[j][k] - whole
                share = 0.0
                for y in range(size):
                    p = alpha[i][y] + moves[y][k] + tail
                    if p > -30:
                        p = math.exp(p)
                        share += p
                        grad[f"{labels[y]}>{labels[k]}"] -= p
                if share:
                    for f in made:
                        grad[f] -= share
        return grad

    def fit(self, examples: list[tuple[Lattice, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> "SemiCRF":
        """Adaptive gradient ascent on the conditional likelihood, with decay."""
        squares: dict[str, float] = defaultdict(float)
        for _ in range(epochs):
            for lattice, gold in examples:
                for f, g in (self.gradient(lattice, gold) or {}).items():
                    g -= DECAY * self.weights.get(f, 0.0)
                    squares[f] += g * g
                    if squares[f]:
                        self.weights[f] = self.weights.get(f, 0.0) + RATE * g / math.sqrt(squares[f] + 1e-8)
        return self


def examples_of(sample: list[tuple[str, str, str, list[tuple[int, int, int]]]]) -> list[tuple[Lattice, list[tuple[int, int, int]]]]:
    """Lattices with gold entities from ``(left, region, right, gold)``, and those made from them."""
    made = [(left, text, right, gold) for left, text, right, gold in sample]
    alone = [(left, text, right, gold[0][1]) for left, text, right, gold in sample if len(gold) == 1 and gold[0][0] == 0 and gold[0][2] == len(text)]
    for n, (left, text, right, kind) in enumerate(alone):
        other = alone[(7 * n + 3) % len(alone)]
        mark = (" ", " ", ", ", " / ", "; ")[n % 5]
        made.append((left, text + mark + other[1], other[2], [(0, kind, len(text)), (len(text) + len(mark), other[3], len(text) + len(mark) + len(other[1]))]))
        if kind == KINDS.index("phone") and "(" in text:
            local = text[text.index("("):]
            made.append((left, local, right, [(0, kind, len(local))]))
        if kind == KINDS.index("email"):
            at, dot = ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."))[n % 3]
            spelled = text.replace("@", at).replace(".", dot)
            made.append((left, spelled, right, [(0, kind, len(spelled))]))
    return [(Lattice(text, left, right), gold) for left, text, right, gold in made]


# -- the operator ---------------------------------------------------------------------

_SPAN = "struct<start:bigint,rank:int,stop:bigint>"
_REGION = f"struct<start:bigint,before:string,text:string,after:string,certain:boolean,gold:array<{_SPAN}>>"


def _region_rows(text: str, spans, dropped) -> list[dict]:
    out = []
    for a, b in regions(text):
        inside = [s for s in spans if s[0] < b and s[2] > a]
        apart = all(x[2] <= y[0] for x, y in zip(inside, inside[1:])) and all(a <= s[0] and s[2] <= b for s in inside)
        certain = apart and not any(x < b and y > a for x, y in dropped)
        out.append({"start": a, "before": text[max(0, a - CONTEXT):a], "text": text[a:b], "after": text[b:b + 4], "certain": certain,
                    "gold": [{"start": s - a, "rank": k, "stop": e - a} for s, k, e in inside] if certain else []})
    return out


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``base`` spans and ``regions`` of every whole text."""
    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())])
        region = pa.struct([("start", pa.int64()), ("before", pa.string()), ("text", pa.string()), ("after", pa.string()),
                            ("certain", pa.bool_()), ("gold", pa.list_(span))])
        for batch in batches:
            ids, texts = batch.columns
            base, found = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                spans, dropped = base_spans(text)
                base.append([{"start": a, "rank": k, "stop": b} for a, k, b in spans])
                found.append(_region_rows(text, spans, dropped))
            yield pa.RecordBatch.from_arrays([ids, pa.array(base, pa.list_(span)), pa.array(found, pa.list_(region))], names=["id", "base", "regions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, base array<{_SPAN}>, regions array<{_REGION}>")


def train(found: DataFrame, train_regions: int = TRAIN_REGIONS) -> SemiCRF | None:
    """The field fitted on a sample of the certain regions; None where these hold no entity."""
    each = found.select(F.explode("regions").alias("r")).select("r.*").where("certain and length(text) <= 400")
    sample = bounded_sample(each.select("before", "text", "after", "gold"), each.count(), train_regions, ["text", "before", "after"]).collect()
    rows = [(r.before, r.text, r.after, [(g.start, g.rank, g.stop) for g in r.gold]) for r in sample]
    if not any(gold for *_, gold in rows):
        return None
    return SemiCRF().fit(examples_of(rows))


def _union(spans) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_regions: int = TRAIN_REGIONS, model: SemiCRF | None = None) -> DataFrame:
    """``id_col``, ``base`` and ``added`` of every row: arrays of ``(start, rank, stop)``, ``rank`` an index into ``KINDS``."""
    found = written(_read(docs, id_col, text_col), "personal-regions")
    model = model or train(found, train_regions)
    if model is None:
        return found.select(F.col("id").alias(id_col), "base", F.array().cast(f"array<{_SPAN}>").alias("added"))

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())])
        for batch in batches:
            ids, bases, regs = batch.columns
            added = []
            for i in range(batch.num_rows):
                taken = _union((x["start"], x["stop"]) for x in bases[i].as_py())
                ends, new = [b for _, b in taken], []
                for r in regs[i].as_py():
                    for a, kind, b in model.decode(Lattice(r["text"], r["before"], r["after"])):
                        a, b = a + r["start"], b + r["start"]
                        k = bisect_right(ends, a)
                        if k == len(taken) or taken[k][0] >= b:
                            new.append({"start": a, "rank": kind, "stop": b})
                added.append(new)
            yield pa.RecordBatch.from_arrays([ids, bases, pa.array(added, pa.list_(span))], names=["id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, base array<{_SPAN}>, added array<{_SPAN}>").withColumnRenamed("id", id_col)
