"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (email, ip, card, phone) give the base spans of every text. The
field then looks at the places where looser forms may stand: windows of
tokens around an ``@``, an "at" between words or three digits. It scores whole
candidate spans of up to ``WIDEST`` tokens by their features (shape, digits,
checksum, punctuation); a dynamic program over the tokens of a window chooses
boundaries and types together. Its spans are added where no base span is.

It is trained on windows of a bounded sample of texts: base spans are the
labels, looser writings of them keep their label, and broken ones (a wrong
checksum, a part above 255, too few digits) become negatives.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Texts whose windows train the field, those with the smallest hash of their id, and the windows taken of them.
SAMPLE, WINDOWS = 2000, 1500
#: Windows of one text and characters of one window that may train it.
PER_TEXT, WINDOW_CHARS = 5, 400
#: Tokens of a span and tokens around a hint.
WIDEST, MARGIN = 6, 3

#: The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"@|[0-9][^A-Za-z\s]?[0-9][^A-Za-z\s]?[0-9]|[\[(]at[\])]|(?<=\w) at (?=\w+(?:\.| dot )\w)")
_AROUND = "\"'()[]{}<>,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches lie within runs of the pattern's letters around an ``@``, so only those runs are searched."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if m := _EMAIL.match(text, start) if start < at else None:
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` of the patterns' matches, ascending."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_features(text: str) -> list[str]:
    """Features of a whole candidate span."""
    digits = _digits(text)
    shape = re.sub(r"(.)\1+", r"\1", "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in text))
    parts = text.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    out = ["bias", f"digits:{len(digits)}", f"words:{text.count(' ') + 1}", f"shape:{shape if len(shape) < 24 else 'long'}"]
    if "@" in text or re.search(r"\w ?(?:[\[(]at[\])]|\bat\b) ?\w", text):
        out.append("at+host" if re.search(r"(?:@|\bat\b|[\[(]at[\])]) ?[\w-]+(?:\.| dot )\w", text) else "at")
    if any(c.isalpha() for c in text):
        out.append("letters")
    if text[:1] == "+":
        out.append("plus")
    if 12 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if quad:
        out.append("quad" if all(len(p) < 4 and int(p) <= 255 for p in parts) else "no quad")
    if not re.search(r"[^0-9 ().+/-]", text) and 9 <= len(digits) <= 11 and " " in text + " " and re.search(r"[ ()./-]", text):
        out.append("grouped")
    return out


class Field:
    """Weights by (kind, feature); a token outside of spans scores 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None) -> None:
        self.weights = defaultdict(float, weights or {})

    def candidates(self, tokens: list[tuple[int, int]], text: str, blocked: list[bool]) -> dict[tuple[int, int], list[str]]:
        """Features of the spans of tokens i..j-1 that may be personal data."""
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + WIDEST, len(tokens)) + 1):
                if blocked[j - 1]:
                    break
                piece = text[tokens[i][0]:tokens[j - 1][1]]
                if len(piece) > 80 or "\n" in piece:
                    break
                if _HINT.search(piece) or " at " in piece:
                    out[i, j] = span_features(piece)
        return out

    def scores(self, spans: dict[tuple[int, int], list[str]]) -> dict[tuple[int, int], list[float]]:
        w = self.weights
        return {s: [sum(w[k, f] for f in fs) for k in range(len(KINDS))] for s, fs in spans.items()}

    def best(self, size: int, scores: dict[tuple[int, int], list[float]]) -> list[tuple[int, int, int]]:
        """The segmentation with the highest score: ``(first token, end token, kind)``."""
        ends = defaultdict(list)
        for (i, j), by_kind in scores.items():
            k = max(range(len(KINDS)), key=by_kind.__getitem__)
            ends[j].append((i, k, by_kind[k]))
        top, back = [0.0], [None]
        for j in range(1, size + 1):
            value, came = top[j - 1], None
            for i, k, score in ends[j]:
                if top[i] + score > value:
                    value, came = top[i] + score, (i, j, k)
            top.append(value)
            back.append(came)
        out, j = [], size
        while j:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def marginals(self, size: int, scores: dict[tuple[int, int], list[float]]) -> dict[tuple[int, int, int], float]:
        """The probability of each (span, kind) over all segmentations, by forward and backward sums."""
        ends, starts = defaultdict(list), defaultdict(list)
        for (i, j), by_kind in scores.items():
            for k, s in enumerate(by_kind):
                ends[j].append((i, s))
                starts[i].append((j, s))
        ahead, behind = [0.0] * (size + 1), [0.0] * (size + 1)
        for j in range(1, size + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, s in ends[j])])
        for i in range(size - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[j] + s for j, s in starts[i])])
        return {(i, j, k): math.exp(ahead[i] + s + behind[j] - ahead[size])
                for (i, j), by_kind in scores.items() for k, s in enumerate(by_kind)}

    def learn(self, examples: list[tuple[int, dict, set]], passes: int = 12, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Maximum likelihood with a step size per weight; examples are (tokens, candidates, gold spans)."""
        squares: dict[tuple[int, str], float] = defaultdict(lambda: 1e-6)
        rng = random.Random(0)
        for _ in range(passes):
            rng.shuffle(examples)
            for size, spans, gold in examples:
                if not spans:
                    continue
                step: Counter = Counter()
                for (i, j, k), p in self.marginals(size, self.scores(spans)).items():
                    if abs(g := ((i, j, k) in gold) - p) > 1e-4:
                        for f in spans[i, j]:
                            step[k, f] += g
                for key in sorted(step):
                    g = step[key] - decay * self.weights[key]
                    squares[key] += g * g
                    self.weights[key] += rate * g / math.sqrt(squares[key])


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Merged ranges of text, ``MARGIN`` tokens around each hint, at line breaks or blanks."""
    start = end = -1
    for m in _HINT.finditer(text):
        a, b = m.start(), m.end()
        for _ in range(MARGIN + 1):
            a = max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), 0) if a > 0 else 0
        for _ in range(MARGIN + 1):
            found = [x for x in (text.find(" ", b + 1), text.find("\n", b + 1)) if x >= 0]
            b = min(found) if found else len(text)
        if start >= 0 and a <= end:
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Tokens between blanks without the punctuation around them; one final full stop goes, too."""
    out = []
    for m in _TOKEN.finditer(text, start, end):
        a, b = m.span()
        while a < b and text[a] in _AROUND and not (text[a] in "([" and re.match(r"[(\[](?:\d+|at)[)\]]", text[a:b])):
            a += 1
        while a < b and text[b - 1] in _AROUND + "." and not (text[b - 1] in ")]" and "(" in text[a:b] + "[" and text[a] in "(["):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans of the field outside of the base spans, as in :func:`base_spans`."""
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    ends = [b for _, b in covered]
    out = []
    for start, end in windows(text):
        tokens = tokens_of(text, start, end)
        blocked = []
        for s, e in tokens:
            n = bisect_right(ends, s)
            blocked.append(n < len(covered) and covered[n][0] < e)
        if all(blocked):
            continue
        spans = field.candidates(tokens, text, blocked)
        for i, j, k in field.best(len(tokens), field.scores(spans)):
            out.append((tokens[i][0], k, tokens[j - 1][1]))
    return out


def _variants(text: str, kind: int, rng: random.Random) -> Iterator[tuple[str, bool]]:
    """Other writings of a base span, and whether they are still of its kind."""
    wrong = str((int(text[-1]) + 1) % 10) if text[-1].isdigit() else ""
    if kind == 0:
        yield text.replace("@", rng.choice([" at ", " [at] ", " (at) ", "[at]"])).replace(".", rng.choice([".", " dot "])), True
        yield text.split("@")[0] + "@", False
    elif kind == 1:
        parts = text.split(".")
        yield ".".join([str(256 + rng.randint(0, 700)), *parts[1:]]), False
        yield ".".join(parts[:rng.randint(2, 3)]), False
        yield ".".join([*parts, parts[0]]), False
    elif kind == 2:
        digits = _digits(text)
        for sep in (".", "/", "  "):
            yield sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)), True
        yield text[:-1] + wrong, False
        yield digits[:rng.randint(5, 11)], False
    else:
        local = re.sub(r"^\+[0-9]+[ -]?", "", text)
        if len(_digits(local)) >= 9:
            yield local, True
            yield re.sub(r"[ ()-]+", "-", local).strip("-"), True
            yield re.sub(r"[ ()-]+", ".", local).strip("."), True
        yield local[-rng.randint(4, 8):], False


def train(texts: list[str], windows_most: int = WINDOWS) -> Field:
    """A field from base spans, their variants and windows without any."""
    rng = random.Random(1)
    found: list[tuple[str, list[tuple[int, int, int]]]] = []
    kept: Counter = Counter()
    for text in texts:
        base = base_spans(text)
        for a, b in windows(text):
            piece = text[a:b]
            gold = [(s - a, k, e - a) for s, k, e in base if s >= a and e <= b]
            gold = [g for n, g in enumerate(gold) if not any(g[0] < o[2] and g[2] > o[0] for o in gold[:n])]
            kinds = {k for _, k, _ in gold} or {-1}
            if all(kept[k] >= windows_most // (len(KINDS) + 1) for k in kinds):
                continue
            kept.update(kinds)
            found.append((piece, gold))
            for s, k, e in gold:
                for new, good in _variants(piece[s:e], k, rng):
                    if len(gold) == 1 and new:
                        found.append((piece[:s] + new + piece[e:], [(s, k, s + len(new))] if good else []))
    field, examples = Field(), []
    for piece, gold in found:
        tokens = tokens_of(piece, 0, len(piece))
        starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        if all(s in starts and e in ends for s, _, e in gold):
            examples.append((len(tokens), field.candidates(tokens, piece, [False] * len(tokens)),
                             {(starts[s], ends[e], k) for s, k, e in gold}))
    field.learn(examples)
    return field


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field trained on at most ``sample`` texts with hints, those with the smallest hash of id and text.

    Only their windows reach the driver: ``PER_TEXT`` of each, of
    ``WINDOW_CHARS`` characters at most. Where no text has a hint, the field
    is empty and adds nothing.
    """
    text = text_of(text_col)
    rows = df.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))
    chosen = rows.filter(F.col("text").rlike("@|[0-9]{3}")).select(F.col("h").alias("chosen")).distinct().orderBy("chosen").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h, n, t[a:min(b, a + WINDOW_CHARS)]) for h, t in zip(batch["h"].to_pylist(), batch["text"].to_pylist())
                   for n, (a, b) in enumerate(islice(windows(t), PER_TEXT))]
            h, n, piece = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(piece, pa.string())],
                                             names=["h", "n", "piece"])

    found = rows.join(F.broadcast(chosen), F.col("h") == F.col("chosen")).select("h", "text").mapInArrow(cut, "h long, n int, piece string")
    return train([r.piece for r in found.distinct().orderBy("h", "n", "piece").collect()])


_OUT = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long"


def personal_data(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``base`` and ``spans`` (kind:start:end, comma-joined) and base counts.

    Places are code points. Null and empty texts have no spans, repeated rows
    equal ones; columns other than id and text play no part.
    """
    weights = {k: v for k, v in field.weights.items() if v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                t = text.as_py()
                base = base_spans(t)
                every = sorted({*base, *added_spans(t, base, own)})
                counts = Counter(k for _, k, _ in base)
                rows.append((*(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans) for spans in (base, every)),
                             *(counts[k] for k in range(len(KINDS)))))
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays],
                                             names=["doc_id", "base", "spans", "n_email", "n_ip", "n_card", "n_phone"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _OUT)
