"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The field cuts a stretch of tokens into segments: single tokens outside, or entities of up to
``LONGEST`` tokens. Features look at a whole candidate segment (its shape, digits, check digits, what
it touches), a transition weight joins neighbours, and dynamic programming over segment ends chooses
boundaries and types together. It is fitted by gradient steps on the exact log-likelihood.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import slices
from civiltext.llm.sampling import smallest_hashes

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
LONGEST = 12
#: Weights: features are hashed into so many rows.
ROWS = 1 << 12
#: The field is fitted on stretches of so many documents with a digit or @ (smallest text hashes), and on made-up ones.
SAMPLE_DOCS = 200
SAMPLE_STRETCHES = 300
MADE_UP = 60
EPOCHS = 6
#: Tokens whose candidates are held at once.
BLOCK = 2000
RATE = 0.3
SEED = 3

# -- the exact patterns -------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that a long run without one costs nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            # nothing left of this @ can be part of a later match
            last, at = at + 1, text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their check are left out."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# -- stretches and candidate segments -------------------------------------------------------------

_CHUNK = re.compile(r"\S*[0-9@]\S*")
_TOKEN = re.compile(r"[^\W_]+|\S")
_BEFORE = re.compile(r"(?:\S+\s+){0,2}\Z")
_AFTER = re.compile(r"(?:\s+\S+){0,2}")
#: Characters of context that are looked at on either side of a chunk.
CONTEXT = 60


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Ranges around everything with a digit or @: the chunks and up to two words on either side; neighbours join."""
    low = high = -1
    for m in _CHUNK.finditer(text):
        a = m.start() - len(_BEFORE.search(text[max(0, m.start() - CONTEXT) : m.start()]).group())
        b = m.end() + _AFTER.match(text[m.end() : m.end() + CONTEXT]).end()
        if a <= high:
            high = max(high, b)
            continue
        if high >= 0:
            yield low, high
        low, high = a, b
    if high >= 0:
        yield low, high


def token_class(token: str) -> str:
    if token.isdecimal():
        return f"d{min(len(token), 5)}" if len(token) < 13 else f"d{min(len(token), 20)}"
    if token.isalpha():
        return "a"
    if token.isalnum():
        return "h" if len(token) >= 16 else "x"
    return token


def _row(*feature) -> int:
    return zlib.crc32("\x1f".join(map(str, feature)).encode("utf-8", "replace")) % ROWS


@dataclass
class Lattice:
    """The candidate segments of a stretch: token ranges, feature rows, and the tokens' places."""

    spans: list[tuple[int, int]]
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    by_end: list[np.ndarray]


def candidates(tokens: list[str], glued: list[bool], at: int, lo: int, hi: int) -> tuple[list[int], list[int], list[list[int]]]:
    """(begins, ends, feature rows) of the segments that begin at tokens ``lo`` to ``hi`` of a stretch.

    ``tokens`` and ``glued`` (no gap before it) are a window of the stretch from its token ``at`` on, with the
    two tokens before ``lo`` and those that a segment and its neighbour reach beyond ``hi``.
    """
    kinds = [token_class(t) for t in tokens]
    digits = [sum(c.isdecimal() for c in t) for t in tokens]
    begin, end, rows = [], [], []
    for i in range(lo - at, hi - at):
        first = tokens[i]
        if not (first.isalnum() or first in "+("):
            continue
        shape, plain, n_digits, marks, gaps = [], [], 0, 0, 0
        left = kinds[i - 1] if i and glued[i] else "_"
        before = tokens[i - 1].lower()[:12] if i + at else "^"
        before2 = tokens[i - 2].lower()[:12] if i + at > 1 else "^"
        for j in range(i, min(len(tokens), i + LONGEST)):
            if j > i and not glued[j]:
                gaps += 1
                shape.append(" ")
                plain.append(" ")
            shape.append(kinds[j])
            plain.append(kinds[j][:1])
            n_digits += digits[j]
            marks += tokens[j] == "@"
            if not tokens[j].isalnum() or not (n_digits or marks):
                continue
            right = kinds[j + 1] if j + 1 < len(tokens) and glued[j + 1] else "_"
            number = "".join(c for t in tokens[i : j + 1] for c in t if c.isdecimal() and c.isascii()) if n_digits <= 20 and n_digits >= 13 else ""
            parts = [t for t in tokens[i : j + 1] if t.isdecimal()]
            begin.append(i + at)
            end.append(j + 1 + at)
            rows.append(
                [
                    _row("bias"), _row("shape", *shape), _row("plain", *plain), _row("digits", min(n_digits, 20), gaps > 0),
                    _row("marks", marks, gaps), _row("edges", left[:1], right[:1]), _row("before", before, kinds[i][:1]),
                    _row("before2", before2, before, kinds[i]), _row("check", len(number) >= 13 and luhn(number), len(number)),
                    _row("octets", len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts), tokens[i + 1] if j > i else ""),
                    _row("size", j - i, kinds[i], kinds[j]), _row("sides", left, right, kinds[i][:1]),
                ]
            )
    return begin, end, rows


def token_bounds(text: str) -> np.ndarray:
    return np.fromiter((p for m in _TOKEN.finditer(text) for p in m.span()), np.int32).reshape(-1, 2)


def window_of(text: str, bounds: np.ndarray, at: int, upto: int) -> tuple[list[str], list[bool]]:
    """The tokens from ``at`` to ``upto``, and which of them touch the one before."""
    part = bounds[at:upto].tolist()
    before = bounds[at - 1, 1] if at else -1
    return [text[a:b] for a, b in part], [a == e for (a, _), e in zip(part, [before, *(b for _, b in part)])]


def lattice(text: str) -> Lattice:
    """Candidates begin with a letter, digit, + or (, end with a letter or digit, and hold a digit or @."""
    bounds = token_bounds(text)
    n = len(bounds)
    begin, end, rows = candidates(*window_of(text, bounds, 0, n), 0, 0, n)
    b, e = np.array(begin, np.int64), np.array(end, np.int64)
    order = np.argsort(e, kind="stable")
    cuts = np.searchsorted(e[order], np.arange(n + 2))
    by_end = [order[cuts[t] : cuts[t + 1]] for t in range(n + 1)]
    return Lattice([tuple(x) for x in bounds.tolist()], b, e, np.array(rows, np.int64).reshape(len(rows), 12), by_end)


# -- the field ------------------------------------------------------------------------------------


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of a sum of exponentials; minus infinity for none."""
    top = x.max(axis=axis, initial=-np.inf)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis)) + safe


@dataclass
class Field:
    """Weights of (feature, kind), and of (kind or outside, next kind or outside); outside is the last."""

    weights: np.ndarray
    joins: np.ndarray

    def scores(self, x: Lattice) -> np.ndarray:
        return self.weights[x.rows].sum(axis=1)

    def forward(self, x: Lattice, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[t, y]: all cuts of the first t tokens whose last segment has type y; into[t, y]: a next segment of type y."""
        n, y = len(x.spans), len(KINDS) + 1
        alpha, into = np.full((n + 1, y), -np.inf), np.full((n + 1, y), -np.inf)
        alpha[0, -1] = 0.0
        for t in range(n + 1):
            if t:
                alpha[t, -1] = into[t - 1, -1]
                if len(s := x.by_end[t]):
                    alpha[t, :-1] = _sum(into[x.begin[s], :-1] + score[s], 0)
            into[t] = _sum(alpha[t][:, None] + self.joins, 0)
        return alpha, into

    def backward(self, x: Lattice, score: np.ndarray) -> np.ndarray:
        """beta[t, y]: all cuts of the tokens from t on, after a segment of type y."""
        n, y = len(x.spans), len(KINDS) + 1
        beta, from_here = np.full((n + 1, y), -np.inf), [[] for _ in range(n + 1)]
        for s, b in enumerate(x.begin.tolist()):
            from_here[b].append(s)
        beta[n] = 0.0
        for t in range(n - 1, -1, -1):
            step = np.full(y, -np.inf)
            step[-1] = beta[t + 1, -1]
            if s := from_here[t]:
                step[:-1] = _sum(score[s] + beta[x.end[s], :-1], 0)
            beta[t] = _sum(self.joins + step[None, :], 1)
        return beta

    def best(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(first token, end, kind) of the entities of the best cut; ties go to the outside, then to the longer past."""
        n, y = len(x.spans), len(KINDS) + 1
        if not len(x.begin):
            return []
        score = self.scores(x)
        top, into = np.full((n + 1, y), -np.inf), np.full((n + 1, y), -np.inf)
        prev, came = np.zeros((n + 1, y), int), np.full((n + 1, y), -1)
        top[0, -1] = 0.0
        for t in range(n + 1):
            if t:
                top[t, -1] = into[t - 1, -1]
                if len(s := x.by_end[t]):
                    value = into[x.begin[s], :-1] + score[s]
                    k = value.argmax(0)
                    top[t, :-1] = value[k, np.arange(y - 1)]
                    came[t, :-1] = s[k]
            joined = top[t][:, None] + self.joins
            prev[t] = joined[::-1].argmax(0)
            prev[t] = y - 1 - prev[t]
            into[t] = joined[prev[t], np.arange(y)]
        out, t, kind = [], n, y - 1 - int(top[n][::-1].argmax())
        while t:
            if kind == y - 1:
                t -= 1
            else:
                s = int(came[t, kind])
                out.append((int(x.begin[s]), t, kind))
                t = int(x.begin[s])
            kind = int(prev[t, kind]) if t else kind
        return out[::-1]


def entities(text: str, field: Field, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the best cut of a stretch of any length; the same as ``Field.best``.

    Candidates are made for ``block`` tokens at a time and the sums are kept for the last places only, so a
    token costs some twenty bytes: its bounds, and for each type the step that led there.
    """
    bounds, y, ring = token_bounds(text), len(KINDS) + 1, LONGEST + 4
    n = len(bounds)
    prev, came = np.zeros((n + 1, y), np.int8), np.zeros((n + 1, y - 1), np.int8)
    into = np.full((ring, y), -np.inf)
    top = np.full(y, -np.inf)
    top[-1] = 0.0
    later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # candidates that end beyond their block
    for lo in range(0, n + 1, block):
        hi = min(n, lo + block)
        at = max(0, lo - 2)
        begin, end, rows = candidates(*window_of(text, bounds, at, min(n, hi + LONGEST + 1)), at, lo, hi)
        score = field.weights[np.array(rows, np.int64)].sum(axis=1) if rows else np.zeros((0, y - 1))
        later.append((np.array(begin, np.int64), np.array(end, np.int64), score))
        b, e, score = (np.concatenate(x) for x in zip(*later))
        order = np.argsort(e, kind="stable")
        b, e, score = b[order], e[order], score[order]
        upto = hi if hi < n else n + 1
        cuts = np.searchsorted(e, np.arange(lo, upto + 1))
        for t in range(lo, upto):
            if t:
                top = np.full(y, -np.inf)
                top[-1] = into[(t - 1) % ring, -1]
                s = slice(cuts[t - lo], cuts[t - lo + 1])
                if s.stop > s.start:
                    value = into[b[s] % ring, :-1] + score[s]
                    k = value.argmax(0)
                    top[:-1] = value[k, np.arange(y - 1)]
                    came[t] = t - b[s][k]
            joined = top[:, None] + field.joins
            prev[t] = y - 1 - joined[::-1].argmax(0)
            into[t % ring] = joined[prev[t], np.arange(y)]
        left = slice(cuts[-1], None)
        later = [(b[left], e[left], score[left])]
        if hi == n:
            break
    out, t, kind = [], n, y - 1 - int(top[::-1].argmax())
    while t:
        if kind == y - 1:
            t -= 1
        else:
            start = t - int(came[t, kind])
            out.append((int(bounds[start, 0]), int(bounds[t - 1, 1]), kind))
            t = start
        kind = int(prev[t, kind]) if t else kind
    return out[::-1]


def fit_field(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """Stochastic gradient steps (scaled by past gradients) on the log-likelihood of the labelled stretches."""
    y = len(KINDS) + 1
    field = Field(np.zeros((ROWS, y - 1)), np.zeros((y, y)))
    field.weights[_row("bias")] = -1.0
    past_w, past_j = np.full(field.weights.shape, 1e-6), np.full(field.joins.shape, 1e-6)
    data = []
    for text, spans in examples:
        x = lattice(text)
        place = {(x.spans[b][0], x.spans[e - 1][1]): s for s, (b, e) in enumerate(zip(x.begin.tolist(), x.end.tolist()))}
        gold = sorted((place[a, b], KINDS.index(k)) for k, a, b in spans if (a, b) in place)
        if len(x.begin):
            data.append((x, gold))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            x, gold = data[i]
            score = field.scores(x)
            alpha, into = field.forward(x, score)
            beta = field.backward(x, score)
            total = _sum(alpha[-1], 0)
            expected = np.exp(into[x.begin, :-1] + score + beta[x.end, :-1] - total)
            delta = -expected
            for s, k in gold:
                delta[s, k] += 1
            grad = np.zeros_like(field.weights)
            np.add.at(grad, x.rows.ravel(), np.repeat(delta, x.rows.shape[1], axis=0))
            past_w += grad * grad
            field.weights += RATE * grad / np.sqrt(past_w)
            # what follows what: the gold cut's joins minus the expected ones
            join = np.zeros_like(field.joins)
            types = np.full(len(x.spans) + 1, -2)
            for s, k in gold:
                types[x.begin[s]] = k
                types[x.begin[s] + 1 : x.end[s]] = -3
            last = y - 1
            for t in range(len(x.spans)):
                if types[t] == -3:
                    continue
                now = y - 1 if types[t] == -2 else types[t]
                join[last, now] += 1
                last = now
            out = np.exp(alpha[:-1, :, None] + field.joins[None, :, -1:] + beta[1:, None, -1:] - total).sum(0)
            join[:, -1:] -= out
            step = score + beta[x.end, :-1]
            join[:, :-1] -= np.exp(alpha[x.begin][:, :, None] + field.joins[None, :, :-1] + step[:, None, :] - total).sum(0)
            past_j += join * join
            field.joins += RATE * join / np.sqrt(past_j)
    return field


_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"']?([0-9A-Za-z]{16,64})(?![0-9A-Za-z])")


def labelled(text: str) -> list[tuple[str, int, int]]:
    """What is taken for true in training: the exact patterns and assigned secrets, the longer one where two meet."""
    spans = base_spans(text) + [("secret", *m.span(1)) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1])]
    out: list[tuple[str, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]))):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in out):
            out.append(s)
    return out


def made_up(words: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Stretches with invented data in the spellings that the patterns don't know, and with harmless numbers."""
    rng = np.random.default_rng(SEED)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: words[int(rng.integers(len(words)))]
    out = []
    for i in range(MADE_UP):
        card = digits(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        hexed = hashlib.sha256(f"{SEED}/{i}".encode()).hexdigest()[: int(rng.choice([32, 40, 64]))]
        a, b, c = digits(3), digits(3), digits(4)
        octets = ".".join(map(str, rng.integers(0, 256, 4)))
        for kind, value in (
            ("phone", f"({a}) {b}-{c}"), ("phone", f"{a}-{b}-{c}"), ("phone", f"+1 ({a}) {b}-{c}"), ("phone", f"+{digits(2)} {a} {b} {c}"),
            ("card", card), ("card", "-".join(card[k : k + 4] for k in range(0, 16, 4))), ("ip", octets),
            ("email", f"{word().lower()}.{digits(2)}@mail{digits(1)}.example.com"), ("email", f"{word().lower()}@example.org"), ("secret", hexed),
            ("", digits(int(rng.integers(1, 9)))), ("", f"{digits(1)}.{digits(2)}"), ("", f"{digits(2)},{digits(3)}"), ("", f"@{word().lower()}"),
            ("", f"{digits(4)}-{digits(2)}-{digits(2)}"), ("", digits(16)[:15] + "x"),
        ):
            before = f"{word()} {word()} " + ('token = "' if kind == "secret" else "")
            text = f"{before}{value}{chr(34) if kind == 'secret' else ''} {word()} {word()}"
            out.append((text, [(kind, len(before), len(before) + len(value))] if kind else []))
    return out


def learn(docs: DataFrame, text: str = "text") -> Field:
    """A field fitted on a bounded sample of stretches and on made-up ones with words of the sample."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = smallest_hashes(docs.select(t.alias("t")).filter(F.col("t").rlike("[0-9@]")), [F.col("t")], SAMPLE_DOCS).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            out = [x[a:b] for x in part.column("t").to_pylist() for a, b in stretches(x) if b - a <= 1000]
            yield pa.record_batch({"s": pa.array(out, pa.string())})

    found = [r["s"] for r in chosen.mapInArrow(cut, "s string").distinct().orderBy(F.xxhash64("s")).limit(SAMPLE_STRETCHES).collect()]
    words = sorted({w for s in found for w in re.findall(r"[^\W\d_]+", s)}) or ["the", "and", "of"]
    return fit_field([(s, labelled(s)) for s in found] + made_up(words))


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the field adds); an added span meets no base span."""
    base = base_spans(text)
    lows, highs = [], []  # what the base spans cover, as ranges apart from each other
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if highs and a < highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    added = []
    for a, b in stretches(text):
        for start, end, kind in entities(text[a:b], field):
            near = bisect.bisect_left(lows, a + end) - 1
            if near < 0 or highs[near] <= a + start:
                added.append((KINDS[kind], a + start, a + end))
    return base, added


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of every whole text.

    The counts and the digest are of the base spans, ``spans`` has the added ones too. Row-local once the
    field is fitted. Null and empty texts have no spans. Repeated rows and null ids come back as they
    are; an empty table gives an empty result (the field is then fitted on made-up stretches alone).
    """
    field = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for t in part.column("text").to_pylist():
                base, added = all_spans(t or "", field.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*counts, len(added), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"],
            )

    plain = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return plain.mapInArrow(find, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null, other columns stay as they are."""
    field = docs.sparkSession.sparkContext.broadcast(learn(docs, text))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            at = part.schema.get_field_index(text)
            new = [t if t is None else masked(t, sum(all_spans(t, field.value), [])) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)
