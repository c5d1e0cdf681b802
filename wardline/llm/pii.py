"""Personal data: patterns with checks, and a linear-chain conditional random field over word shapes.

The base spans are leftmost matches of one pattern per kind that pass the kind's check. The field adds spans
that the patterns miss, such as telephone numbers without a plus sign. It tags tokens (runs without white
space) as outside, or as the beginning or inside of a kind, from shape features of a token and its two
neighbours. It is trained in numpy on the driver from the labelled table in pii_table.py and decoded by
Viterbi over batches of sequences of equal length. A sequence is a stretch of tokens with a digit or an @
and REACH tokens before and after; no kind has a span without a digit or an @, so nothing is left out. An
added span has to pass its kind's check and must not overlap a base span.

Positions are code points, the end exclusive. Defined results: a null or empty text has no spans; spans of
different kinds may overlap in the base, and `mask` then replaces their union under the first kind's name;
rows are independent, so repeated rows get equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import slices
from wardline.llm.pii_table import SENTENCES

# Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone")

TAGS = ("O", *(f"{mark}-{kind}" for kind in KINDS for mark in "BI"))
REACH = 3
#: Distinct tokens whose scores a worker remembers.
REMEMBER = 100_000

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always takes whole runs of digits, so it can only begin where a run begins.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_HINTS = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"\S+")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def good_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def good_card(text: str) -> bool:
    return 16 <= len(text) <= 40 and 16 <= len(number := digits(text)) <= 19 and luhn(number)


def good_phone(text: str) -> bool:
    return 8 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run before an @, the domain follows it."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            free = found.end()
            yield begin, free
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by pattern, by kind and start."""
    if not _HINT.search(text):
        return []
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if good_ip(m.group())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if good_card(m.group())]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if good_phone(m.group())]
    return out


def shape(token: str) -> str:
    """The token with runs of letters and digits reduced to what they look like."""
    run = lambda m: f"d{min(len(m.group()), 7)}"
    letters = re.sub(r"[A-Z]+", "X", re.sub(r"[^\W\dA-Z_]+", "x", token))
    return re.sub(r"[0-9]+", run, letters)[:24]


def traits(token: str) -> list[str]:
    """Features of one token."""
    bare = token.strip(".,;:!?<>\"'")
    number = len(digits(token))
    out = [f"shape={shape(bare)}", f"digits={min(number, 20)}", f"at={'@' in bare}", f"dots={min(bare.count('.'), 4)}"]
    out += [f"first={shape(token[:1])}", f"last={shape(token[-1:])}", f"letters={bool(re.search(r'[^\W\d_]', bare))}"]
    if not number and len(bare) <= 10:
        out.append(f"word={bare.lower().rstrip(':')}")
    if number and not re.search(r"[^0-9().+\-]", bare):
        out.append(f"plain={min(number, 20)}")
    return out


@dataclass
class Field:
    """Weights of the field: features of the token itself, of the one before and of the one after, transitions."""

    index: dict[str, int]
    weights: np.ndarray  # 3 x features x tags
    move: np.ndarray  # tags x tags
    begin: np.ndarray  # tags


def labelled() -> list[tuple[list[str], list[int]]]:
    """The table as tokens and tags."""
    rows = []
    for line in SENTENCES:
        text, spans = "", []
        for part in re.split(r"(\{[a-z]+:[^}]*\})", line):
            if part.startswith("{"):
                kind, _, inside = part[1:-1].partition(":")
                spans.append((kind, len(text), len(text) + len(inside)))
                text += inside
            else:
                text += part
        tokens, tags = [], []
        for m in _TOKEN.finditer(text):
            tag = "O"
            for kind, s, e in spans:
                if m.start() < e and m.end() > s:
                    tag = f"{'B' if m.start() <= s else 'I'}-{kind}"
            tokens.append(m.group())
            tags.append(TAGS.index(tag))
        rows.append((tokens, tags))
    return rows


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Fit by Adam on the conditional log-likelihood with a square penalty; forward-backward over all rows at once."""
    names = sorted({t for tokens, _ in rows for token in tokens for t in traits(token)})
    index = {t: i for i, t in enumerate(names)}
    n, width, tags = len(rows), max(len(t) for t, _ in rows), len(TAGS)
    at, where, step = [], [], []  # feature, row * width + place, offset of the neighbour + 1
    y, size = np.zeros((n, width), int), np.array([len(t) for t, _ in rows])
    for r, (tokens, marks) in enumerate(rows):
        y[r, : len(marks)] = marks
        for i, token in enumerate(tokens):
            for t in traits(token):
                for d in (-1, 0, 1):  # the token at i is seen from i - d
                    if 0 <= i - d < len(tokens):
                        at.append(index[t])
                        where.append(r * width + i - d)
                        step.append(d + 1)
    at, where, step = np.array(at), np.array(where), np.array(step)
    p = {"w": np.zeros((3, len(names), tags)), "move": np.zeros((tags, tags)), "begin": np.zeros(tags)}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    live = np.arange(width) < size[:, None]
    line = np.arange(n)
    for turn in range(1, rounds + 1):
        emit = np.zeros((n * width, tags))
        np.add.at(emit, where, p["w"][step, at])
        emit = emit.reshape(n, width, tags)
        fore = np.zeros((n, width, tags))
        fore[:, 0] = emit[:, 0] + p["begin"]
        for t in range(1, width):
            fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + p["move"], 1) + emit[:, t]
        back = np.zeros((n, width, tags))
        for t in range(width - 2, -1, -1):
            into = np.logaddexp.reduce(p["move"] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], into, 0)
        total = np.logaddexp.reduce(fore[line, size - 1], 1)
        chance = np.exp(fore + back - total[:, None, None]) * live[..., None]
        gap = chance.copy()
        gap[line[:, None], np.arange(width), y] -= live
        g = {"w": np.zeros_like(p["w"]), "move": np.zeros_like(p["move"]), "begin": gap[:, 0].sum(0)}
        np.add.at(g["w"], (step, at), gap.reshape(-1, tags)[where])
        for t in range(1, width):
            pair = fore[:, t - 1, :, None] + p["move"] + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            g["move"] += (np.exp(pair) * live[:, t, None, None]).sum(0)
            np.subtract.at(g["move"], (y[live[:, t], t - 1], y[live[:, t], t]), 1)
        for k in p:
            g[k] += penalty * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return Field(index, p["w"], p["move"], p["begin"])


def viterbi(emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best tags of a batch of sequences of equal length (rows x places x tags)."""
    rows, width, tags = emit.shape
    best, came = emit[:, 0] + begin, np.zeros((rows, width, tags), np.int8)
    for t in range(1, width):
        ways = best[:, :, None] + move
        came[:, t] = ways.argmax(1)
        best = ways.max(1) + emit[:, t]
    out = np.zeros((rows, width), np.int8)
    out[:, -1] = best.argmax(1)
    for t in range(width - 1, 0, -1):
        out[:, t - 1] = came[np.arange(rows), t, out[:, t]]
    return out


class Tagger:
    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.table = np.zeros((0, 3, len(TAGS)))

    def _ids(self, tokens: list[str]) -> list[int]:
        new = list(dict.fromkeys(t for t in tokens if t not in self.known))
        if new:
            rows = np.zeros((len(new), 3, len(TAGS)))
            for i, token in enumerate(new):
                ids = [self.field.index[t] for t in traits(token) if t in self.field.index]
                rows[i] = self.field.weights[:, ids].sum(1)
                self.known[token] = len(self.known)
            self.table = np.concatenate([self.table, rows])
        return [self.known[t] for t in tokens]

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field finds, per text, unchecked against the base."""
        if len(self.known) > REMEMBER:
            self.known, self.table = {}, np.zeros((0, 3, len(TAGS)))
        by_size: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        for k, text in enumerate(texts):
            if not _HINT.search(text):
                continue
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            hints = np.array([m.start() for m in _HINTS.finditer(text)])
            hot = np.unique(np.searchsorted(np.array([s for s, _ in tokens]), hints, "right") - 1)
            begin = 0
            breaks = np.flatnonzero(np.diff(hot) > 2 * REACH) + 1
            for group in np.split(hot, breaks):
                low, high = max(group[0] - REACH, begin), min(group[-1] + REACH + 1, len(tokens))
                by_size.setdefault(high - low, []).append((k, tokens[low:high]))
                begin = high
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for size, stretches in by_size.items():
            step = max(1, 20_000 // size)
            for i in range(0, len(stretches), step):
                part = stretches[i : i + step]
                ids = np.array(self._ids([texts[k][s:e] for k, spans in part for s, e in spans])).reshape(-1, size)
                emit = self.table[ids, 1]
                emit[:, 1:] += self.table[ids[:, :-1], 0]
                emit[:, :-1] += self.table[ids[:, 1:], 2]
                tags = viterbi(emit, self.field.move, self.field.begin)
                for row in np.flatnonzero(tags.any(1)):
                    k, spans = part[row]
                    out[k] += self._spans(texts[k], spans, tags[row])
        return out

    @staticmethod
    def _spans(text: str, spans: list[tuple[int, int]], tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
        i = 0
        while i < len(tags):
            name = TAGS[tags[i]]
            j = i + 1
            if name != "O":
                while j < len(tags) and TAGS[tags[j]] == f"I-{name[2:]}":
                    j += 1
                found = trimmed(name[2:], text, spans[i][0], spans[j - 1][1])
                if found:
                    yield found
            i = j


def trimmed(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The part of a tagged stretch that looks like its kind, if that passes the kind's check."""
    inside = text[start:end]
    if kind == "email":
        for s, e in emails(inside):
            return kind, start + s, start + e
        return None
    pattern = {"ip": _IP, "card": _CARD, "phone": re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")}[kind]
    check = {"ip": good_ip, "card": good_card, "phone": lambda t: 9 <= len(digits(t)) <= 15 and "." not in t.strip(".")[:1]}[kind]
    found = pattern.search(inside)
    if found and check(found.group()):
        return kind, start + found.start(), start + found.end()
    return None


def all_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """Base and added spans per text, by kind and start."""
    out = []
    for text, more in zip(texts, tagger.added(texts)):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        taken = [(s, e) for _, s, e in base]
        for kind, s, e in more:
            if all(e <= a or s >= b for a, b in taken):
                spans.append((kind, s, e, False))
                taken.append((s, e))
        out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    out, end = [], 0
    last_kind, last = "", None
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if last is not None and s < last:
            last = max(last, e)
            continue
        if last is not None:
            end = last
        out += [text[end:s], f"<{kind.upper()}>"]
        last_kind, last = kind, e
    return "".join(out) + text[last if last is not None else 0 :]


def find(df: DataFrame, text: str = "text", spans: str = "spans", mask: bool = False) -> DataFrame:
    """Add the spans of a text; with `mask`, the text itself comes back with its spans replaced."""
    shared = df.sparkSession.sparkContext.broadcast(train(labelled()))
    kept = [c for c in df.columns if c != spans]
    source = df.select(*(f"`{c}`" for c in kept))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                texts = column.fill_null("").to_pylist()
                found = all_spans(tagger, texts)
                columns = {c: part.column(c) for c in kept}
                if mask:
                    new = [masked(t, s) if s else t for t, s in zip(texts, found)]
                    columns[text] = pa.array([None if n else t for t, n in zip(new, column.is_null().to_pylist())], column.type)
                rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in one] for one in found]
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, kind)], [*kept, spans])

    return source.mapInArrow(run, source.withColumn(spans, F.lit(None).cast(SPANS)).schema)


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base counts, digest of the base spans, all spans."""
    found = find(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))
