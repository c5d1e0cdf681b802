"""Periodic runs of words: recursive frequency splitting, then lag scans.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(`least`, 2 q) words that no neighbouring word extends keeping period q. Rows are independent; the rows of a
slice are worked on together in numpy.

1. Splitting. A word of a run has an equal word q places before or after it inside the run, so at most half the
   segment's length away. Words without one are too rare in their segment and split it; pieces that have lost a
   word are counted again until none does, pieces under `least` words go.
2. Lag scan. Lags under FIRST are compared word by word over all surviving segments. A run of period q in
   [2^k, 2^(k+1)) repeats at least q words at lag q and so one whole window of 2^(k-1) words that begins at a
   multiple of 2^(k-1): only lags at which such a window occurs again are scanned, at most 2 n a level, so a
   level costs a sort of its windows and a text of any length n * log(n) * log(n).
   Of windows next to each other at one lag the first is extended to both sides by halving over prefix hashes.
3. Stretches with the same ends have the least of their lags as period. Each run is then compared word by word;
   where two hashes agreed by chance, its segment is scanned at every lag instead.

Words are runs of anything but ASCII white space. Defined results: a null or empty text has no words, no runs and
an empty collapsed text; equal rows get equal results; keys may be null; an empty table gives no rows; columns
that are not among the keys are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import list_array, slices, spread

LEAST = 12
#: Lags under this are compared at every place.
FIRST = 8
#: Window pairs that are held at once.
PAIRS = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

RUN = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])


def segments(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches that words too rare to be in a run leave; ends: of the texts (rows + 1)."""
    starts, lengths = ends[:-1], np.diff(ends)
    kinds = np.int64(words.max(initial=0) + 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(starts):
        enough = lengths >= least
        starts, lengths = starts[enough], lengths[enough]
        at, segment = spread(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
        key = segment * kinds + words[at]
        order = np.argsort(key, kind="stable")
        near = (key[order[1:]] == key[order[:-1]]) & (at[order[1:]] - at[order[:-1]] <= lengths[segment[order[1:]]] // 2)
        held = np.zeros(len(at), bool)
        held[order[1:][near]] = held[order[:-1][near]] = True
        whole = np.ones(len(starts), bool)
        whole[segment[~held]] = False
        found.append((starts[whole], lengths[whole]))
        again = held & ~whole[segment]
        at, segment = at[again], segment[again]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        heads = np.flatnonzero(first)
        starts, lengths = at[heads], np.diff(np.concatenate((heads, [len(at)])))
    starts, lengths = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(starts)
    return starts[order], lengths[order]


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the stretches of True that have at least so many places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    return begins[lengths >= least], lengths[lengths >= least]


class Scan:
    """Surviving segments one after the other: words, the segment of each place, and the ends of segments."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, least: int):
        self.words, self.least = words, least
        self.ends = np.concatenate(([0], np.cumsum(lengths)))
        self.segment = np.repeat(np.arange(len(lengths)), lengths)
        n = len(words)
        codes = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        codes = (codes ^ (codes >> np.uint64(31))) * _MIX
        codes ^= codes >> np.uint64(29)
        powers = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
        self.down = powers(pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(_BASE)[:n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def needed(self, lag: np.ndarray | int) -> np.ndarray:
        """Places at which a run of this period agrees with the place a lag later."""
        return np.maximum(self.least - lag, lag)

    def short_lags(self, lags: range) -> Iterator[np.ndarray]:
        """Rows (begin, end, lag) of the stretches of each lag."""
        for lag in lags:
            if len(self.words) > lag:
                same = (self.words[lag:] == self.words[:-lag]) & (self.segment[lag:] == self.segment[:-lag])
                begins, lengths = _stretches(same, int(self.needed(lag)))
                yield np.stack((begins, begins + lengths + lag, np.full(len(begins), lag)), 1)

    def long_lags(self) -> Iterator[np.ndarray]:
        """The same for lags from FIRST on, by windows that occur again."""
        sizes, low = np.diff(self.ends), FIRST
        while (sizes >= 2 * low).any():
            for begin, lag in self._again(sizes >= 2 * low, low // 2, low):
                yield self._extended(begin, lag)
            low *= 2

    def _again(self, live: np.ndarray, width: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows at multiples of the width, and the lags in [low, 2 low) at which they occur again."""
        place = spread(self.ends[:-1], np.where(live, np.diff(self.ends) - width + 1, 0))
        key = self.hashes(place, place + width)
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        several = ~new | ~np.concatenate((new[1:], [True]))
        place, group = place[several], np.cumsum(new)[several]
        many = np.int64(len(self.words) + 2 * low + 1)
        table = group * many + place
        asked = np.flatnonzero(place % width == 0)
        since = np.searchsorted(table, table[asked] + low)
        until = np.searchsorted(table, table[asked] + 2 * low)
        total = np.concatenate(([0], np.cumsum(until - since)))
        k = 0
        while k < len(asked):
            stop = max(int(np.searchsorted(total, total[k] + PAIRS, "right")) - 1, k + 1)
            part, k = slice(k, stop), stop
            counts = until[part] - since[part]
            begin = np.repeat(place[asked[part]], counts)
            lag = place[spread(since[part], counts)] - begin
            inside = self.segment[begin] == self.segment[begin + lag]
            begin, lag = begin[inside], lag[inside]
            order = np.lexsort((begin, lag))
            begin, lag = begin[order], lag[order]
            head = np.ones(len(begin), bool)
            head[1:] = (lag[1:] != lag[:-1]) | (begin[1:] != begin[:-1] + width) | (self.segment[begin[1:]] != self.segment[begin[:-1]])
            yield begin[head], lag[head]

    def _extended(self, begin: np.ndarray, lag: np.ndarray) -> np.ndarray:
        own = self.segment[begin]
        left = self._longest(begin - self.ends[own], lambda n: (begin - n, begin), lag)
        right = self._longest(self.ends[own + 1] - begin - lag, lambda n: (begin, begin + n), lag)
        good = left + right >= self.needed(lag)
        return np.stack((begin - left, begin + lag + right, lag), 1)[good]

    def _longest(self, limit: np.ndarray, part: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], lag: np.ndarray) -> np.ndarray:
        """The largest n up to limit whose part equals the part a lag later."""
        low, high = np.zeros(len(limit), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = part(middle)
            same = self.hashes(a, b) == self.hashes(a + lag, b + lag)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def runs(self) -> np.ndarray:
        """Rows (begin, end, period) of all runs."""
        rows = [np.zeros((0, 3), np.int64), *self.short_lags(range(1, FIRST)), *self.long_lags()]
        found = self._least_lags(np.concatenate(rows))
        begin, lag = found[:, 0], found[:, 2]
        size = found[:, 1] - begin - lag
        a = spread(begin, size)
        other = self.words[a] != self.words[a + np.repeat(lag, size)]
        wrong = np.unique(self.segment[begin[np.repeat(np.arange(len(size)), size)[other]]])
        if len(wrong):
            kept = [found[~np.isin(self.segment[begin], wrong)]]
            for s in wrong:
                alone = Scan(self.words[self.ends[s] : self.ends[s + 1]], np.diff(self.ends[s : s + 2]), self.least)
                kept.append(self._least_lags(np.concatenate(list(alone.short_lags(range(1, len(alone.words) // 2 + 1))))) + [self.ends[s], self.ends[s], 0])
            found = np.concatenate(kept)
        return found

    @staticmethod
    def _least_lags(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        return rows[first]


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text, start in it, length and period of each run, by text, start and period; words: numbers of all texts' words."""
    with np.errstate(over="ignore"):
        starts, lengths = segments(words, ends, least)
        found = Scan(words[spread(starts, lengths)], lengths, least)
        begin, end, period = found.runs().T
        own = found.segment[begin]
    begin, end = (x - found.ends[own] + starts[own] for x in (begin, end))
    text = np.searchsorted(ends, begin, "right") - 1
    order = np.lexsort((period, begin))
    return tuple(x[order] for x in (text, begin - ends[text], end - begin, period))


Edit = Callable[[tuple, list[bytes]], list[bytes]]


def periodic_runs(
    docs: DataFrame, keys: Sequence[str], text: str = "text", least: int = LEAST, edit: Edit | None = None
) -> DataFrame:
    """Per row its keys, runs (array of start, length, period; by start, then period) and the collapsed text.

    The collapsed text is what is left, joined by one space, without the words that a run holds after its first
    period. `edit`, if given, may change a row's words before the search; it gets the values of the keys. Outputs
    are named `runs` and `collapsed`, so no key may be.
    """
    keys = list(keys)
    source = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").alias("collapsed"))
    kinds = "array<struct<start: int, length: int, period: int>>"
    schema = source.select(*(F.col(f"`{k}`") for k in keys), F.lit(None).cast(kinds).alias("runs"), "collapsed").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "collapsed"):
                rows = [t.encode().split() for t in part.column("collapsed").fill_null("").to_pylist()]
                if edit:
                    rows = [edit(k, w) for k, w in zip(zip(*(part.column(c).to_pylist() for c in keys)), rows)]
                ends = np.concatenate(([0], np.cumsum([len(w) for w in rows]))).astype(np.int64)
                number = {w: i for i, w in enumerate(set().union(*rows))}
                words = np.fromiter((number[w] for r in rows for w in r), np.int64, int(ends[-1]))
                owner, start, length, period = runs_of(words, ends, least)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, ends[owner] + start + period, 1)
                np.add.at(change, ends[owner] + start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                some = np.zeros(len(rows), bool)
                some[owner] = True
                texts = [
                    b" ".join(compress(w, kept[ends[i] : ends[i + 1]].tolist()) if some[i] else w).decode()
                    for i, w in enumerate(rows)
                ]
                found = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, length, period)], fields=list(RUN))
                counts = np.bincount(owner, minlength=len(rows))
                columns = [*(part.column(k) for k in keys), list_array(found, counts), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "runs", "collapsed"])

    return source.mapInArrow(run, schema)


def planted(key: tuple, words: list[bytes]) -> list[bytes]:
    """One text in ten, by the checksum of its id, repeats a stretch of its own words up to its end; a null id none."""
    if key[0] is None or not words:
        return words
    h = crc32(str(key[0]).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def report(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = periodic_runs(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], edit=planted)
    return found.select("*", longest.alias("longest")).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.expr("-longest.s").cast("long").alias("start"),
        F.expr("longest.l").cast("long").alias("length"),
        F.expr("-longest.p").cast("long").alias("period"),
        F.expr("1000L * longest.l div -longest.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
