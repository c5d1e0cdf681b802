"""Benchmark decontamination by templates.

Words of documents and benchmark items become a template: a word with a digit is a number, a listed word
after a number is a unit, a word inside a sentence whose first letter alone is a capital is a name; each is replaced by a placeholder
of its type, and its own hash is kept as the slot's value. Other words lose case and enclosing marks.
Windows of `size` words of the templates are hash-joined; an item of fewer words is one window.

A name of an item is also looked for as the plain word, in all mixtures with the placeholder: lower-case
copies of an item match, each such word as the slot with the item's own value.

Matches of one item along one diagonal (document position minus item position) are one run. In a run each
value of the item stands for the document's value that it meets at most places, for none on a tie. A window
counts if all its slots follow that, or if all its values are the item's own; others are left out, one by
one. Different values may meet the same one. So an item with other numbers or names is caught, text that
merely shares the template's frame with mixed-up values is not. A document is contaminated by an item if the
windows that count are at least `share` of the item's windows.

The benchmark is a query set: up to BROADCAST_WINDOWS distinct windows (8 bytes each) its hashes are told to
every task, which then emits matching windows only; beyond that every window of the documents is joined.

Defined results: null or empty texts and items have no windows and match nothing; rows with equal doc_id
count as one document; rows with equal item_id as one item; a null doc_id is never contaminated; an item
whose id is null is not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import CACHE_BYTES, flat, keep, list_array, slices

SIZE = 5
SHARE = 0.5
BROADCAST_WINDOWS = 1_000_000

# Words that are units when they follow a number.
UNITS = (
    "mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years percent degree degrees meter meters metre metres mile miles foot feet inch inches gram grams "
    "pound pounds liter liters litre litres dollar dollars euro euros cent cents"
).split()

_B, _C, _D = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (3, 5, 7))


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SPACE = _marks(" \t\n\x0b\f\r")
_DIGIT = _marks("0123456789")
_OPENING, _CLOSING, _STOP = _marks("\"'([{<*_"), _marks(".,;:!?\"')]}>*_"), _marks(".!?:")
_UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CODES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def templates(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template word and slot value (0: none) of every word, and how many words each text has."""
    n, none = len(data), np.zeros(0, np.uint64)
    if not n:
        return none, none, np.zeros(len(ends) - 1, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begin = np.flatnonzero(~space & (edge[:n] | np.concatenate(([True], space[:-1]))))
    if not len(begin):
        return none, none, np.zeros(len(ends) - 1, np.int64)
    stop = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    counts = np.diff(np.searchsorted(begin, ends))
    last_mark = _STOP[data[stop - 1]]
    low, high = begin.copy(), stop.copy()
    for table, move in ((_OPENING, 1), (_CLOSING, -1)):
        live = np.arange(len(begin))
        while len(live):
            at = low[live] if move > 0 else high[live] - 1
            live = live[table[data[at]] & (high[live] - low[live] > 1)]
            (low if move > 0 else high)[live] += move
    # a capital é is two bytes; the second differs from the small letter by one bit
    codes = _CODES[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    codes[accent] = _CODES[data[accent] + 0x20]
    place = np.zeros(n, np.int64)
    place[begin] = low
    place = np.arange(n) - np.maximum.accumulate(place)
    inside = np.zeros(n + 1, np.int8)
    inside[low] += 1
    inside[high] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8).view(bool)
    powers = np.cumprod(np.full(max(int(place.max()), 0) + 1, _B))
    codes *= powers[np.maximum(place, 0)]
    codes[~inside] = 0
    words = _mixed(np.add.reduceat(codes, begin)) | np.uint64(16)
    number = np.maximum.reduceat(_DIGIT[data] & inside, begin)
    starts = np.zeros(len(begin), bool)
    starts[np.searchsorted(begin, ends[:-1])[counts > 0]] = True
    starts[1:] |= last_mark[:-1]
    breaks = np.flatnonzero(data == 10)
    starts[np.searchsorted(begin, breaks)[np.searchsorted(begin, breaks) < len(begin)]] = True
    upper = _UPPER[data[low]]
    wide = np.flatnonzero((data[low] == 0xC3) & (low + 1 < n))
    upper[wide] |= (data[low[wide] + 1] >= 0x80) & (data[low[wide] + 1] <= 0x9E)
    # a word in capitals throughout is no name: whole texts in capitals keep their words
    second = low + 1
    second[wide] += 1
    at = np.minimum(second, n - 1)
    loud = _UPPER[data[at]] | ((data[at] == 0xC3) & (data[np.minimum(at + 1, n - 1)] <= 0x9E))
    name = upper & ~starts & ~number & ~(loud & (second < high))
    unit = np.zeros(len(begin), bool)
    after = np.flatnonzero(number[:-1] & ~starts[1:]) + 1
    unit[after] = np.isin(words[after], _UNIT_HASHES)
    name &= ~unit
    template = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, words)))
    return template, np.where(number | name | unit, words, np.uint64(0)), counts


_UNIT_HASHES = np.zeros(0, np.uint64)
with np.errstate(over="ignore"):
    _UNIT_HASHES = np.array(
        [templates(np.frombuffer(f"{u} ".encode(), np.uint8), np.array([0, len(u) + 1]))[0][0] for u in UNITS]
    )


def windows(
    template: np.ndarray, counts: np.ndarray, size: int, slots: np.ndarray | None = None, plain: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window, the text it is in, and the number of its first word there.

    With `plain`, places of its bits count by their slot's value, and only windows with names there are returned.
    """
    many = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    if not len(owner):
        return np.zeros(0, np.int64), owner, place
    first = (np.cumsum(counts) - counts)[owner] + place
    total = np.full(max(len(template) - size + 1, 0), size, np.uint64)
    for k in range(size):
        source = slots if plain >> k & 1 else template
        total = total * _D + source[k : len(template) - size + 1 + k]
        if plain >> k & 1:
            good = template[first + k] == _NAME
            first, owner, place = first[good], owner[good], place[good]
    return _mixed(total)[first].view(np.int64), owner, place


SCHEMA = "id long, h long, place long, slots array<long>"


def _rows(df: DataFrame, key: str, sizes: list[int], wanted: object | None, exact: bool) -> DataFrame:
    """Rows (id, h, place, slots) of the windows of a table; with `wanted`, of those hashes only;
    with `exact`, windows below the largest size only where they are a whole text, and names also as plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = wanted.value if wanted is not None else None
        filter_ = None
        if among is not None:
            filter_ = np.zeros(1 << 20, bool)
            filter_[among.view(np.uint64) >> np.uint64(44)] = True
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                with np.errstate(over="ignore"):
                    template, slots, counts = templates(*flat(part.column("text")))
                    found = []
                    for size, plain in ((n, bits) for n in sizes for bits in range(1 << n if exact else 1)):
                        h, owner, place = windows(template, counts, size, slots, plain)
                        if exact and size != max(sizes):
                            good = counts[owner] == size
                            h, owner, place = h[good], owner[good], place[good]
                        if filter_ is not None:
                            good = np.flatnonzero(filter_[h.view(np.uint64) >> np.uint64(44)])
                            if len(good):
                                at = np.minimum(np.searchsorted(among, h[good]), len(among) - 1)
                                good = good[among[at] == h[good]]
                            h, owner, place = h[good], owner[good], place[good]
                        found.append((size, h, owner, place))
                ids = part.column("id")
                base = np.cumsum(counts) - counts
                for size, h, owner, place in found:
                    if len(h):
                        cells = slots[(base[owner] + place)[:, None] + np.arange(size)].view(np.int64)
                        lists = list_array(pa.array(cells.ravel()), np.full(len(h), size))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(h), pa.array(place), lists], ["id", "h", "place", "slots"])

    return df.select(F.col(key).cast("long").alias("id"), "text").filter("id is not null").mapInArrow(run, SCHEMA)


def _stands_for(met: DataFrame, run: list[str]) -> DataFrame:
    """Per run, a map from the item's values to the document's value that each meets at most places, without ties."""
    slots = met.select(*run, F.explode("pairs").alias("p")).select(*run, "p.at", "p.a", "p.b").distinct()
    often = slots.groupBy(*run, "a", "b").agg(F.count("*").alias("n"))
    # the greatest and the least of the values met most often
    top = often.groupBy(*run, "a").agg(
        F.max(F.struct("n", "b"))["b"].alias("b"), F.bitwise_not(F.max(F.struct("n", F.bitwise_not("b").alias("c")))["c"]).alias("least")
    )
    entries = F.collect_list(F.struct("a", "b"))
    return top.filter("b = least").groupBy(*run).agg(F.map_from_entries(entries).alias("stands_for"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, item_id, share) of documents contaminated by an item."""
    lengths = list(range(1, size + 1))
    items = keep(_rows(benchmark, "item_id", lengths, None, True))
    used = [r[0] for r in items.select(F.size("slots")).distinct().collect()]  # at most `size` of them
    short = items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS  # rows: equal items repeat their hashes
    distinct = items.select("h").distinct()
    few = short or distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    wanted = None
    if few:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in distinct.collect()], np.int64)))
    found = _rows(docs, "doc_id", sorted(used) or [size], wanted, False)
    side = items.select("h", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = found.join(F.broadcast(side) if short else side.hint("merge"), "h")
    # a slot of the item that meets a plain word met its own value
    own = lambda p: F.when(p["slots"] == 0, p["item_slots"]).otherwise(p["slots"])
    pair = lambda p, i: F.struct((F.col("item_place") + i).alias("at"), p["item_slots"].alias("a"), own(p).alias("b"))
    pairs = F.filter(F.transform(F.arrays_zip("item_slots", "slots"), pair), lambda p: p["a"] != 0)
    diagonal = (F.col("place") - F.col("item_place")).alias("diagonal")
    met = keep(met.select("id", "item_id", diagonal, F.col("item_place").alias("place"), pairs.alias("pairs")))
    run = ["id", "item_id", "diagonal"]
    steady = met.join(_stands_for(met, run), run, "left").filter(
        F.forall("pairs", lambda p: p["a"] == p["b"])
        | F.forall("pairs", lambda p: F.coalesce(F.try_element_at("stands_for", p["a"]) == p["b"], F.lit(False)))
    )
    matched = steady.select("id", "item_id", "place").distinct().groupBy("id", "item_id").agg(F.count("*").alias("n"))
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("place").alias("all"))
    scored = matched.join(sizes, "item_id").withColumn("share", F.col("n") / F.col("all"))
    return scored.filter(F.col("share") >= share).select(F.col("id").alias("doc_id"), "item_id", "share")


def verdicts(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """Per row of docs: doc_id, contaminated, n_items, item_ids (ascending, comma-joined)."""
    found = hits(docs, benchmark, size, share).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left")
    count = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    return joined.select(
        "doc_id",
        (count > 0).alias("contaminated"),
        count.cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = SHARE) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    bad = keep(hits(docs, benchmark, size, share).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
