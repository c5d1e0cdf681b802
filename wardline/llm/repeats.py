"""Removal of repeated byte strings by suffix buckets (bucket-pointer refinement).

Every byte covered by a string of `length` bytes that also starts in a document of smaller doc_id goes.
Strings are judged on the input, overlaps count, and no string crosses documents.

1. Every string of `length` bytes belongs to one anchor: its leftmost q-gram of least hash. Neighbouring
   strings mostly share their anchor; the bytes under all strings of an anchor are its context. Equal strings
   have equal anchors at equal places, so the initial q-gram buckets can be dealt out by the anchor's hash.
   A task sends for each anchor hashes of the q-gram and the context, never text, and settles at once what
   an equal context of a smaller doc_id in its own batch covers whole.
2. In a bucket, an anchor with the same context as one of smaller doc_id is covered whole. This settles the
   inside of long repeats. What is left are contexts that differ but may share strings. A context's strings lie in
   cells, by how many of their bytes precede the q-gram, and all strings of a cell have a window of bytes in common:
   a string can only be shared where the window of its cell is, and covered only where that stands in two documents.
3. For these cells the bytes are fetched, and a suffix array of them, sorted to depth `length`, is built by
   bucket-pointer refinement: buckets of equal first bytes are split by the bucket numbers at a later offset,
   and the new numbers serve the next refinement, which reaches twice as far. The strings of a final bucket
   are equal; those that are not of its smallest doc_id are covered.
   The windows are dealt out over the parts of a range, not the q-grams, so a frequent q-gram spreads over them.
   Of a window in many surroundings the strings themselves are dealt out instead, by wide hashes made of
   (bucket, bucket at a later offset) in the same steps; strings that are equal in a slice are sent once, the others
   of it go on as runs, and the smallest doc_id of each is a partial aggregate. So a passage in many surroundings
   spreads over tasks.
4. The intervals go to their documents, which are rewritten.

Contexts are told apart by 64 bits beside the bucket. Texts of over PIECE bytes are walked in pieces that
overlap by length - 1 bytes, so that no string is lost.

Defined results: a null text is empty; texts under `length` bytes stay as they are; rows of equal doc_id
never cover each other, and equal rows get equal results; a row with null doc_id covers nothing and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import CACHE_BYTES, flat, keep, list_array, slices, spread

LENGTH = 50
GRAM = 16
PIECE = 4 << 20
#: Cells of a context's strings.
CELLS = 3
#: Parts of a range, by the window, whose contexts are sorted separately.
PARTS = 8
#: Contexts of one window up to which they are sorted together (about 4 KB each); beyond, their strings are dealt out.
HOT_CONTEXTS = 1_000

_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_CODES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: What a task sends for an anchor: rest of the q-gram's hash, hash of the context, hashes of its cells' windows (0: none),
#: number of the document in the block, begin of the context, place of the q-gram in it and strings less one.
ENTRY = np.dtype([("gram", "u4"), ("context", "u8"), ("windows", "u4", CELLS), ("doc", "u2"), ("start", "u4"), ("at", "u1"), ("more", "u1")])

COVERED = "doc_id long, mark long, starts array<int>, ends array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _D
    return x ^ (x >> np.uint64(32))


def cell_edges(length: int, gram: int) -> list[int]:
    """The strings of cell i have at least edges[i] and under edges[i + 1] bytes before the q-gram."""
    return [(length - gram + 1) * i // CELLS for i in range(CELLS + 1)]


class Walker:
    """Finds the anchors of texts; keeps the powers that the hashes need."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.edges = cell_edges(length, gram)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))))
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse, np.uint64))))

    def anchors(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per anchor: full hash, context hash, hash of both, window hashes, text, begin in the text, place in the context, strings - 1."""
        n, length, gram = len(data), self.length, self.gram
        free = length - gram
        sizes = np.diff(ends)
        many = np.maximum(sizes - length + 1, 0)
        if not many.sum():
            return (*(np.zeros(0, "u8"),) * 3, np.zeros((0, CELLS), "u4"), *(np.zeros(0, "i8"),) * 4)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * self.up[:n], out=sums[1:])
        grams = _mixed((sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1])
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= free + 1:  # least hash of 2, 4, ... neighbouring q-grams
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < free + 1:
            low = np.minimum(low[: len(low) - (free + 1 - reach)], low[free + 1 - reach :])
        begins = np.repeat(ends[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place = (low[begins] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        more = np.diff(np.concatenate((first, [len(place)]))) - 1
        place, start = place[first], begins[first]
        part = lambda a, b: _mixed((sums[b] - sums[a]) * self.down[a])
        context = part(start, start + more + length) ^ ((place - start) << 8 | more).astype(np.uint64) * _D
        windows = np.zeros((len(place), CELLS), "u4")
        for cell, (low, high) in enumerate(zip(self.edges, self.edges[1:])):
            has = np.flatnonzero((low < high) & (place - start >= low) & (place - start - more < high))
            windows[has, cell] = (part(place[has] - low, place[has] - (high - 1) + length) >> np.uint64(32)) | np.uint64(1)
        owner = np.searchsorted(ends, start, "right") - 1
        # the least of many hashes is small: mixed again, the ranges get equal shares
        grams, context = _mixed(grams[place]), _mixed(context)
        return grams, context, _mixed(grams) ^ context, windows, owner, start - ends[owner], place - start, more

    def texts(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchors of a flat byte array, long texts in pieces."""
        if len(ends) != 2 or len(data) <= PIECE:
            yield self.anchors(data, ends)
            return
        for at in range(0, len(data) - self.length + 1, PIECE):
            piece = data[at : at + PIECE + self.length - 1]
            *rest, start, place, more = self.anchors(piece, np.array([0, len(piece)]))
            yield (*rest, start + at, place, more)


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _by_document(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray | pa.Array, ...]:
    """Documents that occur, and lists of the values of each."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    heads = np.flatnonzero(_first_of_runs(doc)) if len(doc) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate((heads, [len(doc)])))
    return doc[heads], *(list_array(pa.array(x[order].astype(np.int32)), many) for x in values)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a mark that tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def _send(docs: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    """Blocks of entries by range, and rows without entries for what is settled inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(length, gram)
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            parts, row = [], 0
            with np.errstate(over="ignore"):
                for part in slices(batch, "text", CACHE_BYTES):
                    for found in walker.texts(*flat(part.column("text"))):
                        parts.append((*found[:4], found[4] + row, *found[5:]))
                    row += part.num_rows
                if not parts:
                    continue
                grams, context, key, windows, owner, start, at, more = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids[owner], key))
            key, doc = key[order], ids[owner[order]]
            head = np.flatnonzero(_first_of_runs(key))
            least = np.repeat(doc[head], np.diff(np.concatenate((head, [len(key)]))))
            gone, stay = order[doc > least], order[doc == least]
            rows, starts, ends = _by_document(owner[gone], start[gone], start[gone] + more[gone] + length)
            none = pa.array([None] * len(rows), pa.binary())
            spot = pa.array((ids[rows] % ranges).astype(np.int32))
            yield pa.RecordBatch.from_arrays([spot, none, none, none, pa.array(ids[rows]), pa.array(marks[rows]), starts, ends], names)
            entries = np.zeros(len(stay), ENTRY)
            for name, values in (("gram", grams), ("context", context), ("windows", windows), ("doc", owner), ("start", start), ("at", at), ("more", more)):
                entries[name] = values[stay].astype(ENTRY[name].base)
            place = (((grams[stay] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(ranges + 1))
            for r in range(ranges):
                block = entries[order[cuts[r] : cuts[r + 1]]]
                if not len(block):
                    continue
                used, block["doc"] = np.unique(block["doc"], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r], pa.int32()),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (block, ids[used], marks[used])),
                        *(pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))),
                    ],
                    names,
                )

    schema = "range int, entries binary, entry_ids binary, entry_marks binary, " + COVERED
    names = [n.split()[0] for n in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def _meet(sent: DataFrame, length: int, gram_size: int) -> DataFrame:
    """What equal contexts cover (kind 0), and the cells of contexts to be fetched, with the part that each is sorted in
    (kind 1) or of windows that have too many contexts for that (kind 2)."""
    edges = np.array(cell_edges(length, gram_size))

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        full = table.column("entries").is_valid()
        early = table.filter(pa.compute.invert(full)).select(["doc_id", "mark", "starts", "ends"])
        n = early.num_rows
        out = [pa.table([pa.array(np.zeros(n, np.int32)), *early.columns, pa.nulls(n, pa.list_(pa.int32()))], names)]
        table = table.filter(full)
        if not table.num_rows:
            return out[0]
        blocks, ids, marks = [], [], []
        for one, i, m in zip(*(table.column(c).to_pylist() for c in ("entries", "entry_ids", "entry_marks"))):
            block = np.frombuffer(one, ENTRY)
            blocks.append(block)
            ids.append(np.frombuffer(i, np.int64)[block["doc"]])
            marks.append(np.frombuffer(m, np.int64)[block["doc"]])
        entries, ids, marks = np.concatenate(blocks), np.concatenate(ids), np.concatenate(marks)
        del blocks
        order = np.lexsort((ids, entries["context"], entries["gram"]))
        gram, context, doc = entries["gram"][order], entries["context"][order], ids[order]
        head = np.flatnonzero(_first_of_runs(gram, context))
        many = np.diff(np.concatenate((head, [len(order)])))
        covered = doc > np.repeat(doc[head], many)
        stay = order[~covered]
        asked = {kind: [(np.zeros(0, np.int64), 0)] for kind in (1, 2)}
        for cell in range(CELLS):
            some = stay[entries["windows"][stay, cell] > 0]
            pair = entries["gram"][some].astype(np.uint64) << np.uint64(32) | entries["windows"][some, cell]
            by = np.argsort(pair)
            some, first = some[by], np.flatnonzero(_first_of_runs(pair[by]))
            if not len(first):
                continue
            size = np.diff(np.concatenate((first, [len(some)])))
            several = np.minimum.reduceat(ids[some], first) < np.maximum.reduceat(ids[some], first)
            hot = size > HOT_CONTEXTS
            for kind, windows in ((1, several & ~hot), (2, several & hot)):
                asked[kind].append((some[np.repeat(windows, size)], cell))
        for kind in range(3):
            chosen = np.concatenate([x for x, _ in asked[kind]]) if kind else order[covered]
            start, at, more = (entries[c][chosen].astype(np.int64) for c in ("start", "at", "more"))
            end = start + more + length
            window = np.zeros(len(chosen), np.uint32)
            if kind:
                cell = np.repeat([c for _, c in asked[kind]], [len(x) for x, _ in asked[kind]])
                window = entries["windows"][chosen, cell]
                # bytes before the q-gram in the first and the last string
                most, least = np.minimum(at, edges[cell + 1] - 1), np.maximum(at - more, edges[cell])
                start, end = start + at - most, start + at - least + length
            # rows of one document: by id and mark
            key = _mixed(ids[chosen].view(np.uint64)) ^ marks[chosen].view(np.uint64)
            rows, starts, ends, places = _by_document(key, start, end, r * PARTS + (entries["gram"][chosen] ^ window >> 8) % PARTS)
            at = np.zeros(len(rows), np.int64)
            at[np.searchsorted(rows, key)] = chosen
            kinds = pa.array(np.full(len(rows), kind, np.int32))
            places = places if kind else pa.nulls(len(rows), places.type)
            out.append(pa.table([kinds, pa.array(ids[at]), pa.array(marks[at]), starts, ends, places], names))
        return pa.concat_tables(out)

    schema = f"kind int, {COVERED}, places array<int>"
    names = [n.split()[0] for n in schema.split(", ")]
    return sent.groupBy("range").applyInArrow(run, schema)


def refined(buckets: np.ndarray, starts: np.ndarray, offset: int) -> np.ndarray:
    """Split the buckets of suffixes by the bucket numbers that stand `offset` places later.

    Buckets of one member stay as they are; a member of a split bucket gets the number of its new place.
    """
    size = np.bincount(buckets[starts], minlength=int(buckets.max(initial=0)) + 1)
    live = starts[size[buckets[starts]] > 1]
    if not len(live):
        return buckets
    own, later = buckets[live], buckets[live + offset]
    order = np.lexsort((later, own))
    new = _first_of_runs(own[order], later[order])
    fresh = int(buckets.max()) + np.cumsum(new)
    out = buckets.copy()
    out[live[order]] = fresh
    return out


def equal_strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For suffixes at `starts`, numbers that are equal where the first `length` bytes are."""
    gram = min(8, length)
    size = max(len(data) - gram + 1, 0)
    value = np.zeros(size, np.uint64)
    for j in range(gram):
        value = value << np.uint64(8) | data[j : j + size]
    buckets = np.zeros(len(data), np.int64)
    buckets[:size] = np.unique(value, return_inverse=True)[1]
    inside = np.zeros(len(data) + 1, np.int64)  # places that a string covers
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + length, -1)
    inside = np.cumsum(inside[:-1]) > 0
    reach = gram
    while reach < length:
        step = min(reach, length - reach)
        # at the last refinement only whole strings count, before it every place with room for the next
        some = starts if reach + step == length else np.flatnonzero(inside[: max(size - step, 0)])
        buckets = refined(buckets, some, step)
        reach += step
    return buckets[starts]


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each of the strings at `starts`, by the steps of `equal_strings`."""
    gram = min(8, length)
    value = np.zeros(max(len(data) - gram + 1, 0), np.uint64)
    for j in range(gram):
        value = value << np.uint64(8) | data[j : j + len(value)]
    one, two = _mixed(value), _mixed(value * _D + _C)
    reach = gram
    while reach < length:
        step = min(reach, length - reach)
        one, two = _mixed(one[:-step] * _D + one[step:]), _mixed(two[:-step] * _C + two[step:])
        reach += step
    return one[starts].view(np.int64), two[starts].view(np.int64)


def _asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents with the places, begins and ends of the contexts that were asked for."""
    wanted = asked.groupBy("doc_id", "mark").agg(
        F.flatten(F.collect_list("places")).alias("places"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
    )
    return docs.join(wanted, ["doc_id", "mark"])


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks by part: documents, begins and bytes of the contexts that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = flat(part.column("text"))
                many = np.asarray(part.column("starts").value_lengths(), np.int64)
                row = np.repeat(np.arange(part.num_rows), many)
                place, start, end = (part.column(c).flatten().to_numpy() for c in ("places", "starts", "ends"))
                order = np.argsort(place, kind="stable")
                heads = np.flatnonzero(_first_of_runs(place[order])) if len(order) else []
                for one in np.split(order, heads[1:]) if len(order) else []:
                    base = ends[row[one]]
                    text = b"".join([data[b + s : b + e].tobytes() for b, s, e in zip(base, start[one], end[one])])
                    lists = [pa.array([x.tolist()], t) for x, t in (
                        (part.column("doc_id").to_numpy()[row[one]], pa.list_(pa.int64())),
                        (part.column("mark").to_numpy()[row[one]], pa.list_(pa.int64())),
                        (start[one], pa.list_(pa.int32())),
                        (end[one], pa.list_(pa.int32())),
                    )]
                    yield pa.RecordBatch.from_arrays([pa.array([int(place[one[0]])], pa.int32()), *lists, pa.array([text], pa.binary())], names)

    names = ["range", "ids", "marks", "starts", "ends", "data"]
    return _asked(docs, asked).mapInArrow(run, "range int, ids array<long>, marks array<long>, starts array<int>, ends array<int>, data binary")


def _settle(contexts: DataFrame, length: int) -> DataFrame:
    """Per part: the strings of the fetched contexts that a smaller doc_id has too."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: np.concatenate([np.asarray(x, np.int64) for x in table.column(c).to_pylist()])
        ids, marks, start, end = (column(c) for c in ("ids", "marks", "starts", "ends"))
        data = np.frombuffer(b"".join(table.column("data").to_pylist()) + bytes(length), np.uint8)
        size = end - start
        base = np.cumsum(size) - size
        many = size - length + 1
        owner = np.repeat(np.arange(len(size)), many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        bucket = equal_strings(data, base[owner] + inside, length)
        order = np.lexsort((ids[owner], bucket))
        head = np.flatnonzero(_first_of_runs(bucket[order]))
        doc = ids[owner[order]]
        gone = order[doc > np.repeat(doc[head], np.diff(np.concatenate((head, [len(order)]))))]
        gone.sort()  # by context and place, so that neighbours join
        where = start[owner[gone]] + inside[gone]
        first = np.ones(len(gone), bool)
        first[1:] = (owner[gone[1:]] != owner[gone[:-1]]) | (where[1:] != where[:-1] + 1)
        heads = np.flatnonzero(first)
        lasts = np.concatenate((heads[1:], [len(gone)]))[: len(heads)] - 1
        chosen = owner[gone[heads]]
        return pa.table(
            [pa.array(ids[chosen]), pa.array(marks[chosen]), list_array(pa.array(where[heads].astype(np.int32)), np.ones(len(heads), int)), list_array(pa.array((where[lasts] + length).astype(np.int32)), np.ones(len(heads), int))],
            ["doc_id", "mark", "starts", "ends"],
        )

    return contexts.groupBy("range").applyInArrow(run, COVERED)


def _settle_strings(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The strings of the contexts asked for that a smaller doc_id has too, without gathering a window's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = flat(part.column("text"))
                many = np.asarray(part.column("starts").value_lengths(), np.int64)
                row = np.repeat(np.arange(part.num_rows), many)
                start, end = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("starts", "ends"))
                size = end - start
                strings = size - length + 1
                owner, where = np.repeat(row, strings), spread(start, strings)
                cells = data[spread(ends[row] + start, size)]
                one, two = string_hashes(cells, spread(np.cumsum(size) - size, strings), length)
                ids, marks = (part.column(c).to_numpy()[owner] for c in ("doc_id", "mark"))
                order = np.lexsort((ids, two, one))
                head = np.flatnonzero(_first_of_runs(one[order], two[order]))
                least = np.empty(len(order), np.int64)
                least[order] = np.repeat(ids[order][head], np.diff(np.concatenate((head, [len(order)]))))
                gone = ids > least
                # what is settled goes on as runs of neighbouring strings, only the rest as strings
                heads = _first_of_runs(np.repeat(np.arange(len(strings)), strings), gone) & gone
                rows = np.flatnonzero(~gone | heads)
                last = rows.copy()
                last[gone[rows]] = np.flatnonzero(gone & np.concatenate((heads[1:] | ~gone[1:], [True]))[: len(gone)])
                arrays = [pa.array(x[rows]) for x in (one, two, ids, marks, where.astype(np.int32))]
                arrays += [pa.array((where[last] + length).astype(np.int32)), pa.array(gone[rows])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["one", "two", "doc_id", "mark", "start", "end", "gone"]
    found = keep(_asked(docs, asked).mapInArrow(run, "one long, two long, doc_id long, mark long, start int, end int, gone boolean"))
    first = found.filter("not gone")
    least = first.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = first.join(least, ["one", "two"]).filter("doc_id > least")
    gone = found.filter("gone").select("doc_id", "mark", "start", "end").union(later.select("doc_id", "mark", "start", "end"))
    return gone.select("doc_id", "mark", F.array("start").alias("starts"), F.array("end").alias("ends"))


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, mark, starts, ends): intervals of bytes to remove, which may overlap."""
    usable = _keyed(docs).filter("doc_id is not null")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _send(usable, ranges, length, gram)
    met = keep(_meet(sent, length, gram))
    settled = keep(_settle(_contexts(usable, met.filter("kind = 1")), length))
    out = met.filter("kind = 0").select(settled.columns).union(settled)
    hot = met.filter("kind = 2")
    return out.union(keep(_settle_strings(usable, hot, length))) if hot.limit(1).count() else out


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs (doc_id, text): the removed intervals (bytes, disjoint, in order) and the bytes kept."""
    intervals = covered(docs, length, gram).groupBy("doc_id", "mark").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    joined = _keyed(docs).join(intervals, ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = flat(part.column("text"))
                starts, stops = part.column("starts").to_pylist(), part.column("ends").to_pylist()
                rows = []
                for i in range(part.num_rows):
                    mine = data[ends[i] : ends[i + 1]]
                    change = np.zeros(len(mine) + 1, np.int32)
                    if starts[i]:
                        np.add.at(change, starts[i], 1)
                        np.add.at(change, stops[i], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    rows.append((edges[::2].tolist(), edges[1::2].tolist(), mine[~gone].tobytes(), len(mine)))
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(c, pa.binary()), pa.array(d, pa.int64())],
                    ["doc_id", "starts", "ends", "kept", "n_bytes"],
                )

    return joined.mapInArrow(run, "doc_id long, starts array<int>, ends array<int>, kept binary, n_bytes long")


def report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what is kept."""
    return removed(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
