"""Best-fit packing of token sequences by minimum bin slack.

Bins are filled one by one: a bin takes the largest piece left, and a subset-sum dynamic program over the lengths
that are left finds the combination that fills the rest of it most; that combination is removed. Reachable sums
are the bits of an integer. The program looks only at how many pieces of each length there are, so what the driver
gets is one count for each length up to the capacity, however many pieces there are, and since the same counts
give the same combination, a combination is repeated until one of its lengths is used up.

1. Pieces are written once, each with the number of the task that wrote it and its place among the pieces of its
   length in that task.
2. Counts by (task, length) give the histogram, and running sums over the tasks of a length the first number of
   each task's pieces, so that pieces of a length are numbered without sorting or gathering them. A length that
   a third of all pieces share has one row a task here.
3. A piece's length and number give its sequence and offset by two binary searches in the plan, a table of at most
   a few rows for each length and combination that is broadcast (bounded by the capacity).

Defined results: a document's ids are those of its text and the end id; a null or empty text has the end id alone.
Only documents over the capacity are cut. Repeated rows are packed as often as they occur, rows of equal key keep
their own numbers only as far as their keys tell them apart. Keys may be null. An empty table gives no rows, a
length under 1 or over the capacity is an error. Columns that are not named are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import keep, list_array, slices, spread

CAPACITY = 4096
#: Chunks of texts whose ids a task remembers.
REMEMBER = 400_000

#: Between an ASCII letter and ASCII punctuation but the apostrophe.
_CUT = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")

#: One word to the tokenizer, whatever it does to its letters.
_ONE = re.compile("[a-zÀ-ÖØ-öø-ÿŒœ]+")
#: Words that are encoded as one line.
LINE = 500


def combination(counts: np.ndarray, room: int) -> tuple[int, list[tuple[int, int]]]:
    """The fullest sum up to room of lengths taken at most so often as counted, and how often each is taken.

    Long lengths are tried first, and no further ones once the room can be filled.
    """
    full, sums, steps = 1 << room, 1, []
    mask = (full << 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if sums & full:
            break
        left, size = min(int(counts[length]), room // length), 1
        while left:  # 1, 2, 4, ... of this length at once reach every number of them
            take = min(size, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, size = left - take, 2 * size
    total = rest = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            rest -= length * take
            taken[length] = taken.get(length, 0) + take
    return total, sorted(taken.items(), reverse=True)


def planned(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each combination is packed, and its lengths with how often a bin holds each; counts: by length."""
    counts, plan = counts.copy(), []
    while len(left := np.flatnonzero(counts)):
        largest = int(left[-1])
        counts[largest] -= 1
        _, rest = combination(counts, capacity - largest)
        counts[largest] += 1
        bin_ = dict(rest)
        bin_[largest] = bin_.get(largest, 0) + 1
        times = min(int(counts[length]) // many for length, many in bin_.items())
        for length, many in bin_.items():
            counts[length] -= many * times
        plan.append((times, sorted(bin_.items(), reverse=True)))
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, sequences before, pieces a bin, offset) by length and number."""
    rows, before, used = [], 0, {}
    for times, parts in plan:
        offset = 0
        for length, many in parts:
            number = used.get(length, 0)
            rows.append((length, number, before, many, offset))
            used[length] = number + many * times
            offset += length * many
        before += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _numbered(pieces: DataFrame, length: str, capacity: int) -> DataFrame:
    """Every piece with its task and its place among the task's pieces of that length."""
    names = pieces.columns
    schema = pieces.select("*", F.lit(0).alias("_task"), F.lit(0).cast("long").alias("_place")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(length).to_numpy(zero_copy_only=False)
            if batch.column(length).null_count or (len(sizes) and not 1 <= sizes.min() <= sizes.max() <= capacity):
                raise ValueError(f"lengths have to be from 1 to {capacity}")
            order = np.argsort(sizes, kind="stable")
            many = np.bincount(sizes, minlength=capacity + 1)
            place = np.empty(len(sizes), np.int64)
            place[order] = spread(seen, many)
            seen += many
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(place)], [*names, "_task", "_place"]
            )

    return pieces.mapInArrow(run, schema)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to every piece, so that few sequences of at most `capacity` hold them all.

    Columns of these names, or `_task`, `_place` and `_first`, may not be among those of the pieces.
    """
    names = pieces.columns
    numbered = keep(_numbered(pieces, length, capacity))
    counts = keep(numbered.groupBy("_task", F.col(length).alias("_length")).agg(F.count("*").alias("_n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["_length"]] = row["n"]
    table = pieces.sparkSession.sparkContext.broadcast(places(planned(histogram, capacity)).tobytes())
    earlier = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_task", "_length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    # no broadcast: a written count is small on disk, but there is one for each task and length
    joined = numbered.withColumn("_length", F.col(length)).join(first.hint("merge"), ["_task", "_length"])
    source = joined.select(*(f"`{c}`" for c in names), (F.col("_first") + F.col("_place")).alias("_number"))
    schema = pieces.select("*", *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = np.frombuffer(table.value, np.int64).reshape(-1, 5)
        heads = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        wide = np.int64(int(plan[:, 1].max(initial=0)) + 1)
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            sizes = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, sizes * wide + np.minimum(number, wide - 1), "right") - 1
            at = np.clip(at, heads[sizes], heads[sizes + 1] - 1)
            _, since, before, many, offset = plan[at].T
            sequence, turn = np.divmod(number - since, many)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(before + sequence), pa.array(offset + turn * sizes)], [*names, "sequence_id", "offset"]
            )

    return source.mapInArrow(run, schema)


class Chunks:
    """Texts to ids by their chunks between ASCII white space, which this kind of tokenizer drops and never joins.

    Chunks are also cut after an ASCII letter that punctuation follows, and put in lower case, as the tokenizer
    itself does; texts that might hold the name of a special token are left as they are. Chunks of Latin letters
    alone are encoded many at once.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        suffix = json.loads(tokenizer)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one each to the tokenizer: many at once, told apart by the tokens that end a word."""
        lines = [" ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made), np.uint32)
        lengths = np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)
        if len(lengths) != len(words):
            raise ValueError("a word of letters is not one word to this tokenizer")
        return ids, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.index) > REMEMBER:
            self._forget()
        plain = [t.encode() for t in texts]
        rows = [(t if b"<|" in t else _CUT.sub(b" ", t.lower())).split() for t in plain]
        new = set().union(*rows).difference(self.index)
        if new:
            words = {w: w.decode() for w in new}
            plain = [w for w, t in words.items() if _ONE.fullmatch(t)] if self.closing.any() else []
            rest = list(new.difference(plain))
            ids, lengths = self._words([words[w] for w in plain])
            made = [e.ids for e in self.tokenizer.encode_batch_fast([words[w] for w in rest], add_special_tokens=False)]
            ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(made), np.uint32)])
            lengths = np.concatenate([lengths, np.fromiter(map(len, made), np.int64, len(made))])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.ids, self.lengths = ids, np.concatenate([self.lengths, lengths])
            self.index.update(zip(chain(plain, rest), range(len(self.index), len(self.lengths))))
        many = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(many.sum()))
        lengths = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(many)))]
        return self.ids[spread(self.starts[at], lengths)], np.diff(ends)


def token_pieces(
    docs: DataFrame,
    keys: Sequence[str],
    tokenizer_file: str,
    text: str = "text",
    end: int = 1,
    capacity: int = CAPACITY,
    ids: bool = True,
) -> DataFrame:
    """Per piece the keys, piece, start, length, ids_crc32 (of the ids as little-endian 32 bits) and, if asked, ids.

    The tokenizer's file is read on the driver and broadcast (fixed size); it has to drop white space as `Chunks` says.
    No key may be named like one of the outputs.
    """
    keys = list(keys)
    with open(tokenizer_file, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").alias("_text"))
    extra = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "array<int>"} if ids else {})
    schema = source.select(*(F.col(f"`{k}`") for k in keys), *(F.lit(None).cast(t).alias(c) for c, t in extra.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = chunks.encode(part.column("_text").fill_null("").to_pylist())
                flat = np.insert(flat, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                many = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), many)
                piece = spread(np.zeros(len(many), np.int64), many)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                begin = np.concatenate(([0], np.cumsum(length)))
                sums = [crc32(flat[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                columns = [part.column(k).take(pa.array(row)) for k in keys]
                columns += [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(list_array(pa.array(flat.astype(np.int32)), length))
                yield pa.RecordBatch.from_arrays(columns, [*keys, *extra])

    return source.mapInArrow(run, schema)


def report(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per piece of every document: its place in the packed sequences."""
    pieces = token_pieces(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], tokenizer_file, ids=False)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
