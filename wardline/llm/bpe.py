"""Byte-level BPE encoding and decoding over padded numpy matrices.

A text is split by the tokenizer's pattern; each match is encoded on its own. The distinct matches of a
slice are sorted into matrices by their length in bytes, one row per match. In a round every row merges
its leftmost pair of lowest rank; the pair's rank comes from a hash table over pairs of token ids. Rows
without a pair that merges leave the matrix, the others close the gap, so the matrix gets narrower by one
each round. Matches of over LONG bytes are taken alone: there a round also merges the repeats of the same
pair to the right, as long as no pair made on the way has a lower rank, which gives the same tokens.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; rows are
independent, so repeated rows and repeated ids stay as they are; ids of an unknown token raise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import flat, list_array, slices, spread

#: Matches of more bytes than this are encoded one by one.
LONG = 256
#: Cells of a padded matrix that are held at once.
CELLS = 1 << 19
#: Bytes of text whose matches are held at once; a longer text is handled alone and whole.
TEXT_BYTES = 1 << 20
#: Distinct matches that a worker remembers between slices.
REMEMBER = 400_000

_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Tokens by rank, and the hash table from pairs of ids to the id of the joined token."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.array([bool(t) for t in tokens])
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            taken, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[left[winners]], values[left[winners]]
            rest = np.ones(len(left), bool)
            rest[winners] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or the highest number where the pair does not merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), _NONE, np.int32)
        todo, at = np.flatnonzero(keys >= 0), None
        at = self._slot(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode a matrix of byte ids, padded with -1 at the right: ids padded with -1, and how many."""
        rows, width = ids.shape
        done, counts = np.full((rows, width), -1, np.int32), np.zeros(rows, np.int64)
        where, ranks = np.arange(rows), self._pairs(ids)
        while len(where):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(where), np.int64)
            lowest = ranks[np.arange(len(where)), best] if ranks.shape[1] else np.full(len(where), _NONE)
            over = lowest == _NONE
            if over.any():
                done[where[over], : ids.shape[1]] = ids[over]
                counts[where[over]] = (ids[over] >= 0).sum(1)
                go = ~over
                where, ids, ranks, best, lowest = where[go], ids[go], ranks[go], best[go], lowest[go]
                if not len(where):
                    break
            line = np.arange(len(where))
            ids[line, best] = lowest
            at = np.arange(ids.shape[1] - 1)
            ids = np.where(at <= best[:, None], ids[:, :-1], ids[:, 1:])
            at = at[:-1]
            ranks = np.where(at < best[:, None], ranks[:, :-1], ranks[:, 1:])
            if ranks.shape[1]:
                left = np.flatnonzero(best > 0)
                ranks[left, best[left] - 1] = self._rank_at(ids, left, best[left] - 1)
                right = np.flatnonzero(best < ranks.shape[1])
                ranks[right, best[right]] = self._rank_at(ids, right, best[right])
        return done, counts

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.rank(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
        ranks[ids[:, 1:] < 0] = _NONE
        return ranks

    def _rank_at(self, ids: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        left, right = ids[row, column], ids[row, column + 1]
        out = self.rank(left, np.maximum(right, 0))
        out[right < 0] = _NONE
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Encode one long row of byte ids."""
        while len(ids) > 1:
            ranks = self.rank(ids[:-1], ids[1:])
            lowest = ranks.min()
            if lowest == _NONE:
                break
            at = np.flatnonzero(ranks == lowest)
            run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
            begins = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
            at = at[(np.arange(len(at)) - begins[run]) % 2 == 0]
            if len(at) > 1:
                joined = np.full(len(at), lowest, np.int32)
                before = np.where(np.concatenate(([False], np.diff(at) == 2)), lowest, ids[np.maximum(at - 1, 0)])
                after = ids[np.minimum(at + 2, len(ids) - 1)]
                made = [self.rank(before, joined)[at > 0], self.rank(joined, after)[at + 2 < len(ids)]]
                if min((m.min() for m in made if len(m)), default=_NONE) < lowest:
                    at = at[:1]
            ids = ids.copy()
            ids[at] = lowest
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has; a piece that is a token is that token."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int32, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(tokens >= 0), tokens[tokens >= 0])]
        todo = np.flatnonzero(tokens < 0)
        widths = np.where(sizes[todo] <= 16, sizes[todo], -(-sizes[todo] // 8) * 8)
        for i in todo[sizes[todo] > LONG]:
            ids = self.merge_long(self.single[np.frombuffer(pieces[i], np.uint8)])
            counts[i] = len(ids)
            made.append((np.array([i]), ids))
        for width in np.unique(widths[sizes[todo] <= LONG]):
            rows = todo[(widths == width) & (sizes[todo] <= LONG)]
            step = max(1, CELLS // int(width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                matrix = np.full((len(part), int(width)), -1, np.int32)
                inside = np.arange(width) < sizes[part][:, None]
                matrix[inside] = self.single[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                ids, counts[part] = self.merge_rows(matrix)
                made.append((part, ids[ids >= 0]))
        starts = np.cumsum(counts) - counts
        flat_ids = np.empty(int(counts.sum()), np.int32)
        for rows, ids in made:
            flat_ids[spread(starts[rows], counts[rows])] = ids
        return flat_ids, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a row of ids, and by the lengths of its tokens those of each part of it."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("ids that no token has")
        return self.bytes[spread(self.starts[ids], self.lengths[ids])]


class Encoder:
    """Texts to ids; remembers the ids of the matches that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.index) > REMEMBER:
            self._forget()
        found = [self.find(t) for t in texts]
        new = list(set().union(*found).difference(self.index))
        if new:
            ids, lengths = self.vocabulary.encode_pieces([p.encode() for p in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, ids])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        pieces = np.array([len(p) for p in found], np.int64)
        known = map(self.index.__getitem__, chain.from_iterable(found))
        at = np.fromiter(known, np.int64, int(pieces.sum()))
        lengths = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(pieces)))]
        return self.flat[spread(self.starts[at], lengths)], np.diff(ends)


def encode(df: DataFrame, text: str, rank_file: str, pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add a column with the ids of a text; with `decoded`, also the bytes that these ids decode to.

    The rank file is read on the driver; its tables go to the executors as one broadcast (fixed size).
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(rank_file))
    kept = [c for c in df.columns if c not in (ids, decoded)]
    schema = df.select(*(f"`{c}`" for c in kept)).withColumn(ids, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(decoded, F.lit(None).cast("binary")) if decoded else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                flat_ids, counts = encoder.encode(part.column(text).fill_null("").to_pylist())
                columns = [part.column(c) for c in kept] + [list_array(pa.array(flat_ids, pa.int32()), counts)]
                if decoded:
                    columns.append(_decoded(vocabulary, flat_ids, counts))
                yield pa.RecordBatch.from_arrays(columns, [*kept, ids, *([decoded] if decoded else [])])

    return df.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)


def _decoded(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    data = vocabulary.decode(ids)
    ends = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def decode(df: DataFrame, ids: str, rank_file: str, decoded: str = "decoded") -> DataFrame:
    """Add a column with the bytes that a list of ids decodes to; a null list decodes to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(rank_file))
    kept = [c for c in df.columns if c != decoded]
    source = df.select(*(f"`{c}`" for c in kept))
    schema = source.withColumn(decoded, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), _decoded(shared.value, values, counts)], [*kept, decoded]
            )

    return source.mapInArrow(run, schema)


def token_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to."""
    coded = encode(docs.select("doc_id", "text"), "text", rank_file, pattern, "ids", "decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
