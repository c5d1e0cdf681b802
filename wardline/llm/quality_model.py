"""Quality classifier from supervised subword embeddings.

Words, pairs of neighbouring words and character 3- and 4-grams inside words (with the white space before or
after) are hashed into BUCKETS vectors. A document is the mean of the vectors of all its features; a softmax
over two classes follows. Vectors and softmax are learned together by stochastic gradient descent in numpy on
the driver, on a bounded sample of labelled texts. A pair of equal words is one feature of its own.

For scoring, vector and softmax fold into one number per bucket: the score of a text is the logistic of the
mean of its buckets' numbers, corrected from the balanced sample to the shares of the labels in all rows.

Sample: of the labelled rows, those with the smallest hash of doc_id in each of `per_label` hash classes of a
label; of a text of over SAMPLE_BYTES bytes, evenly spaced parts of that total size (training only).

Defined results: a null or empty text has no feature and scores as the share of label 1; without labelled
rows the score is 0.5; labels other than 0 and 1 are not used; of repeated labels of one document all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import CACHE_BYTES, flat, slices

BUCKETS = 1 << 18
SIZE = 12
SAMPLE_BYTES = 4096
GRAMS = (3, 4)
#: Share of label 1 from which a text is predicted as 1.
THRESHOLD = 0.3

_SHIFT = np.uint64(64 - 18)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, 0xC2B2AE3D27D4EB4F, np.uint64))


@dataclass
class Model:
    weight: np.ndarray  # one number per bucket
    bias: float  # with the shares of the labels in it


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a flat byte array, and the text that each belongs to."""
    n = len(data)
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    space = _SPACE[data]
    buckets, owners = [], []
    for size in GRAMS:
        if n < size:
            continue
        at = n - size + 1
        value = data[:at].astype(np.uint64)
        for j in range(1, size):
            value |= data[j : j + at].astype(np.uint64) << np.uint64(8 * j)
        good = owner[:at] == owner[size - 1 :]
        for j in range(1, size - 1):
            good &= ~space[j : j + at]
        value = value[good]
        value += np.uint64(size << 40)
        buckets.append((value * _MIX) >> _SHIFT)
        owners.append(owner[:at][good])
    if n:
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        begin = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:n]))
        if len(begin):
            # place in the word: bytes since the last beginning
            last = np.zeros(n, np.int64)
            last[begin] = begin
            place = np.arange(n) - np.maximum.accumulate(last)
            letters = _CODES[data] * _POWERS[place & 63]
            letters[space] = 0
            words = np.add.reduceat(letters, begin)
            words ^= words >> np.uint64(29)
            words *= _MIX
            buckets.append(words >> _SHIFT)
            owners.append(owner[begin])
            same = owner[begin[:-1]] == owner[begin[1:]]
            left, right = words[:-1][same], words[1:][same]
            pairs = np.where(left == right, np.uint64(1), left * np.uint64(0xD6E8FEB86659FD93) + right)
            buckets.append((pairs * _MIX) >> _SHIFT)
            owners.append(owner[begin[:-1]][same])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners)


def train(texts: list[bytes], labels: list[int], share: float, epochs: int = 6, rate: float = 0.6, seed: int = 5) -> Model:
    """Fit vectors and softmax; `share` is the share of label 1 in all labelled rows."""
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    buckets, owner = features(data, ends)
    joint, counts = np.unique(owner.astype(np.int64) * BUCKETS + buckets, return_counts=True)
    owner, buckets = joint // BUCKETS, joint % BUCKETS
    total = np.bincount(owner, counts, len(texts))
    share_of = (counts / total[owner]).astype(np.float32)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    y = np.array(labels)
    weight_of = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(texts)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            now = rate * (1 - done / steps)
            done += 1
            ids, part = buckets[starts[i] : starts[i + 1]], share_of[starts[i] : starts[i + 1]]
            hidden = part @ vectors[ids]
            score = hidden @ out + bias
            chance = np.exp(score - score.max())
            chance /= chance.sum()
            chance[y[i]] -= 1
            chance *= weight_of[i]
            back = out @ chance
            out -= now * np.outer(hidden, chance)
            bias -= now * chance
            vectors[ids] -= now * part[:, None] * back * len(ids) ** 0.5
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + odds))


def scores(model: Model, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    buckets, owner = features(data, ends)
    n = len(ends) - 1
    total = np.bincount(owner, model.weight[buckets], n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(np.bincount(owner, minlength=n), 1) + model.bias, -30, 30)))


def remainder(key: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 1024) -> tuple[list[bytes], list[int], float]:
    """Texts and labels of a bounded sample, and the share of label 1 in all usable labelled rows."""
    marked = labels.select("doc_id", "quality").filter(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = (
        marked.groupBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(per_label)).alias("class"))
        .agg(F.min(F.struct(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))["doc_id"].alias("doc_id"), F.count("*").alias("n"))
        .collect()
    )
    if not chosen:
        return [], [], 0.5
    share = sum(r["n"] for r in chosen if r["quality"] == 1) / sum(r["n"] for r in chosen)
    keys = sorted({(r["doc_id"], r["quality"]) for r in chosen})
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "doc_id long, quality int"))  # at most 2 x per_label
    data, parts = F.encode("text", "UTF-8"), 4
    spare = F.greatest(F.length(data) - SAMPLE_BYTES, F.lit(0))
    cuts = [
        F.substring(data, (1 + F.floor((spare + SAMPLE_BYTES - SAMPLE_BYTES // parts) * i / (parts - 1))).cast("int"), F.lit(SAMPLE_BYTES // parts))
        for i in range(parts)
    ]
    text = F.when(spare == 0, data).otherwise(F.concat(*cuts))
    found = docs.select("doc_id", "text").filter(F.length("text") > 0).join(wanted, "doc_id").select("quality", text.alias("data"))
    pairs = sorted((bytes(r["data"]), r["quality"]) for r in found.collect())
    return [d for d, _ in pairs], [q for _, q in pairs], share


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score, the chance of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "score"]
    source = df.select(*(f"`{c}`" for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, CACHE_BYTES):
                found = np.full(part.num_rows, 0.5) if shared.value is None else scores(shared.value, *flat(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, "score"])

    return source.mapInArrow(run, source.withColumn("score", F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted; learned from labels of documents that are not held out."""
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    texts, marks, share = sample(docs, labels, ~held_out)
    model = train(texts, marks, share) if marks else None
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
