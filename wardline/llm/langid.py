"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over them, every filter keeps its largest response in a
window (max pooling), and a softmax over these gives the languages. The network is trained in numpy on the
driver, on a bounded sample of labelled texts. Texts are cut into windows of fixed length, all of them, and
the probabilities of a text are the means over its windows, weighted by bytes.

For prediction the embedding and the filters are folded into tables from byte pairs to filter responses.

Sample: of the labelled rows, those with the smallest hash of doc_id in each of `per_language` hash classes
of a language, fewer where many languages share the `total`; `windows` windows of each text, spread over all
of it. It is independent of row order and of partitions.

Defined results: a text that is null, empty or without a letter is `und` with score 0; without a labelled
row every text is `und` with score 0; equal texts get equal results; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import CACHE_BYTES, flat, slices

WINDOW = 160
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PAD = 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 257 x EMBED
    filters: list[np.ndarray]  # per width: (width * EMBED) x FILTERS
    bias: np.ndarray  # filters of all widths
    out: np.ndarray
    out_bias: np.ndarray


def folded_case() -> np.ndarray:
    """ASCII capitals count as small letters."""
    table = np.arange(PAD + 1)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def train(
    windows: list[bytes], labels: list[str], epochs: int = 10, batch: int = 128, rate: float = 4e-3, seed: int = 7, steps: int = 600
) -> Network:
    """Fit by Adam on cross-entropy, at least `steps` steps. Windows are at most WINDOW bytes."""
    batch = min(batch, max(8, len(windows) // 4))
    epochs = max(epochs, -(-steps * batch // max(len(windows), 1)))
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = np.full((len(windows), WINDOW), PAD)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)[:WINDOW]
    x = folded_case()[x]
    p = {"embed": rng.normal(0, 0.5, (PAD + 1, EMBED))}
    for k in WIDTHS:
        p[f"filter{k}"] = rng.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS))
    p["bias"] = np.zeros(FILTERS * len(WIDTHS))
    p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))
    p["out_bias"] = np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            rows = order[start : start + batch]
            b, n, line = x[rows], len(rows), np.arange(len(rows))[:, None]
            e = p["embed"][b]
            pooled, where, seen = [], [], []
            for k in WIDTHS:
                at = WINDOW - k + 1
                columns = np.concatenate([e[:, j : j + at] for j in range(k)], 2)
                response = (columns.reshape(n * at, -1) @ p[f"filter{k}"]).reshape(n, at, FILTERS)
                best = response.argmax(1)
                pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
                where.append(best)
                seen.append(columns)
            hidden = np.concatenate(pooled, 1) + p["bias"]
            active = np.maximum(hidden, 0)
            keep = (rng.random(active.shape) > 0.2) / np.float32(0.8)
            scores = (active * keep) @ p["out"] + p["out_bias"]
            scores = np.exp(scores - scores.max(1, keepdims=True))
            scores /= scores.sum(1, keepdims=True)
            scores[np.arange(n), y[rows]] -= 1
            d = (scores / n).astype(np.float32)
            g = {"out": (active * keep).T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            dh = (d @ p["out"].T) * keep * (hidden > 0)
            g["bias"] = dh.sum(0)
            for i, k in enumerate(WIDTHS):
                part = dh[:, i * FILTERS : (i + 1) * FILTERS].astype(np.float32)
                chosen = seen[i][line, where[i]]  # n x FILTERS x (k * EMBED)
                g[f"filter{k}"] = np.einsum("nf,nfc->cf", part, chosen)
                back = part[:, :, None] * p[f"filter{k}"].T[None]
                for j in range(k):
                    np.add.at(g["embed"], b[line, where[i] + j], back[:, :, j * EMBED : (j + 1) * EMBED])
            step += 1
            now = rate * (1 - epoch / epochs)
            for key, value in g.items():
                first[key] = 0.9 * first[key] + 0.1 * value
                second[key] = 0.999 * second[key] + 0.001 * value**2
                p[key] -= (now * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(names, p["embed"], [p[f"filter{k}"] for k in WIDTHS], p["bias"], p["out"], p["out_bias"])


class Predictor:
    """The network with embedding and filters folded into tables over bytes and byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        embed = net.embed[folded_case()[:PAD]]
        one = lambda k, j: embed @ net.filters[WIDTHS.index(k)][j * EMBED : (j + 1) * EMBED]
        pair = lambda k, j: (one(k, j)[:, None] + one(k, j + 1)[None]).reshape(PAD * PAD, FILTERS)
        self.tables = {k: [(j, pair(k, j)) if j + 1 < k else (j, one(k, j)) for j in range(0, k, 2)] for k in WIDTHS}

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of windows, all of the same length (rows x bytes)."""
        rows, size = data.shape
        pooled = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32)
        pairs = data[:, :-1].astype(np.uint16) << 8 | data[:, 1:] if size > 1 else None
        for i, k in enumerate(WIDTHS):
            at = size - k + 1
            if at < 1:
                continue
            total = None
            for j, part in self.tables[k]:
                ids = pairs[:, j : j + at] if j + 1 < k else data[:, j : j + at]
                got = part.take(ids, 0)
                total = got if total is None else np.add(total, got, out=total)
            pooled[:, i * FILTERS : (i + 1) * FILTERS] = total.max(1) + self.net.bias[i * FILTERS : (i + 1) * FILTERS]
        scores = np.maximum(pooled, 0) @ self.net.out + self.net.out_bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def texts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text of a flat byte array."""
        sizes = np.diff(ends)
        full, rest = sizes // WINDOW, sizes % WINDOW
        total = np.zeros((len(sizes), len(self.net.languages)))
        owner = np.repeat(np.arange(len(sizes)), full)
        begin = np.repeat(ends[:-1] - WINDOW * (np.cumsum(full) - full), full) + WINDOW * np.arange(len(owner))
        for s in range(0, len(owner), 64):
            cells = data[begin[s : s + 64, None] + np.arange(WINDOW)]
            np.add.at(total, owner[s : s + 64], WINDOW * self.windows(cells))
        for size in np.unique(rest[rest > 0]):  # the last window of a text, by length
            who = np.flatnonzero(rest == size)
            for s in range(0, len(who), 64):
                part = who[s : s + 64]
                cells = data[(ends[part + 1] - size)[:, None] + np.arange(size)]
                total[part] += size * self.windows(cells)
        return total / np.maximum(sizes, 1)[:, None]


def sample(
    docs: DataFrame, usable: Column, per_language: int = 512, total: int = 1 << 15, windows: int = 4
) -> tuple[list[bytes], list[str]]:
    """Windows and languages of a bounded sample of labelled rows, every language among them.

    A language gets `per_language` rows, or an equal share of `total` where there are too many languages for that, and
    one at least. What the driver collects is at most `per_language` ids of each language.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    mixed = F.xxhash64("doc_id")
    chosen = (
        rows.groupBy("lang", F.pmod(mixed, F.lit(per_language)).alias("class"))
        .agg(F.min(F.struct(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))["doc_id"].alias("doc_id"))
        .collect()
    )
    ids: dict[str, list[tuple[int, int]]] = {}
    for r in chosen:
        if r["doc_id"] is not None:
            ids.setdefault(r["lang"], []).append((r["class"], r["doc_id"]))
    share = min(per_language, max(1, total // max(len(ids), 1)))
    keys = sorted((name, doc_id) for name, mine in ids.items() for _, doc_id in sorted(mine)[:share])
    if not keys:
        return [], []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "lang string, doc_id long"))  # total, or one a language
    data = F.encode("text", "UTF-8")
    spare = F.greatest(F.length(data) - WINDOW, F.lit(0))
    cuts = [F.substring(data, (1 + F.floor(spare * i / max(windows - 1, 1))).cast("int"), F.lit(WINDOW)) for i in range(windows)]
    found = rows.join(wanted, ["lang", "doc_id"]).select("lang", "doc_id", F.array_distinct(F.array(*cuts)).alias("cuts"))
    pairs = sorted({(r["lang"], bytes(c)) for r in found.collect() for c in r["cuts"]})
    return [c for _, c in pairs], [name for name, _ in pairs]


def predict(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(Predictor(net) if net else None)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    source = df.select(*(f"`{c}`" for c in kept))
    schema = source.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = shared.value
        for batch in batches:
            for part in slices(batch, text, CACHE_BYTES):
                if predictor is None:
                    names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    chances = predictor.texts(*flat(part.column(text)))
                    names = [predictor.net.languages[i] for i in chances.argmax(1)]
                    scores = np.clip(chances.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    out = source.mapInArrow(run, schema)
    return out.withColumn("score", F.when(lettered, F.col("score")).otherwise(0.0)).withColumn(
        "lang_pred", F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN)
    )


def remainder(key: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: held_out, predicted language, score; learned from documents that are not held out."""
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    windows, labels = sample(docs, ~held_out)
    net = train(windows, labels) if labels else None
    found = predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("score").cast("double").alias("score"))
