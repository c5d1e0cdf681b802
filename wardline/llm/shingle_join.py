"""N-gram Jaccard join: a size-aware heavy-light set join over word shingles, and its components.

A document's set holds its distinct shingles of `words` words as 62-bit hashes; a shorter text is one
shingle; without words the set is empty and linked with nothing. Two documents link when
100 * intersection >= percent * union. The result has one row per document: size of its set and the
smallest doc_id that links reach.

1. Equal sets are one class, its representative the smallest doc_id. Only representatives are joined.
2. Shingles are ordered by (frequent, hash). The frequent ones are those with the highest counts over all
   documents; that choice changes only the work, as any common order is right. Representatives that link
   share an element among the first n - ceil(n * percent / 100) + 1 of this order, and two among one more.
3. Light sets (size up to a boundary) enumerate the pairs of those elements, heavy ones the elements, which
   are inverted lists; sets close below the boundary do both, as links join neighbouring sizes only. The
   boundary minimises the estimated cost over the histogram of sizes, given the mean length of the lists.
4. In each list all members are compared with the smallest one, the pivot: a number of pairs that is linear
   in the lists. Links between members of different components that remain possible are compared next.
   Jaccard distance is a metric, so the distances to the pivot rule out most of these.
5. A pair is first bounded by its leading elements, then decided on the whole sets, which are hashed again
   from the texts of the documents concerned.

No list is cut and no pair is dropped except by a bound. Components are found by contraction.

Defined results: null text counts as empty; rows with equal doc_id count as one document with several
texts, each with a row; a row with null doc_id has the component of its set's class, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import CACHE_BYTES, flat, keep, list_array, slices

PERCENT = 85
WORDS = 4
#: Frequent shingles that are told to every task: at most this many (8 bytes each).
FREQUENT = 200_000
#: Shingles that a task counts together.
COUNTED = 3_000_000
#: Count over all documents from which a shingle may be among them.
FREQUENT_FROM = 16
#: Rows up to which a list of document ids is broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Sizes up to which a set can be light.
LIGHT_LIMIT = 256

_FLAG = np.int64(1 << 61)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_CODES[_SPACE] = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a flat byte array, and how many words each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[ends] = True
    first[1:n] |= space[:-1]
    begin = np.flatnonzero(~space & first[:n])
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    last = np.zeros(n, np.int64)
    last[begin] = begin
    place = np.arange(n) - np.maximum.accumulate(last)
    place[space] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _B))
    words = _mixed(np.add.reduceat(_CODES[data] * powers[place], begin))
    return words, np.diff(np.searchsorted(begin, ends))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct 61-bit hashes."""
    long = np.zeros(0, np.uint64)
    if len(words) >= size:
        long = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            long = long * _B + words[k : len(words) - size + 1 + k]
        long = _mixed(long)
    out, at = [], 0
    for n in counts:
        if n >= size:
            part = long[at : at + n - size + 1]
        elif n:
            value = np.uint64(n)
            for w in words[at : at + n]:
                value = value * _C + w
            part = _mixed(np.array([value]))
        else:
            part = long[:0]
        out.append(np.unique(part >> np.uint64(3)).astype(np.int64))
        at += n
    return out


class Frequent:
    """The frequent shingles, with a table over their leading bits that settles most others."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << 21, bool)
        self.table[values >> 40] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        hit = self.table[hashes >> 40]
        maybe = np.flatnonzero(hit)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
            hit[maybe] = self.values[at] == hashes[maybe]
        return hit

    def ordered(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The sets in the common order; frequent elements carry a high bit, so that the order is numeric."""
        if not sets or not len(self.values):
            return sets
        every = np.concatenate(sets)
        hit = self.among(every)
        if not hit.any():
            return sets
        ends = np.cumsum([len(s) for s in sets])
        hits = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], ends))]
        out, at = [], 0
        for one, many, end in zip(sets, np.diff(hits), ends):
            if many:
                mine = hit[at:end]
                one = np.concatenate([one[~mine], one[mine] | _FLAG])
            out.append(one)
            at = end
        return out


def least_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return (percent * n + 99) // 100


def _sets(part: pa.RecordBatch, text: str, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return shingles(*word_hashes(*flat(part.column(text))), size)


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums per set, by which sets are told apart."""
    out = np.zeros((len(sets), 2), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        raw = np.concatenate(sets).view(np.uint64)
        starts = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            out[full, 0] = np.add.reduceat(raw, starts).view(np.int64)
            out[full, 1] = np.add.reduceat(_mixed(raw ^ _B), starts).view(np.int64)
    return out


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The shingles of highest count over all documents; every task first counts COUNTED at a time."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
        more = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[more]), pa.array(counts[more].astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, held = set(), [], 0
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                new = _sets(part, "text", size)
                for one, key in zip(new, map(tuple, _keys(new).tolist())):
                    if len(one) and key not in seen:
                        seen.add(key)
                        sets.append(one)
                        held += len(one)
                if held >= COUNTED:
                    yield counted(sets)
                    seen, sets, held = set(), [], 0
        yield counted(sets)

    sums = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "h").limit(FREQUENT).select("h")
    return np.sort(np.array([r[0] for r in top.collect()], np.int64))


def leading(docs: DataFrame, frequent: object, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, size of the set, key of the set, its leading elements (one more than must share one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                sets = _sets(part, "text", size)
                sizes = np.array([len(s) for s in sets], np.int64)
                lead = np.minimum(sizes - least_overlap(sizes, percent) + 2, sizes)
                heads = [s[:k] for s, k in zip(frequent.value.ordered(sets), lead)]
                keys = _keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        list_array(pa.array(np.concatenate([*heads, np.zeros(0, np.int64)])), lead),
                    ],
                    ["doc_id", "n", "k1", "k2", "lead"],
                )

    schema = "doc_id long, n long, k1 long, k2 long, lead array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def boundary(reps: DataFrame, percent: int) -> int:
    """Largest light size, by the cost of signatures and of the list entries met."""
    one = reps.select(F.explode(F.slice("lead", 1, F.greatest(F.size("lead") - 1, F.lit(1)))).alias("h"))
    lists = one.agg(F.count("*"), F.approx_count_distinct("h")).first()
    mean = max(1.0, lists[0] / max(lists[1], 1))
    sizes = {r["size"]: r["many"] for r in reps.groupBy(F.least("n", F.lit(LIGHT_LIMIT + 1)).alias("size")).agg(F.count("*").alias("many")).collect()}

    def cost(limit: int) -> float:
        total = 0.0
        for n, many in sizes.items():
            lead = n - least_overlap(n, percent) + 1
            total += many * (lead + 1) * lead / 2 if n <= limit else 0
            total += many * lead * (1 + mean) if 100 * n > percent * limit else 0
        return total

    return min(range(LIGHT_LIMIT + 1), key=cost)


def signatures(reps: DataFrame, limit: int, percent: int) -> DataFrame:
    """Rows (sig, id, n, pos): pairs of leading elements for light sets, single ones for heavy sets.

    pos is the number of elements before the signature's, for a pair before its later one and less one.
    """
    pairs = F.transform(
        F.slice("lead", 1, F.size("lead") - 1),
        lambda x, i: F.transform(
            F.slice("lead", i + 2, F.size("lead")), lambda y, j: F.struct(F.xxhash64(x, y).alias("sig"), (i + j).alias("pos"))
        ),
    )
    light = reps.filter((F.col("n") <= limit) & (F.size("lead") > 1)).select(
        F.explode(F.flatten(pairs)).alias("s"), F.col("doc_id").alias("id"), "n"
    )
    heavy = reps.filter(100 * F.col("n") > percent * limit).select(
        F.posexplode(F.slice("lead", 1, F.greatest(F.size("lead") - 1, F.lit(1)))).alias("pos", "sig"),
        F.col("doc_id").alias("id"),
        "n",
    )
    return light.select("s.sig", "id", "n", "s.pos").union(heavy.select("sig", "id", "n", "pos"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the offsets of its rows."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the largest overlap that their leading elements allow."""
    side = lambda name: reps.select(F.col("doc_id").alias(name), F.col("n").alias(f"n{name}"), F.col("lead").alias(f"l{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            (va, oa), (vb, ob) = _values(batch.column("la")), _values(batch.column("lb"))
            most = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                end = min(x[-1], y[-1])
                i_x, i_y = np.searchsorted(x, end, "right"), np.searchsorted(y, end, "right")
                both = np.intersect1d(x[:i_x], y[:i_y], assume_unique=True).size
                most[i] = both + min(na[i] - i_x, nb[i] - i_y)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(na), pa.array(nb), pa.array(most)], ["a", "b", "na", "nb", "most"])

    return joined.filter(fit).mapInArrow(run, "a long, b long, na long, nb long, most long")


def decided(pairs: DataFrame, docs: DataFrame, reps: DataFrame, frequent: object, size: int, percent: int) -> DataFrame:
    """For pairs (a, b): linked or not, and an interval for their distance."""
    links = lambda common: 100 * F.col(common) >= percent * (F.col("na") + F.col("nb") - F.col(common))
    far = lambda common: 1 - F.col(common) / (F.col("na") + F.col("nb") - F.col(common))
    first = keep(bounded(pairs, reps, percent))
    open_pairs = first.filter(links("most"))
    ids = keep(open_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                sets = frequent.value.ordered(_sets(part, "text", size))
                lengths = np.array([len(s) for s in sets], np.int64)
                values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(values, lengths)], ["doc_id", "whole"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
    whole = keep(texts.mapInArrow(run, "doc_id long, whole array<long>"))
    side = lambda name: whole.select(F.col("doc_id").alias(name), F.col("whole").alias(f"w{name}"))
    joined = open_pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob) = _values(batch.column("wa")), _values(batch.column("wb"))
            rows = range(batch.num_rows)
            common = [np.intersect1d(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], assume_unique=True).size for i in rows]
            arrays = [batch.column("a"), batch.column("b"), pa.array(np.diff(oa)), pa.array(np.diff(ob)), pa.array(common, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "na", "nb", "common"])

    exact = joined.mapInArrow(compare, "a long, b long, na long, nb long, common long")
    settled = exact.select("a", "b", links("common").alias("linked"), far("common").alias("low"), far("common").alias("high"))
    ruled_out = first.filter(~links("most")).select("a", "b", F.lit(False).alias("linked"), far("most").alias("low"), F.lit(1.0).alias("high"))
    return keep(settled.union(ruled_out))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that edges (a, b) reach, for every id that has an edge.

    Every node points to its smallest neighbour if that is smaller; pointers are followed to their ends by
    doubling; edges between ends go into the next round until none is left.
    """
    edges = keep(edges.filter("a <> b").select("a", "b").distinct())
    labels = keep(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = keep(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        while True:
            ahead = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = keep(to.join(ahead, "to", "left").select("a", F.coalesce("next", "to").alias("next"), "to"))
            moved = jumped.filter(F.col("next") != F.col("to")).limit(1).count()
            to = jumped.select("a", F.col("next").alias("to"))
            if not moved:
                break
        here = to.select(F.col("a").alias("label"), F.col("to").alias("end"))
        labels = keep(labels.join(here, "label", "left").select("id", F.coalesce("end", "label").alias("label")))
        left, right = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = keep(
            edges.join(left, "a").join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        )
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(Frequent(frequent_shingles(docs, words)))
    sets = keep(leading(docs, frequent, words, percent))
    by_key = ["k1", "k2", "n"]
    classes = keep(sets.filter("n > 0").groupBy(*by_key).agg(F.min("doc_id").alias("rep")))
    # One row for a representative and set; rows that repeat a document and its text fall together.
    reps = sets.join(classes, [*by_key], "inner").filter("doc_id = rep and n > 0")
    reps = keep(reps.groupBy("doc_id", "k1", "k2", "n").agg(F.first("lead").alias("lead")).select("doc_id", "n", "lead"))
    limit = boundary(reps, percent)
    marks = signatures(reps, limit, percent)
    lists = marks.groupBy("sig").agg(F.min("id").alias("pivot"), F.count("*").alias("many")).filter("many > 1")
    shared = keep(marks.join(lists, "sig").select("sig", "id", "n", "pos", "pivot"))
    stars = shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = decided(stars, docs, reps, frequent, words, percent)
    links = first.filter("linked").select("a", "b")
    labels = components(links)

    split = _split_lists(shared, labels, first)
    second = decided(_open_pairs(split, percent), docs, reps, frequent, words, percent)
    found = second.filter("linked").select("a", "b")
    if found.limit(1).count():
        labels = components(links.union(found))

    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = keep(named.select(*by_key, F.coalesce("label", "rep").alias("component_id")))
    return sets.join(named, by_key, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _split_lists(shared: DataFrame, labels: DataFrame, stars: DataFrame) -> DataFrame:
    """Members of lists that hold several components, with the interval of their distance to the pivot."""
    named = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = keep(named)
    several = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("sig")
    known = stars.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "low", "high")
    rest = named.filter("id <> pivot").join(several, "sig", "left_semi").join(known, ["pivot", "id"], "left")
    # without a decided pair the sizes alone ruled the link out
    return keep(rest.withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(1.0))))


def _open_pairs(split: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that can still link two components.

    Sets of n and m elements that link share at least percent * (n + m) / (100 + percent). The list of their
    first shared signature stands in front of all but the places that may be unshared, in both of them; what
    they share before, at and after a place is no more than either side has there.
    """
    reach = 1 - percent / 100 + 1e-9
    columns = ("id", "n", "pos", "label", "low", "high")
    x = split.select("sig", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = split.select("sig", *(F.col(c).alias(f"{c}_y") for c in columns))
    near = (F.col("low_x") - F.col("high_y") <= reach) & (F.col("low_y") - F.col("high_x") <= reach)
    needed = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent) - 1e-9)
    early = (F.col("pos_x") <= F.col("n_x") - needed) & (F.col("pos_y") <= F.col("n_y") - needed)
    most = F.least("pos_x", "pos_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    pairs = x.join(y, "sig").filter(
        (F.col("id_x") < F.col("id_y")) & (F.col("label_x") != F.col("label_y")) & near & early & (most >= needed)
    )
    return pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
