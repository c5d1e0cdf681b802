"""Whitening of embeddings by shifted Cholesky QR: Gram passes, triangular solves, the SVD of R.

With A the centred vectors, one a row, a pass sums the Gram matrix of Q = A / R1 / ... / Rk over all rows: a task
solves the triangular systems for its rows and sends one matrix, the matrices of FAN tasks are added, then the sums
row by row. The driver gets d x d numbers, factors them (R(k+1), with a shift while the matrix may be singular to
rounding) and starts the next pass, until Q is orthonormal on the directions that A has. A = Q R with the product R
of all factors, so the right singular vectors of R are the components and its singular values give the variances;
what a single Gram matrix of A would lose of the small ones by squaring stays.

Entries become whole numbers, floor(scale * c) + offset. Their sums are exact; rows are centred as
(x - m) - r / n with S = n m + r, so that no digits cancel.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite, are dropped, as are rows
of another length than the most frequent one (the shorter of equally frequent ones). Entries beyond +-2^40 count as
that. Dimensions without variance are in no component; directions without variance (singular values under d * 1e-15
of the largest) are no components, so equal rows alone have none and give no rows. Repeated rows count as often as
they occur and stay; keys may be null; an empty table gives no rows; columns that are not named are not read. A sum
of squares that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Tasks whose matrices are added together first.
FAN = 32
#: Rows that are worked on at once.
BLOCK = 8_192
#: Times the dimensions: singular values up to this part of the largest are rounding.
MISSING = 1e-15
#: Passes at most; two or three do unless directions are all but missing.
PASSES = 12

_LARGEST = float(1 << 40)
_UNIT = float(np.finfo(float).eps) / 2


@dataclass(frozen=True)
class Model:
    """n rows of x; their sums as n * middle + rest; components (a column each), their variances, all variance."""

    n: int
    middle: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite entries alone."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return rows.filter(F.forall(f"`{vector}`", finite))


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The whole numbers of a batch of vectors, a row each."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return np.clip(np.floor(SCALE * entries), -_LARGEST, _LARGEST).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, whole(part.column("_vector"), size)


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for _, x in _blocks(batches, size):
            n += len(x)
            total += x.sum(0).astype(object)
        sums = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), sums], ["d", "n", "total"])

    parts = vectors.mapInArrow(run, "d int, n long, total decimal(38,0)")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("d").collect()  # one a dimension
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows / factor for an upper triangular factor, by substitution over columns."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(vectors: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the Gram matrices of rows_of(whole numbers)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), np.zeros((width, width))
        for _, x in _blocks(batches, size):
            q = rows_of(x)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([task // FAN], pa.int32()), pa.array([total.tobytes()])], ["task", "fan", "sum"])

    def added(table: pa.Table) -> np.ndarray:
        table = table.sort_by("task")  # in one order, so that a run can be repeated
        return sum(np.frombuffer(x, float) for x in table.column("sum").to_pylist())

    def of_fan(table: pa.Table) -> pa.Table:
        total = added(table).reshape(width, width)
        task = np.full(width, table.column("fan")[0].as_py(), np.int32)
        return pa.table([pa.array(task), pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in total])], ["task", "line", "sum"])

    def of_line(table: pa.Table) -> pa.Table:
        return pa.table([table.column("line").slice(0, 1), pa.array([added(table).tobytes()])], ["line", "sum"])

    fans = vectors.mapInArrow(partial, "task int, fan int, sum binary").groupBy("fan").applyInArrow(of_fan, "task int, line int, sum binary")
    lines = fans.groupBy("line").applyInArrow(of_line, "line int, sum binary").orderBy("line").collect()  # one a dimension
    total = np.array([np.frombuffer(r["sum"], float) for r in lines]).reshape(-1, width)
    return (total + total.T) / 2


def triangle(vectors: DataFrame, size: int, n: int, centred: Callable[[np.ndarray], np.ndarray], g: np.ndarray) -> np.ndarray:
    """R of a QR decomposition of the centred rows, from their Gram matrix on (the last factor need not be triangular)."""
    factors: list[np.ndarray] = []
    width = len(g)

    def rows_of(x: np.ndarray) -> np.ndarray:
        q = centred(x)
        for r in factors:
            q = solved(q, r)
        return q

    reach = 1.0  # how small a singular value, beside the largest, the shifts so far have brought to light
    for k in range(PASSES):
        if k:
            g = gram(vectors, size, rows_of, width)
        values, directions = np.linalg.eigh(g)
        near, lacking = abs(values - 1) < 1e-6, values < 1e-6
        settled = near.all() or ((near | lacking).all() and reach * 1e-3 < width * MISSING)
        if k and settled or k == PASSES - 1:
            # near the identity but for directions that A lacks: the root of what is left is the last factor
            last = np.where(lacking, 0, np.sqrt(abs(values)))[:, None] * directions.T
            break
        shift = 11 * (n * width + width * (width + 1)) * _UNIT * values[-1]
        if k and values[0] > 4 * shift:
            shift = 0
        else:
            reach *= np.sqrt(shift / values[-1])
        factors.append(np.linalg.cholesky(g + shift * np.eye(width)).T)
    product = last
    for r in reversed(factors):
        product = product @ r
    return product


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Model | None:
    """Components of all usable vectors of the most frequent length; None if there are none."""
    vectors = usable(rows, vector).select(F.col(f"`{vector}`").alias("_vector"))
    sizes = vectors.groupBy(F.size("_vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes or not sizes[0]["size"]:
        return None
    size = sizes[0]["size"]
    vectors = vectors.filter(F.size("_vector") == size)
    n, sums = _sums(vectors, size)
    middle, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    squares = gram(vectors, size, lambda x: (x - middle) - rest / n, size)
    live = np.flatnonzero(np.diag(squares) > 0)
    if not len(live):
        return Model(n, middle, rest, np.zeros((size, 0)), np.zeros(0), 0.0)
    r = triangle(vectors, size, n, lambda x: ((x - middle) - rest / n)[:, live], squares[np.ix_(live, live)])
    _, values, right = np.linalg.svd(r)
    held = min(components, int((values > len(live) * MISSING * values[0]).sum()))
    out = np.zeros((size, held))
    out[live] = right[:held].T
    out *= np.sign(out[abs(out).argmax(0), np.arange(held)])
    return Model(n, middle, rest, out, values[:held] ** 2 / n, float((values**2).sum() / n))


def identity_error(rows: DataFrame, vector: str, model: Model) -> float:
    """Largest entry of the covariance of all whitened rows less the identity, measured in a pass of its own."""
    size, held = model.components.shape
    vectors = usable(rows, vector).select(F.col(f"`{vector}`").alias("_vector")).filter(F.size("_vector") == size)
    n, middle, rest, weights = model.n, model.middle, model.rest, model.components / np.sqrt(model.variances)

    def rows_of(x: np.ndarray) -> np.ndarray:
        white = ((x - middle) - rest / n) @ weights
        return np.concatenate((white, np.ones((len(x), 1))), 1)

    g = gram(vectors, size, rows_of, held + 1)
    mean = g[:-1, -1] / model.n
    return float(abs(g[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(held)).max(initial=0))


def deviations(x: np.ndarray, middle: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Exact sums over the dimensions of (n x - S)^2, null beyond a long."""
    away = x - middle
    about = ((n * away.astype(float) - rest) ** 2).sum(1)
    out = np.zeros(len(x), np.int64)
    small = about < float(1 << 62)
    out[small] = ((n * away[small] - rest) ** 2).sum(1)
    null = about > 1.001 * float(1 << 63)
    for i in np.flatnonzero(~small & ~null):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(away[i], rest))
        null[i], out[i] = exact >= 1 << 63, min(exact, (1 << 63) - 1)
    return pa.array(out, mask=null)


def whiten(rows: DataFrame, keys: Sequence[str], vector: str, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: keys, component (from 1), n, deviation, whitened, explained, identity_error.

    Two or more passes fit the model when this is called. No key may be named like an output.
    """
    keys = list(keys)
    kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    source = usable(rows, vector).select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{vector}`").alias("_vector"))
    schema = source.select(*(F.col(f"`{k}`") for k in keys), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema
    model = fit(rows, vector, components)
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    n, middle, rest, explained = model.n, model.middle, model.rest, model.variances / model.trace
    weights = model.components / np.sqrt(model.variances)
    error = identity_error(rows, vector, model)
    size, held = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, size):
            white = ((x - middle) - rest / n) @ weights
            line = pa.array(np.repeat(np.arange(len(x)), held))
            columns = [part.column(k).take(line) for k in keys]
            columns.append(pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), len(x))))
            columns.append(pa.array(np.full(len(line), n, np.int64)))
            columns.append(deviations(x, middle, rest, n).take(line))
            columns += [pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(line), error))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *kinds])

    return source.filter(F.size("_vector") == size).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """The first components of all embeddings."""
    return whiten(rows.select(F.col("vec_id").cast("long"), "embedding"), ["vec_id"], "embedding")
