"""Ordered admission against a limited room, for whole request tables.

Each key has a room (cents still owed on a bill, units in stock). Requests are looked at in order; one
is admitted when its units are positive and fit the room that is left plus a slack, and a refused
request takes nothing. With a slack, a key closes once its room is used up. That is a sequential rule,
so a running sum alone cannot decide it; yet no key may be gathered into one task.

* A key whose feasible requests fit its room together admits them all: one aggregate decides.
* A contested key with few requests is folded in order.
* A contested key with many requests is decided in rounds. In a round, "small" requests are those of at
  most half the room left. Until half the room is used every small one fits, so their running sum,
  taken over range partitions and not over the key, finds the first request that either brings the use
  to half the room or is large and still fits. That request ends the round and the room has at least
  halved, so the number of rounds is bounded by the logarithm of the room, whatever the row count.

With `once`, a value of that column (say, a prescription) is admitted at most once: the request admitted
first closes it, a refused one does not. A fold carries the closed values. In a round of a large key only the
first small request of a value that is still open counts, and its large ones before that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.functions.ordering import positioned
from wardline.sources.staging import cut

FOLD_LIMIT = 1000
_END = (1 << 62)


def admit_in_order(
    requests: DataFrame,
    *,
    key: str,
    order: Sequence[str],
    row_id: str,
    units: str,
    room: str,
    slack: int = 0,
    fold_limit: int = FOLD_LIMIT,
    once: str | None = None,
) -> DataFrame:
    """Add `admitted` (boolean) and `used_before` (units admitted earlier for the key) to every request;
    with `once`, also `closed`: an earlier request was admitted for the same value."""
    laid = positioned(requests, [F.col(key), *[F.col(c) for c in order]])
    feasible = F.coalesce((F.col(units) > 0) & (F.col(units) <= F.col(room) + slack), F.lit(False))
    candidates = laid.filter(feasible).select(key, "_part", "_pos", row_id, units, room, F.col(once or row_id).alias("_value"))

    contested = (
        candidates.groupBy(key)
        .agg(F.sum(units).alias("_total"), F.count("*").alias("_rows"), F.first(room).alias(room))
        .filter(F.col("_total") > F.col(room))
    )
    contested = cut(contested)
    few = contested.filter(F.col("_rows") <= fold_limit)
    many = contested.filter(F.col("_rows") > fold_limit)

    verdicts = _fold(candidates, few, key, row_id, units, room, slack)
    steps = [] if many.isEmpty() else _rounds(candidates, many, key, units, room, slack, once is not None)
    if steps:
        each = F.struct("_from_part", "_from_pos", "_to_part", "_to_pos", "_left")
        plan = reduce(DataFrame.unionByName, steps).groupBy(key).agg(F.collect_list(each).alias("_steps"))
        verdicts = verdicts.withColumn("_steps", F.lit(None).cast(plan.schema["_steps"].dataType)).unionByName(
            plan.withColumn("_ids", F.lit(None).cast(verdicts.schema["_ids"].dataType)), allowMissingColumns=True
        )

    # Verdicts travel by (key, partition): no join partition is larger than a slice of the sorted table.
    slices = laid.select(key, "_part").distinct()
    by_slice = slices.join(verdicts, key)
    admitted = F.when(~feasible, False).when(F.col("_ids").isNotNull(), F.array_contains("_ids", F.col(row_id)))
    if steps:
        admitted = admitted.when(
            F.col("_steps").isNotNull(), F.exists("_steps", lambda s: _inside(s) & (_ends(s) | (F.col(units) * 2 <= s["_left"])))
        )
    decided = cut(
        laid.join(by_slice, [key, "_part"], "left")
        .withColumn("admitted", F.coalesce(admitted.otherwise(True), F.lit(False)))
        .drop("_ids", "_steps")
    )
    return _used_before(decided if once is None else cut(_first_only(decided, key, once)), key, units)


def _first_only(decided: DataFrame, key: str, once: str) -> DataFrame:
    """Of the requests that fit, those that are first for their value; and who came after them."""
    firsts = decided.filter("admitted").groupBy(key, once).agg(F.min(_place()).alias("_first"))
    joined = decided.join(firsts, [key, once], "left")
    return (
        joined.withColumn("closed", F.coalesce(_place() > F.col("_first"), F.lit(False)))
        .withColumn("admitted", F.col("admitted") & ~F.col("closed"))
        .drop("_first")
    )


def _place() -> Column:
    return F.struct("_part", "_pos")


def _inside(step: Column | dict[str, Column]) -> Column:
    after = (F.col("_part") > step["_from_part"]) | (
        (F.col("_part") == step["_from_part"]) & (F.col("_pos") > step["_from_pos"])
    )
    upto = (F.col("_part") < step["_to_part"]) | (
        (F.col("_part") == step["_to_part"]) & (F.col("_pos") <= step["_to_pos"])
    )
    return after & upto


def _inside_columns() -> Column:
    return _inside({c: F.col(c) for c in ("_from_part", "_from_pos", "_to_part", "_to_pos")})


def _ends(step: Column) -> Column:
    return (F.col("_part") == step["_to_part"]) & (F.col("_pos") == step["_to_pos"])


def _fold(candidates: DataFrame, few: DataFrame, key: str, row_id: str, units: str, room: str, slack: int) -> DataFrame:
    """Ids admitted per contested key of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct("_part", "_pos", F.col(units).alias("u"), F.col(row_id).alias("id"), F.col("_value").alias("v"))))
    grouped = (
        candidates.join(few.select(key), key, "left_semi").groupBy(key).agg(rows.alias("_rows"), F.first(room).alias("_room"))
    )
    none = F.slice(F.transform("_rows", lambda r: r["v"]), 1, 0)
    start = F.struct(F.col("_room").alias("left"), F.expr("cast(array() as array<bigint>)").alias("ids"), none.alias("closed"))

    def step(state: Column, row: Column) -> Column:
        untouched = F.size(state["ids"]) == 0
        fits = (row["u"] <= state["left"] + slack) & ((state["left"] > 0) | untouched) & ~F.array_contains(state["closed"], row["v"])
        taken = F.struct(
            (state["left"] - row["u"]).alias("left"),
            F.concat(state["ids"], F.array(row["id"])).alias("ids"),
            F.concat(state["closed"], F.array(row["v"])).alias("closed"),
        )
        return F.when(fits, taken).otherwise(state)

    return grouped.select(key, F.aggregate("_rows", start, step, lambda s: s["ids"]).alias("_ids"))


def _rounds(candidates: DataFrame, many: DataFrame, key: str, units: str, room: str, slack: int, once: bool) -> list[DataFrame]:
    """Admission steps of large contested keys: stretches of the order and the room left at their start."""
    rows = cut(candidates.join(many.select(key), key, "left_semi").select(key, "_part", "_pos", units, "_value"))
    slices = cut(rows.select(key, "_part").distinct())
    state = many.select(key, F.col(room).alias("_left"), F.lit(-1).alias("_from_part"), F.lit(-1).cast("long").alias("_from_pos"))
    small = F.col(units) * 2 <= F.col("_left")
    in_slice = W.partitionBy(key, "_part").orderBy("_pos")
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    steps: list[DataFrame] = []
    while True:
        active = rows.join(slices.join(state, key), [key, "_part"]).filter(
            ((F.col("_part") > F.col("_from_part")) | (F.col("_pos") > F.col("_from_pos")))
            & (F.col("_part") >= F.col("_from_part"))
            & (F.col(units) <= F.col("_left") + slack)
        )
        if once:
            first = active.filter(small).groupBy(key, "_value").agg(F.min(_place()).alias("_first"))
            counts = F.col("_first").isNull() | F.when(small, _place() == F.col("_first")).otherwise(_place() < F.col("_first"))
            active = cut(active.join(first, [key, "_value"], "left").filter(counts).drop("_first"))
        per_slice = active.groupBy(key, "_part").agg(F.sum(F.when(small, F.col(units)).otherwise(0)).alias("_slice"))
        offsets = per_slice.select(key, "_part", F.coalesce(F.sum("_slice").over(earlier), F.lit(0)).alias("_before"))
        summed = (
            active.withColumn("_in", F.sum(F.when(small, F.col(units)).otherwise(0)).over(in_slice))
            .join(offsets, [key, "_part"])
            .withColumn("_run", F.col("_before") + F.col("_in"))
        )
        half_used = small & (F.col("_run") * 2 >= F.col("_left"))
        large_fits = ~small & (F.col(units) <= F.col("_left") + slack - F.col("_run"))
        taken = F.col("_run") + F.when(small, 0).otherwise(F.col(units))
        ends = (
            summed.filter(half_used | large_fits)
            .groupBy(key)
            .agg(F.min(F.struct("_part", "_pos", taken.alias("_taken"))).alias("_end"))
        )
        step = cut(
            state.join(ends, key, "left").select(
                key,
                "_left",
                "_from_part",
                "_from_pos",
                F.coalesce("_end._part", F.lit(_END)).alias("_to_part"),
                F.coalesce("_end._pos", F.lit(_END)).alias("_to_pos"),
                F.coalesce(F.col("_left") - F.col("_end._taken"), F.lit(0)).alias("_next"),
            )
        )
        steps.append(step)
        if once:
            ended = active.drop("_left", "_from_part", "_from_pos").join(step, key).filter(
                _inside_columns() & (small | ((F.col("_part") == F.col("_to_part")) & (F.col("_pos") == F.col("_to_pos"))))
            )
            rows = cut(rows.join(ended.select(key, "_value").distinct(), [key, "_value"], "left_anti"))
        state = step.filter(F.col("_next") > 0).select(
            key, F.col("_next").alias("_left"), F.col("_to_part").alias("_from_part"), F.col("_to_pos").alias("_from_pos")
        )
        if state.isEmpty():
            return steps


def _used_before(decided: DataFrame, key: str, units: str) -> DataFrame:
    """Running total of admitted units before each row: inside a slice by window, across slices by offsets."""
    taken = F.when(F.col("admitted"), F.col(units)).otherwise(0)
    in_slice = W.partitionBy(key, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        decided.groupBy(key, "_part")
        .agg(F.sum(taken).alias("_slice"))
        .select(key, "_part", F.coalesce(F.sum("_slice").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        decided.withColumn("_in", F.coalesce(F.sum(taken).over(in_slice), F.lit(0)))
        .join(offsets, [key, "_part"], "left")
        .withColumn("used_before", F.coalesce("_before", F.lit(0)) + F.col("_in"))
        .drop("_part", "_pos", "_before", "_in")
    )
