"""Requests that claim several unique keys at once, admitted as if taken one by one.

In order, a request is admitted if no earlier admitted one has any of its keys; a refused request reserves nothing.
So whether a request is in depends on the earlier ones that share a key with it, and these on others before them.

Decided in rounds. Per round every key names the first two requests left that claim it, which is all that a hot key
sends on. Then

* a request that is first for all its keys is admitted;
* a request with a single rival before it, over all its keys, is in exactly if that rival is not. Such requests form
  chains, which are followed to their roots by pointer doubling that carries whether the answer turns on the way, so
  a chain of any length takes joins in proportion to the logarithm of its length, in one round;
* what shares a key with an admitted request is refused.

A path of shared keys in any order of arrival is done after two rounds, as each of its requests has one rival before
it or lies between two that the first round decides. Deeper knots of keys with many claims take further rounds, each
of which settles at least the first request left of every connected knot. Once few rows are left altogether, they are
taken one by one in a single task, which saves the last rounds.

Defined results: a null key claims nothing, a request without any key is admitted; ties of the order go by the next
column of it, and of rows equal in all of them any one comes first; no requests give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from wardline.functions.ordering import top_per, with_sequence
from wardline.sources.staging import cut

# The walk travels to the executors by value: these need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Requests up to which what is left is taken one by one.
LAST_ROWS = 100_000


def admit_claims(
    requests: DataFrame, *, keys: Sequence[str], order: Sequence[str], row_id: str, last: int = LAST_ROWS
) -> DataFrame:
    """row_id of the admitted requests. requests: row_id, the columns of order and the keys."""
    names = [f"key_{i}" for i in range(len(keys))]
    ranks = [f"order_{i}" for i in range(len(order))]
    asked = requests.select(
        F.col(row_id).alias("row"),
        *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names)),
        *(F.col(c).alias(r) for c, r in zip(order, ranks)),
    )
    numbered = cut(with_sequence(asked, [F.col(r) for r in ranks], "seq").drop(*ranks))
    left = numbered.drop("row")
    admitted: list[DataFrame] = []
    while (rows := left.count()) > last:
        wave, left = _round(left, names)
        admitted.append(wave)
    if rows or not admitted:
        admitted.append(_walked(left, names))
    return numbered.join(reduce(DataFrame.unionByName, admitted), "seq", "left_semi").select(F.col("row").alias(row_id))


def _round(left: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """seq of those admitted in a round, and the requests that are still open after it."""
    claims = left.select("seq", F.posexplode(F.array(*names)).alias("kind", "key")).filter("key is not null")
    pairs = top_per(claims, ["kind", "key"], [F.col("seq")], 2).groupBy("kind", "key").agg(
        F.min("seq").alias("first"), F.max("seq").alias("second")
    )
    alone = F.struct(F.col("first").alias("seq"), F.lit(None).cast("long").alias("rival"))
    behind = F.when(F.col("second") > F.col("first"), F.struct(F.col("second").alias("seq"), F.col("first").alias("rival")))
    placed = pairs.select(F.explode(F.array(alone, behind)).alias("p")).filter("p is not null").select("p.*")
    placed = placed.groupBy("seq").agg(F.count("*").alias("at"), F.min("rival").alias("rival"), F.max("rival").alias("_other"))
    wanted = reduce(lambda a, b: a + b, (F.col(n).isNotNull().cast("int") for n in names))
    judged = cut(
        left.select("seq", wanted.alias("wanted"))
        .join(placed, "seq", "left")
        .filter("coalesce(at, 0) = wanted and rival <=> _other")
        .select("seq", "rival")
    )
    sure = judged.filter("rival is null").select("seq")
    chains = _followed(judged.filter("rival is not null").select("seq", "rival", F.lit(True).alias("turned")))
    decided = chains.join(sure.withColumnRenamed("seq", "rival"), "rival", "left_semi").select("seq", (~F.col("turned")).alias("ok"))
    decided = cut(decided.unionByName(sure.withColumn("ok", F.lit(True))))
    wave = decided.filter("ok").select("seq")
    taken = left.join(wave, "seq", "left_semi")
    left = left.join(decided, "seq", "left_anti")
    for name in names:
        left = left.join(taken.select(name).filter(F.col(name).isNotNull()), name, "left_anti")
    return wave, cut(left)


def _followed(links: DataFrame) -> DataFrame:
    """Links (seq, rival, turned) whose rival is no link itself any more; turned: seq is in if the rival is not."""
    links = cut(links)
    while True:
        onward = links.select(F.col("seq").alias("rival"), F.col("rival").alias("_next"), F.col("turned").alias("_turned"))
        if links.join(onward, "rival", "left_semi").isEmpty():
            return links
        turned = F.col("turned") != F.coalesce("_turned", F.lit(False))
        links = cut(
            links.join(onward, "rival", "left").select("seq", F.coalesce("_next", "rival").alias("rival"), turned.alias("turned"))
        )


def _walked(left: DataFrame, names: Sequence[str]) -> DataFrame:
    """seq of the admitted ones among few requests, taken one by one."""
    names = list(names)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[tuple[int, str]] = set()
        for batch in batches:
            admitted = []
            for seq, *keys in zip(*(batch[c].tolist() for c in ["seq", *names])):
                claims = {(kind, key) for kind, key in enumerate(keys) if isinstance(key, str)}
                if taken.isdisjoint(claims):
                    taken |= claims
                    admitted.append(seq)
            yield pd.DataFrame({"seq": pd.Series(admitted, dtype="int64")})

    return cut(left.select("seq", *names).repartition(1).sortWithinPartitions("seq").mapInPandas(walk, "seq long"))
