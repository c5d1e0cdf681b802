"""Moves between places that hold one owner each, as if taken one by one: appointments between slots, patients
between phone numbers.

A move is admitted if no other owner holds its target at that time; an admitted move gives up the place that its
owner held, and an earlier one of the batch may just have done so. So requests wait for each other: a move into a
place depends on whether the holder's next move is admitted, which depends on the holder of that move's target.

All of it is decided in rounds over tenures, rows "this owner holds this place since that request". Per round

* a tenure's possible end is the owner's next request to another place that has not been refused;
* requests for the place that come before this end are refused;
* the first request left for a place is admitted if no tenure of another owner may still be open then;
* if a single tenure may, and its owner makes no other request in between, the request is admitted exactly if that
  one end is. Such requests form chains, which are followed to their roots by pointer doubling, so a chain of any
  length takes joins in proportion to the logarithm of its length, in one round.

The earliest request that is open is always decided, and a ring of owners who want each other's places has none
that comes first to a free one, so it is refused like it is one by one. A place that changes hands k times within
the batch, or a request that waits for several owners, takes further rounds. A round handles the places that are
still contested only; keys are never gathered, contenders shrink to one row a place by aggregation. Once what is
left is few rows altogether, it is taken one by one in a single task, which saves the last rounds.

Requests that share neither owners nor places, directly or through others, never wait for each other. So a batch of
more rows is first split into connected components: those of few rows are taken one by one, side by side in many
tasks, and rounds are left to the rows of large components.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from wardline.functions.ordering import with_sequence
from wardline.plans.components import components, small_and_large
from wardline.sources.staging import cut

# The walk travels to the executors by value: these need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows (requests and holders of contested places) up to which what is left, or a component of it, is taken one by one.
LAST_ROWS = 100_000


def admit_moves(
    moves: DataFrame,
    holders: DataFrame,
    *,
    place: Sequence[str],
    owner: str,
    order: Sequence[str],
    row_id: str,
    last: int = LAST_ROWS,
) -> DataFrame:
    """row_id of the admitted moves. moves: row_id, order, owner and place; holders: owner and place, now.

    Owners, places and orders are not null. A place may have several holders at the start; then it is free when
    all of them have left.
    """
    target = F.struct(*place).alias("place")
    ranks = [f"order_{i}" for i in range(len(order))]
    asked = moves.select(
        F.col(row_id).alias("row"), F.col(owner).alias("owner"), target, *(F.col(c).alias(r) for c, r in zip(order, ranks))
    )
    numbered = cut(with_sequence(asked, [F.col(r) for r in ranks], "seq").drop(*ranks))
    live = numbered.select("seq", "owner", "place", F.lit(None).cast("boolean").alias("ok"), F.lit(True).alias("fresh"))
    held = holders.select(target, F.col(owner).alias("holder")).distinct().withColumn("since", F.lit(0).cast("long"))
    tenures = cut(held.join(numbered.select("place").distinct(), "place", "left_semi"))
    admitted: list[DataFrame] = []
    split = 0
    while True:
        contested = live.filter("ok is null").select("place")
        rows = live.count() + tenures.join(contested, "place", "left_semi").count()
        if rows <= last:
            admitted.append(cut(_walked(live, tenures, contested)))
            break
        if last and (not split or 2 * rows <= split):  # components break apart as rounds decide
            split = rows
            done, live = _apart(live, tenures, last)
            admitted.append(done)
            if live.filter("ok is null").isEmpty():
                break
            continue
        live = _round(live, tenures)
        new = live.filter("fresh and ok").select("seq", "owner", "place")
        admitted.append(new.select("seq"))
        live = live.filter("ok is null or ok")
        if live.filter("ok is null").isEmpty():
            break
        tenures = tenures.unionByName(new.select("place", F.col("owner").alias("holder"), F.col("seq").alias("since")))
    return numbered.join(reduce(DataFrame.unionByName, admitted), "seq", "left_semi").select(F.col("row").alias(row_id))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (label, seq, owner, place, ok) by label and seq; those of seq 0 say who is where. Returns the open ones that
    are admitted; rows of different labels have nothing to do with each other."""
    held, places, label = defaultdict(set), defaultdict(set), None
    for batch in batches:
        admitted = []
        for own, seq, owner, place, ok in zip(*(batch[c].tolist() for c in ("label", "seq", "owner", "place", "ok"))):
            if own != label:
                held, places, label = defaultdict(set), defaultdict(set), own
            if not seq:
                held[place].add(owner)
                places[owner].add(place)
            elif ok or held[place] <= {owner}:
                for left in places[owner]:
                    held[left].discard(owner)
                places[owner] = {place}
                held[place].add(owner)
                if not ok:
                    admitted.append(seq)
        yield pd.DataFrame({"seq": pd.Series(admitted, dtype="int64")})


def _rows(live: DataFrame, tenures: DataFrame, contested: DataFrame) -> DataFrame:
    """What a walk takes: requests, and with seq 0 who holds contested places at the start."""
    start = tenures.filter("since = 0").join(contested, "place", "left_semi").withColumnsRenamed({"holder": "owner", "since": "seq"})
    asked = live.select("seq", "owner", "place", F.coalesce("ok", F.lit(False)).alias("ok"))
    return asked.unionByName(start.withColumn("ok", F.lit(True)))


def _walked(live: DataFrame, tenures: DataFrame, contested: DataFrame) -> DataFrame:
    """The open requests that are admitted, of few rows, taken one by one."""
    plain = _plain(_rows(live, tenures, contested).withColumn("label", F.lit(0)))
    return plain.repartition(1).sortWithinPartitions("seq").mapInPandas(_walk, "seq long")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("label", "seq", F.col("owner").cast("string"), F.to_json("place").alias("place"), "ok")


def _apart(live: DataFrame, tenures: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """The open requests that are admitted in components of at most `last` rows, and the requests of larger ones."""
    contested = live.filter("ok is null").select("place").distinct()
    rows = cut(_rows(live, tenures, contested).withColumn("node", F.xxhash64("owner")))
    labels = components(rows.select("node", F.xxhash64("place").alias("mark")))
    alone, small, large = small_and_large(rows, "node", labels, last)
    walked = _plain(small).repartition("label").sortWithinPartitions("label", "seq").mapInPandas(_walk, "seq long")
    done = cut(alone.filter("not ok").select("seq").unionByName(walked))  # nobody else has to do with the places
    return done, cut(live.join(large.filter("seq > 0").select("seq"), "seq", "left_semi"))


def _round(live: DataFrame, tenures: DataFrame) -> DataFrame:
    """Requests after one more round. ok: NULL while open; fresh: decided in this round.

    Of those from before, only open ones are kept, and admitted ones of owners who ask or hold still.
    """
    asked = live.filter("ok is null").select("seq", "owner", "place")
    step = live.select(F.col("owner").alias("holder"), F.col("place").alias("to"), F.col("seq").alias("at"), "ok")
    contested = asked.select("place")
    ends = (
        tenures.join(contested, "place", "left_semi")
        .join(step, (tenures["holder"] == step["holder"]) & (F.col("to") != F.col("place")) & (F.col("at") > F.col("since")), "left")
        .groupBy("place", tenures["holder"], "since")
        .agg(F.min(F.when(F.col("at").isNotNull(), F.struct("at", "ok"))).alias("next"))
        .select("place", "holder", "next.at", F.coalesce("next.ok", F.lit(False)).alias("left"))
    )
    other = F.col("holder") != F.col("owner")
    still = other & ~F.col("left")
    judged = cut(
        asked.join(ends, "place", "left")
        .groupBy("seq", "owner", "place")
        .agg(
            F.coalesce(F.max(other & (F.col("at").isNull() | (F.col("at") > F.col("seq")))), F.lit(False)).alias("refused"),
            F.count_if(still).alias("open"),
            F.max(F.when(still, F.struct("at", "holder"))).alias("wait"),
        )
    )
    firsts = judged.filter("not refused").groupBy("place").agg(F.min_by(F.struct("seq", "open", "wait"), "seq").alias("first"))
    firsts = firsts.select("place", "first.*")
    sure = judged.filter("refused").select("seq", F.lit(False).alias("new")).unionByName(
        firsts.filter("open = 0").select("seq", F.lit(True).alias("new"))
    )
    between = step.select(F.col("holder").alias("_holder"), "to", F.col("at").alias("_at"))
    meanwhile = (
        (F.col("holder") == F.col("_holder")) & (F.col("to") != F.col("place")) & (F.col("_at") > F.col("at")) & (F.col("_at") < F.col("seq"))
    )
    waiting = firsts.filter("open = 1").select("seq", "place", "wait.*").join(between, meanwhile, "left_anti")
    links = _followed(waiting.select("seq", F.col("at").alias("like")))
    resolved = links.join(sure.withColumnRenamed("seq", "like"), "like").select("seq", "new")
    known = live.drop("fresh").join(sure.unionByName(resolved), "seq", "left")
    owners = asked.select("owner").unionByName(
        tenures.join(contested, "place", "left_semi").select(F.col("holder").alias("owner"))
    )
    concerned = owners.distinct().withColumn("concerned", F.lit(True))
    return cut(
        known.join(concerned, "owner", "left")
        .filter("new is not null or concerned")
        .select("seq", "owner", "place", F.coalesce("ok", "new").alias("ok"), F.col("new").isNotNull().alias("fresh"))
    )


def _followed(links: DataFrame) -> DataFrame:
    """Links (seq, like) whose `like` is no link itself any more, by doubling."""
    links = cut(links)
    while True:
        onward = links.select(F.col("seq").alias("like"), F.col("like").alias("_next"))
        if links.join(onward, "like", "left_semi").isEmpty():
            return links
        links = cut(links.join(onward, "like", "left").select("seq", F.coalesce("_next", "like").alias("like")))
