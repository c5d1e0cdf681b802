"""Login lockout: the fifth failure locks an account for 30 minutes.

A success clears the counter. Attempts during a lock are ignored. The counter is not cleared when a lock
runs out, so the next failure locks again.

The stream keeps (failures, locked_until) per account and holds attempts back until the watermark has passed
them, so that their order is that of the events. The batch twin walks each account's attempts in
order; accounts with very many attempts are cut into time slices. A slice is first turned into rows
"state at entry -> state at exit" for every state that can matter: five counter classes when unlocked,
or the attempt at which a lock from before runs out. The rows that really occur are found by joins with
doubling distance, and then all slices are walked side by side, each from its true entry state.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from wardline.sources.staging import cut

# The functions below travel to the executors by value: these need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Failures before a lock, length of a lock.
MAX_FAILURES = 5
LOCK_MINUTES = 30

_LOCK = LOCK_MINUTES * 60 * 1_000_000
_TOP = MAX_FAILURES - 1
_OPEN = -1
SPLIT_OVER = 200_000
SLICE_HOURS = 6
_SLICE = SLICE_HOURS * 3600 * 1_000_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, event_id long, at long, outcome string, failed_attempts long, locked_until long"
_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]


def login_attempts(events: DataFrame) -> DataFrame:
    """Login attempts in an event feed: errors fail, sign-ups and purchases succeed, the rest is no attempt."""
    kinds = F.col("event_type")
    return events.filter(kinds.isin("error", "signup", "purchase")).select(
        "user_id", "event_id", "ts", (kinds != "error").alias("succeeded")
    )


def attempt(failures: int, locked: int, at: int, succeeded: bool) -> tuple[str, int, int]:
    """One attempt against (failures, locked_until): outcome and new state."""
    if locked > at:
        return "locked", failures, locked
    if succeeded:
        return "success", 0, _OPEN
    failures += 1
    if failures >= MAX_FAILURES:
        return "lockout", failures, at + _LOCK
    return "failure", failures, _OPEN


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Attempts sorted by (user_id, slice, at, event_id), each slice with its entry state."""
    place, failures, locked = None, 0, _OPEN
    for batch in batches:
        outcome, counted, until = [], [], []
        columns = (batch[c].tolist() for c in ("user_id", "slice", "at", "succeeded", "entry_failures", "entry_locked"))
        for user, part, at, succeeded, entry_failures, entry_locked in zip(*columns):
            if place != (user, part):
                place, failures, locked = (user, part), entry_failures, entry_locked
            result, failures, locked = attempt(failures, locked, at, succeeded)
            outcome.append(result)
            counted.append(failures)
            until.append(locked)
        yield pd.DataFrame(
            {
                "user_id": batch["user_id"],
                "event_id": batch["event_id"],
                "at": batch["at"],
                "outcome": outcome,
                "failed_attempts": counted,
                "locked_until": until,
            }
        )


_EXITS = "user_id long, slice long, entry int, start_at long, reset boolean, count long, lock long"
_NEVER = 1 << 62


def _slice_exits(user: int, part: int, at: list[int], ok: list[bool]) -> list[tuple]:
    """Exit state of one slice, its attempts in order, for each entry that can matter.

    Entries 0 to 4 are the counter classes of an unlocked account. Entry 4 + i is an account whose running
    lock ends before attempt i; a lock from before the slice ends within its first half hour.
    """
    n = after = len(at)
    window = bisect.bisect_left(at, part * _SLICE + _LOCK)
    # exits[i][c]: (reset?, count or increment, lock) for class c before attempt i; i runs backwards.
    exits = {n: [(False, 0, _OPEN)] * MAX_FAILURES}
    for i in range(n - 1, -1, -1):
        follow = exits[i + 1]
        if ok[i]:
            reset, count, lock = follow[0]
            exits[i] = [(True, count, lock)] * MAX_FAILURES
        else:
            row = [(r, c if r else c + 1, lock) for r, c, lock in follow[1:]]
            until = at[i] + _LOCK
            while after > 0 and at[after - 1] >= until:
                after -= 1
            reset, count, lock = exits[after][_TOP]
            row.append((reset, count if reset else count + 1, until if after == n else lock))
            exits[i] = row
    rows = [(user, part, c, at[0] if c == _TOP else None, *exits[0][c]) for c in range(MAX_FAILURES)]
    for i in range(1, window + 1):
        rows.append((user, part, _TOP + i, at[i] if i < n else _NEVER, *exits[i][_TOP]))
    return rows


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exits of every slice of attempts sorted by (user_id, slice, at, event_id); one slice is held at a time."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["user_id", "slice", "entry", "start_at", "reset", "count", "lock"], dtype=object)
        whole = {c: "int64" for c in ("user_id", "slice", "entry", "count", "lock")}
        return pdf.astype({**whole, "start_at": "Int64", "reset": bool})

    place, held_at, held_ok = None, [], []
    for batch in batches:
        rows = []
        for user, part, at, ok in zip(*(batch[c].tolist() for c in ("user_id", "slice", "at", "succeeded"))):
            if place != (user, part):
                if held_at:
                    rows += _slice_exits(*place, held_at, held_ok)
                place, held_at, held_ok = (user, part), [], []
            held_at.append(at)
            held_ok.append(ok)
        yield frame(rows)
    if held_at:
        yield frame(_slice_exits(*place, held_at, held_ok))


def _counters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state of every slice, from the one exit per slice that applies, sorted by (user_id, slice)."""
    account, failures, locked = None, 0, _OPEN
    for batch in batches:
        entered, until = [], []
        for user, reset, count, lock in zip(*(batch[c].tolist() for c in ("user_id", "reset", "count", "lock"))):
            if account != user:
                account, failures, locked = user, 0, _OPEN
            entered.append(failures)
            until.append(locked)
            failures, locked = (count if reset else failures + count), lock
        yield pd.DataFrame(
            {"user_id": batch["user_id"], "slice": batch["slice"], "entry_failures": entered, "entry_locked": until}
        )


def _entries(sliced: DataFrame) -> DataFrame:
    """True entry state of every slice of the large accounts.

    The exit of a slice says at which entry the account's next slice is entered, so the entries form chains.
    The ones that really occur are those reachable from an account's first slice with a clean counter. They
    are found by jumps of 1, 2, 4, ... slices, so the number of joins grows with the logarithm of the
    number of slices and no account passes one task. A lock is shorter than a slice and never outlasts the next.
    """
    laid = sliced.repartition("user_id", "slice").sortWithinPartitions("user_id", "slice", "at", "event_id")
    exits = cut(laid.mapInPandas(_exits, _EXITS))
    in_order = W.partitionBy("user_id").orderBy("slice")
    slices = exits.filter("entry = 0").select("user_id", "slice", F.lead("slice").over(in_order).alias("to_slice"))
    leaving = exits.join(slices.filter("to_slice is not null"), ["user_id", "slice"])
    fresh = F.when(F.col("reset"), F.col("count")).otherwise(F.least("entry", F.lit(_TOP)) + F.col("count"))
    open_edges = leaving.filter(F.col("lock") == _OPEN).select(
        "user_id", "slice", "entry", "to_slice", F.least(fresh, F.lit(_TOP)).cast("int").alias("to_entry")
    )
    # A running lock enters the next slice at the first attempt not before its end.
    ends = leaving.filter(F.col("lock") != _OPEN).select(
        "user_id", F.col("to_slice").alias("in_slice"), F.col("lock").alias("t"), F.lit(0).alias("kind"), "slice", "entry",
        F.lit(None).cast("int").alias("to_entry"),
    )
    starts = exits.filter(F.col("start_at").isNotNull()).select(
        "user_id", F.col("slice").alias("in_slice"), F.col("start_at").alias("t"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("slice"), F.lit(None).cast("int").alias("entry"), F.col("entry").alias("to_entry"),
    )
    following = (
        W.partitionBy("user_id", "in_slice").orderBy("t", "kind", "to_entry").rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    locked_edges = (
        ends.unionByName(starts)
        .withColumn("to_entry", F.first("to_entry", ignorenulls=True).over(following))
        .filter("kind = 0")
        .select("user_id", "slice", "entry", F.col("in_slice").alias("to_slice"), "to_entry")
    )
    jumps = [cut(open_edges.unionByName(locked_edges))]
    while not jumps[-1].isEmpty():
        near = jumps[-1].withColumnsRenamed({"to_slice": "mid_slice", "to_entry": "mid_entry"})
        far = jumps[-1].withColumnsRenamed({"slice": "mid_slice", "entry": "mid_entry"})
        doubled = near.join(far, ["user_id", "mid_slice", "mid_entry"]).drop("mid_slice", "mid_entry")
        jumps.append(cut(doubled))
    reached = exits.groupBy("user_id").agg(F.min("slice").alias("slice")).withColumn("entry", F.lit(0))
    for jump in reversed(jumps[:-1]):
        onward = jump.join(reached, ["user_id", "slice", "entry"], "left_semi").select(
            "user_id", F.col("to_slice").alias("slice"), F.col("to_entry").alias("entry")
        )
        reached = cut(reached.unionByName(onward))
    path = exits.join(reached, ["user_id", "slice", "entry"], "left_semi").select("user_id", "slice", "reset", "count", "lock")
    in_turn = path.repartition("user_id").sortWithinPartitions("user_id", "slice")
    return in_turn.mapInPandas(_counters, "user_id long, slice long, entry_failures long, entry_locked long")


def lockouts(attempts: DataFrame, *, split_over: int = SPLIT_OVER) -> DataFrame:
    """Outcome and account state after every attempt. attempts: user_id, event_id, ts, succeeded."""
    base = attempts.select("user_id", "event_id", _micros("ts").alias("at"), "succeeded")
    large = cut(base.groupBy("user_id").count().filter(F.col("count") > split_over).select("user_id", F.lit(True).alias("_large")))
    sliced = base.join(large, "user_id", "left").withColumn(
        "slice", F.when(F.col("_large"), F.floor(F.col("at") / F.lit(_SLICE))).otherwise(F.lit(0)).cast("long")
    )
    if large.isEmpty():
        entered = sliced.withColumns({"entry_failures": F.lit(0).cast("long"), "entry_locked": F.lit(_OPEN).cast("long")})
    else:
        entries = cut(_entries(sliced.filter("_large").drop("_large")))
        entered = sliced.join(entries, ["user_id", "slice"], "left").fillna({"entry_failures": 0, "entry_locked": _OPEN})
    ordered = entered.drop("_large").repartition("user_id", "slice").sortWithinPartitions("user_id", "slice", "at", "event_id")
    return _shaped(ordered.mapInPandas(_walk, OUTPUT))


def _shaped(df: DataFrame) -> DataFrame:
    until = F.when(F.col("locked_until") >= 0, F.timestamp_micros("locked_until").cast("timestamp_ntz"))
    return df.select(
        "user_id", "event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "outcome", "failed_attempts",
        until.alias("locked_until"),
    )


class InOrder(StatefulProcessor):
    """Releases the attempts of an account in (at, event_id) order once the watermark has passed them.

    State per account: attempts that wait, (failures, locked_until), and the one timer, which stands at the earliest
    attempt that waits. An account that nothing waits for and whose counter is clean keeps no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, succeeded boolean")
        self.account = handle.getValueState("account", "failures long, locked long")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, earliest: int) -> None:
        due = earliest // 1000 + 1
        if self.timer.exists():
            set_to = self.timer.get()[0]
            if set_to <= due:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["succeeded"].tolist())))
            self._set_timer(int(pdf["at"].min()))
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        failures, locked = self.account.get() if self.account.exists() else (0, _OPEN)
        results = []
        for at, event_id, succeeded in ready:
            outcome, failures, locked = attempt(failures, locked, at, succeeded)
            results.append((key[0], event_id, at, outcome, failures, locked))
        self.timer.clear()
        if later:
            self.waiting.put(later)
            self._set_timer(later[0][0])
        else:
            self.waiting.clear()
        if failures:
            self.account.update((failures, locked))
        else:
            self.account.clear()
        yield pd.DataFrame(results, columns=_COLUMNS)

    def close(self) -> None:
        pass


# Rows of state, packed: a bucket of accounts reads and writes each of its states as a whole, not row by row.
_WAITING = [("user", "<i8"), ("no_user", "?"), ("at", "<i8"), ("event", "<i8"), ("no_event", "?"), ("ok", "?")]
_ACCOUNTS = [("user", "<i8"), ("no_user", "?"), ("failures", "<i8"), ("locked", "<i8")]


def _packed(columns: list, layout: list[tuple[str, str]]) -> np.ndarray:
    rows = np.empty(len(columns[0]), dtype=layout)
    for (name, _), column in zip(layout, columns):
        rows[name] = column
    return rows


class BucketsInOrder(InOrder):
    """The same for a bucket of accounts at a time: the calls to the state are those of the buckets, not of the accounts.

    State per bucket: attempts that wait, (failures, locked_until) of its accounts whose counter is not clean, the timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.accounts = handle.getValueState("accounts", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        chunks = [_packed([pdf[name] for name, _ in _WAITING], _WAITING) for pdf in rows]
        self.waiting.appendList([(chunk.tobytes(),) for chunk in chunks])
        self._set_timer(int(min(chunk["at"].min() for chunk in chunks)))
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.frombuffer(chunk, dtype=_WAITING) for (chunk,) in self.waiting.get()])
        later, ready = rows[rows["at"] >= passed], rows[rows["at"] < passed]
        ready = ready[np.lexsort((ready["event"], ~ready["no_event"], ready["at"]))]
        known = np.frombuffer(self.accounts.get()[0], dtype=_ACCOUNTS).tolist() if self.accounts.exists() else []
        state = {(user, no_user): (failures, locked) for user, no_user, failures, locked in known}
        outcomes, counted, until = [], [], []
        for user, no_user, at, _, _, succeeded in ready.tolist():
            outcome, failures, locked = attempt(*state.get((user, no_user), (0, _OPEN)), at, succeeded)
            state[user, no_user] = failures, locked
            outcomes.append(outcome)
            counted.append(failures)
            until.append(locked)
        self.timer.clear()
        if len(later):
            self.waiting.put([(later.tobytes(),)])
            self._set_timer(int(later["at"].min()))
        else:
            self.waiting.clear()
        kept = [(*account, failures, locked) for account, (failures, locked) in state.items() if failures]
        if kept:
            self.accounts.update((np.array(kept, dtype=_ACCOUNTS).tobytes(),))
        else:
            self.accounts.clear()
        yield pd.DataFrame(
            {
                "user_id": pd.arrays.IntegerArray(ready["user"].astype("int64"), ready["no_user"].copy()),
                "event_id": pd.arrays.IntegerArray(ready["event"].astype("int64"), ready["no_event"].copy()),
                "at": ready["at"].astype("int64"),
                "outcome": outcomes,
                "failed_attempts": counted,
                "locked_until": until,
            }
        )


def lockout_stream(attempts: DataFrame, *, lateness: str = "10 minutes", buckets: int | None = None) -> DataFrame:
    """The same over a stream, in event order whatever micro-batch an attempt comes with.

    An attempt is decided when the watermark, `lateness` behind the newest attempt, has passed it; later ones than that
    are dropped by the watermark. Waiting attempts of an account are sorted together. State is kept in RocksDB.

    With `buckets`, state is held per bucket of accounts, which many accounts need: an account of its own costs some
    milliseconds a micro-batch. Attempts that wait in a bucket are sorted together; the number stays with the checkpoint.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    attempts = timed.select("user_id", "event_id", "ts", _micros("ts").alias("at"), "succeeded")
    if buckets is None:
        return _shaped(attempts.groupBy("user_id").transformWithStateInPandas(InOrder(), OUTPUT, "append", "eventtime"))
    keyed = attempts.select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"),
        "ts",
        "at",
        *(F.coalesce(c, F.lit(0)).alias(name) for c, name in (("user_id", "user"), ("event_id", "event"))),
        *(F.col(c).isNull().alias(name) for c, name in (("user_id", "no_user"), ("event_id", "no_event"))),
        F.coalesce("succeeded", F.lit(False)).alias("ok"),
    ).groupBy("bucket")
    return _shaped(keyed.transformWithStateInPandas(BucketsInOrder(), OUTPUT, "append", "eventtime"))
