"""Streams against their batch twins, and the twins against one-by-one rules."""

import random
import uuid
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.catalog import others
from wardline.sources import sinks
from wardline.streaming import lockout, runs, sessions
from wardline.sources.sinks import read_audit
from wardline.sources.staging import cut, shared_folder, written

BASE = 1_704_067_200_000_000


def attempts(seed, n):
    """One account under steady fire with quieter spells, and a few ordinary ones."""
    rng, rows, at = random.Random(seed), [], BASE
    for i in range(n):
        at += int(rng.expovariate(1 / (40 if i % 900 < 600 else 1500)) * 1e6)
        rows.append((1, i, at, rng.random() < 0.25))
    for i in range(n, n + n // 3):
        rows.append((rng.randint(2, 5), i, BASE + rng.randint(0, 6 * 86400 * 10**6), rng.random() < 0.3))
    return rows


def one_by_one(rows):
    state, out = {}, {}
    for user, event, at, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        failures, locked = state.get(user, (0, None))
        if locked is not None and locked > at:
            out[event] = ("locked", failures)
            continue
        if ok:
            state[user], out[event] = (0, None), ("success", 0)
        else:
            failures += 1
            lock = at + 30 * 60 * 10**6 if failures >= 5 else None
            state[user], out[event] = (failures, lock), ("lockout" if lock else "failure", failures)
    return out


@pytest.mark.parametrize("split_over", [10**9, 100, 0])
def test_lockout_matches_one_by_one(spark, split_over):
    rows = attempts(3, 3000)
    df = spark.createDataFrame(rows, "user_id long, event_id long, m long, succeeded boolean").repartition(6)
    df = df.withColumn("ts", F.timestamp_micros("m").cast("timestamp_ntz"))
    got = {r.event_id: (r.outcome, r.failed_attempts) for r in lockout.lockouts(df, split_over=split_over).collect()}
    assert got == one_by_one(rows)


def test_slices_are_left_as_a_walk_would_leave_them_whatever_the_batches():
    rng = random.Random(5)
    day = [(7, part, part * lockout._SLICE + at, at, rng.random() < 0.2)
           for part in (0, 1, 3) for at in sorted(rng.sample(range(0, lockout._SLICE, 60_000_000), 40))]
    columns = ["user_id", "slice", "at", "event_id", "succeeded"]
    for size in (1, 17, 1000):
        batches = [pd.DataFrame(day[i : i + size], columns=columns) for i in range(0, len(day), size)]
        exits = pd.concat(lockout._exits(iter(batches)))
        clean = exits[exits["entry"] == 0].set_index("slice")
        for part in (0, 1, 3):
            failures, locked = 0, -1
            for _, _, at, _, ok in [r for r in day if r[1] == part]:
                _, failures, locked = lockout.attempt(failures, locked, at, ok)
            assert (clean.loc[part, "count"], clean.loc[part, "lock"]) == (failures, locked)
            assert len(exits[exits["slice"] == part]) >= lockout.MAX_FAILURES


def test_slices_do_not_take_a_group_of_pandas_each(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lockout, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    rows = [(u, i, datetime(2024, 1, 1 + i // 2, 8 * (i % 2)), False) for u in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, succeeded boolean")
    assert lockout.lockouts(df, split_over=3).count() == 24
    assert plans and not any("FlatMapGroupsInPandas" in p for p in plans)


def test_lockout_stream_takes_shuffled_files_in_event_order(spark):
    rng = random.Random(5)
    rows = sorted(attempts(5, 300), key=lambda r: r[2])
    rows += [(8, 1000 + i, rows[0][2] + i, False) for i in range(4)] + [(8, 1004, rows[0][2] + 9, True), (9, 1005, rows[0][2], False)]
    schema = "user_id long, event_id long, m long, succeeded boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("m").cast("timestamp_ntz"))
    # a day a file, a fourth of its rows come with the next file, rows of a file in any order
    number = {r[1]: (r[2] - BASE) // (86400 * 10**6) + (rng.random() < 0.25) for r in rows}
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    for n in sorted(set(number.values())):
        ids = [i for i, k in number.items() if k == n]
        df.filter(F.col("event_id").isin(ids)).drop("m").orderBy(F.rand(n)).coalesce(1).write.mode("append").parquet(folder)
    feed = runs.parquet_stream(spark, folder, df.drop("m").schema, names="*.parquet", files_per_batch=1)
    feed, tick = runs.with_last_tick(feed, "ts", "2100-01-01 00:00:00")
    stream = lockout.lockout_stream(feed, lateness="26 hours")
    got = {r.event_id: (r.outcome, r.failed_attempts) for r in runs.run_to_parquet(stream, then=tick).collect()}
    assert got == one_by_one(rows)
    # accounts with a clean counter keep no state, nothing waits but the tick
    state = max(Path(shared_folder(spark).removeprefix("file:"), "streams").iterdir(), key=lambda p: p.stat().st_mtime) / "state"
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(state))
    held = {r["key"]["user_id"]: r["value"]["failures"] for r in read("account").collect()}
    last = {}
    for user, event, _, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        last[user] = got[event][1]
    assert held == {u: n for u, n in last.items() if n} and 8 not in held and held[9] == 1
    waiting = read("waiting").collect()
    assert {r["key"]["user_id"] for r in waiting} == {None}



def test_lockout_stream_in_buckets_of_accounts(spark):
    rng = random.Random(7)
    big = 2**53
    rows = [(big + 2 * rng.randint(0, 40) + 1, big + i, BASE + rng.randint(0, 5 * 86400) * 10**6, rng.random() < 0.2) for i in range(900)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, m long, succeeded boolean")
    df = df.select("user_id", "event_id", F.timestamp_micros("m").cast("timestamp_ntz").alias("ts"), "succeeded")
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    for day in range(6):
        part = df.filter(F.datediff("ts", F.lit("2024-01-01")) == day - F.when(F.col("event_id") % 4 == 0, 1).otherwise(0))
        part.coalesce(1).write.mode("append").parquet(folder)
    feed = runs.parquet_stream(spark, folder, df.schema, names="*.parquet", files_per_batch=1)
    feed, tick = runs.with_last_tick(feed, "ts", "2100-01-01 00:00:00")
    stream = lockout.lockout_stream(feed, lateness="50 hours", buckets=3)
    got = sorted(map(str, runs.run_to_parquet(stream, then=tick).collect()))
    state = max(Path(shared_folder(spark).removeprefix("file:"), "streams").iterdir(), key=lambda p: p.stat().st_mtime) / "state"
    held = spark.read.format("statestore").option("stateVarName", "accounts").load(str(state))
    assert 1 <= held.count() <= 3
    sent = spark.read.schema(df.schema).parquet(folder)
    assert got == sorted(map(str, lockout.lockouts(sent).collect())) and len(got) > 700


def events(spark, *minutes):
    start = datetime(2024, 1, 1, 10, 0)
    rows = [(user, i, start + timedelta(minutes=m)) for i, (user, m) in enumerate(minutes)]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_sessions_split_at_exactly_sixty_minutes(spark):
    df = events(spark, (1, 0), (1, 59), (1, 118), (1, 178), (1, 237.9), (2, 5), (2, 65))
    rows = sessions.activity_sessions(df).orderBy("user_id", "session_no").collect()
    assert [(r.user_id, r.session_no, r.events) for r in rows] == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 1)]


def test_session_stream_agrees(spark):
    rng = random.Random(2)
    df = events(spark, *[(rng.randint(1, 6), rng.randint(0, 3000)) for _ in range(300)], (9, 100000))
    stream = sessions.activity_session_stream(runs.parquet_stream(spark, written(df), df.schema, names="*.parquet"))
    closed = {tuple(r) for r in runs.run_to_parquet(stream).collect()}
    twin = {(r.user_id, r.started_at, r.last_activity, r.events) for r in sessions.activity_sessions(df).collect()}
    assert closed == {r for r in twin if r[0] != 9}


def test_fixed_sessions(spark):
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 1, 10))], "session_id string, user_id long, created_at timestamp_ntz")
    assert sessions.fixed_sessions(df, as_of="2024-01-01 10:29:59").first().is_active
    assert not sessions.fixed_sessions(df, as_of="2024-01-01 10:30:00").first().is_active


def test_rows_too_late_are_kept_apart_and_a_repeated_batch_replaces_itself(spark):
    from wardline.streaming.live import revenue_with_late

    split = revenue_with_late(f"{shared_folder(spark)}/late-{uuid.uuid4().hex}", late="1 day")

    def batch(*rows):
        df = spark.createDataFrame([(t, str(a)) for t, a in rows], "t string, a string")
        return df.select(F.col("t").cast("timestamp_ntz").alias("payment_date"), F.col("a").cast("decimal(12,2)").alias("amount_paid"))

    def state():
        totals = {str(r["day"]): (float(r["revenue"]), r["payments"]) for r in split.totals(spark).collect()}
        return totals, sorted(float(r["amount_paid"]) for r in split.too_late(spark).collect())

    first = batch(("2024-01-01 10:00:00", 1), ("2024-01-05 00:00:00", 2), ("2024-01-01 11:00:00", 4))
    second = batch(("2024-01-03 23:59:59", 8), ("2024-01-04 00:00:00", 16), (None, 32), ("2024-01-09 12:00:00", 64))
    third = batch(("2024-01-04 00:00:00", 128), ("2024-01-09 13:00:00", 256))
    split.take(first, 0)
    assert state() == ({"2024-01-01": (5.0, 2), "2024-01-05": (2.0, 1)}, [])
    split.take(second, 1)
    split.take(second, 1)
    split.take(third, 2)
    want = {"2024-01-01": (5.0, 2), "2024-01-04": (16.0, 1), "2024-01-05": (2.0, 1), "2024-01-09": (320.0, 2)}
    assert state() == (want, [8.0, 32.0, 128.0])
    split.take(third, 2)
    assert state() == (want, [8.0, 32.0, 128.0])


def test_changes_delivered_again_make_no_second_entry(spark):
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    schema = "change_id long, table_name string, operation string, record_id long, old_values string, new_values string, changed_at timestamp_ntz"

    def deliver(*ids):
        rows = [(i, "bills", "UPDATE", i % 3, None, "{}", f"2024-01-0{1 + i % 4} 08:00:00") for i in ids]
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        df.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{folder}/feed")

    def run(**options):
        feed = runs.parquet_stream(spark, f"{folder}/feed", spark.createDataFrame([], schema).schema, names="*.parquet", files_per_batch=1)
        runs.run_to_audit_log(runs.audit_stream(feed, **options), f"{folder}/log", checkpoint=f"{folder}/state")
        return sorted(r["log_id"] for r in read_audit(spark, f"{folder}/log").collect())

    deliver(1, 2, 3, 3, 2)
    deliver(3, 4, 1)
    assert run() == [1, 2, 3, 4]
    deliver(1, 5, 4)
    assert run() == [1, 2, 3, 4, 5]
    # the checkpoint is lost: the whole feed comes again
    feed = runs.parquet_stream(spark, f"{folder}/feed", spark.createDataFrame([], schema).schema, names="*.parquet")
    runs.run_to_audit_log(runs.audit_stream(feed), f"{folder}/log", checkpoint=f"{folder}/state2")
    entries = read_audit(spark, f"{folder}/log").collect()
    assert sorted(r["log_id"] for r in entries) == [1, 2, 3, 4, 5]
    assert {r["log_id"]: r["changed_on"].day for r in entries} == {i: 1 + i % 4 for i in range(1, 6)}


def test_a_delivery_is_compared_by_its_numbers_alone(spark, monkeypatch):
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    seen, one = [], sinks.cut
    monkeypatch.setattr(sinks, "cut", lambda df: seen.append(df.columns) or one(df))

    def deliver(*entries):
        rows = [(i, "bills", "UPDATE", i, None, text, None, f"2024-01-0{1 + (i or 0) % 4} 08:00:00") for i, text in entries]
        schema = "log_id long, table_name string, operation string, record_id long, old_values string, new_values string, changed_by long, changed_at string"
        df = spark.createDataFrame(rows, schema).coalesce(1).withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))
        sinks.append_audit(df, path, once=True)
        return sorted((r["log_id"] or 0, r["new_values"]) for r in read_audit(spark, path).collect())

    assert deliver((1, "a"), (2, "a")) == [(1, "a"), (2, "a")]
    assert deliver((3, "b"), (1, "b"), (3, "c"), (5, "b")) == [(1, "a"), (2, "a"), (3, "b"), (5, "b")]
    # entries without a number are one a delivery, as before
    assert deliver((None, "d"), (None, "e"), (5, "d")) == [(0, "d"), (1, "a"), (2, "a"), (3, "b"), (5, "b")]
    assert deliver((2, "f")) == deliver((2, "g"), (1, "g")) == [(0, "d"), (1, "a"), (2, "a"), (3, "b"), (5, "b")]
    assert deliver((None, "h"))[:2] == [(0, "d"), (0, "h")]
    assert all(columns == ["_row"] for columns in seen[1::2]) and len(seen) == 12


def test_micro_batches_take_a_share_of_the_files(spark):
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    feed = spark.range(90)
    feed.repartition(9).write.parquet(folder)
    h = SimpleNamespace(spark=spark)
    stream = others._in_batches(h, folder, feed)
    counts = []
    query = stream.writeStream.foreachBatch(lambda batch, _: counts.append(batch.count())).trigger(availableNow=True)
    query.option("checkpointLocation", f"{folder}-state").start().awaitTermination()
    assert sum(counts) == 90 and len([c for c in counts if c]) == 3
