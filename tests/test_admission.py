import random

import pytest

from wardline.plans.admission import admit_in_order


def brute(rows, slack):
    """Sequential rule, one row at a time."""
    left, untouched, out = {}, {}, {}
    for key, ts, rid, units, room in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        have = left.setdefault(key, room)
        fresh = untouched.setdefault(key, True)
        used = room - have
        ok = units is not None and units > 0 and units <= have + slack and (have > 0 or fresh)
        out[rid] = (ok, used)
        if ok:
            left[key] = have - units
            untouched[key] = False
    return out


def sample(seed, keys, n):
    rng = random.Random(seed)
    rooms = {k: rng.choice([0, 1, 2, 7, 50, 400, 3000, 10**6]) for k in range(keys)}
    rows = []
    for rid in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        shape = rng.random()
        units = rng.randint(-2, 3) if shape < 0.3 else rng.randint(1, max(1, rooms[key] // rng.choice([1, 2, 9, 40]) + 1))
        rows.append((key, rng.randint(0, n // 2), rid, None if shape > 0.98 else units, rooms[key]))
    return rows


@pytest.mark.parametrize(("fold_limit", "slack"), [(0, 1), (5, 0), (100000, 1)])
def test_matches_sequential_rule(spark, fold_limit, slack):
    rows = sample(11 + slack, 9, 1200)
    df = spark.createDataFrame(rows, "k long, ts long, rid long, units long, room long").repartition(6)
    got = admit_in_order(
        df, key="k", order=("ts", "rid"), row_id="rid", units="units", room="room", slack=slack, fold_limit=fold_limit
    ).collect()
    assert {r.rid: (r.admitted, r.used_before) for r in got} == brute(rows, slack)


def test_one_key_holds_everything(spark):
    rng = random.Random(5)
    rows = [(1, i, i, rng.choice([1, 3, 40, 90, 200, 350]), 1000) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, ts long, rid long, units long, room long").repartition(8)
    got = admit_in_order(
        df, key="k", order=("ts", "rid"), row_id="rid", units="units", room="room", fold_limit=10
    ).collect()
    assert {r.rid: (r.admitted, r.used_before) for r in got} == brute(rows, 0)


@pytest.mark.parametrize("fold_limit", [0, 6, 100000])
def test_values_close_with_the_first_admitted_request(spark, fold_limit):
    rng = random.Random(fold_limit)
    rows = [(*r, 100 * r[0] + rng.randrange(12)) for r in sample(3, 7, 700)]
    left, closed, want = {}, set(), {}
    for key, ts, rid, units, room, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        have = left.setdefault(key, room)
        ok = units is not None and 0 < units <= have and value not in closed
        want[rid] = (ok, room - have, value in closed)
        if ok:
            left[key] = have - units
            closed.add(value)
    df = spark.createDataFrame(rows, "k long, ts long, rid long, units long, room long, v long").repartition(6)
    got = admit_in_order(
        df, key="k", order=("ts", "rid"), row_id="rid", units="units", room="room", fold_limit=fold_limit, once="v"
    ).collect()
    assert {r.rid: (r.admitted, r.used_before, r.closed) for r in got} == want
