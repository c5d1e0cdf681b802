"""Moves against the rule taken one by one."""

import random

import pytest

from wardline.plans import moves
from wardline.plans.moves import admit_moves


def one_by_one(rows, holders):
    """rows: (id, ts, owner, place); holders: (owner, place). Ids of the admitted moves."""
    at, out = {}, []
    for o, p in holders:
        at.setdefault(o, []).append(p)
    for i, ts, o, p in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(p not in places for other, places in at.items() if other != o):
            at[o] = [p]
            out.append(i)
    return sorted(out)


def run(spark, rows, holders, last=0):
    asked = spark.createDataFrame(rows, "id long, ts long, owner long, place long").repartition(5)
    held = spark.createDataFrame(holders, "owner long, place long")
    got = admit_moves(asked, held, place=["place"], owner="owner", order=["ts", "id"], row_id="id", last=last)
    return sorted(r["id"] for r in got.collect())


@pytest.mark.parametrize(("seed", "last"), [(1, 0), (2, 70), (3, 10**6)])
def test_random_batches(spark, seed, last):
    rng = random.Random(seed)
    owners, places = [(40, 45), (60, 50)][seed % 2]
    holders = [(o, o) for o in range(owners)] + ([(200, 1), (201, 2), (202, 2)] if seed % 2 else [])
    rows = [(i, rng.randint(0, 150), rng.choice([rng.randrange(owners), 0, 201]), rng.choice([rng.randrange(places), 1, 2])) for i in range(110)]
    assert run(spark, rows, holders, last) == one_by_one(rows, holders)


def test_chains_swaps_and_rings(spark, monkeypatch):
    rounds = []
    one = moves._round
    monkeypatch.setattr(moves, "_round", lambda *a: rounds.append(1) or one(*a))
    n = 3000
    # n owners move up by one place, the last one first: all of them can, as the one before has just left
    chain = [(i, n - i, i, i + 1) for i in range(n)]
    holders = [(i, i) for i in range(n)]
    assert run(spark, chain, holders) == list(range(n))
    assert len(rounds) <= 2
    # the same with the last place held: nobody can
    rounds.clear()
    assert run(spark, chain, [*holders, (n, n)]) == []
    assert len(rounds) <= 2
    # in the other order only the last one can; and a ring never moves
    assert run(spark, [(i, i, i, i + 1) for i in range(n)], holders) == [n - 1]
    rounds.clear()
    ring = [(i, rank, i, (i + 1) % 50) for rank, i in enumerate(random.Random(1).sample(range(50), 50))]
    assert run(spark, ring, [(i, i) for i in range(50)]) == []


def test_a_wanted_place_that_changes_hands(spark):
    # owner k takes place 0, then leaves to place 100 + k; everybody else asks in between
    rows = []
    for k in range(1, 3):
        rows += [(1000 * k + j, 100 * k + j, 50 + j, 0) for j in range(20)]
        rows += [(10 * k, 100 * k - 5, k, 0), (10 * k + 1, 100 * k + 70, k, 100 + k)]
    holders = [(o, 500 + o) for o in range(100)]
    assert run(spark, rows, holders) == one_by_one(rows, holders)
    assert run(spark, [], holders) == run(spark, [], holders, 9) == []


def test_many_small_components_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(moves, "_round", lambda *a: pytest.fail("a round"))
    rng = random.Random(11)
    # 40 groups of 5 owners whose 6 places change hands often; owners alone; a place with two holders
    holders = [(10 * g + o, 10 * g + o) for g in range(40) for o in range(5)] + [(9000 + g, 10 * g) for g in range(3)]
    rows = []
    for i in range(1200):
        g = rng.randrange(40)
        rows.append((i, rng.randint(0, 400), 10 * g + rng.randrange(5), 10 * g + rng.randrange(6)))
    rows += [(5000 + i, i, 7000 + i, 8000 + i) for i in range(30)]
    assert run(spark, rows, holders, 60) == one_by_one(rows, holders)


def test_small_components_beside_a_large_one(spark):
    rng = random.Random(12)
    holders = [(o, o) for o in range(30)] + [(100 + o, 100 + o) for o in range(40)]
    rows = [(i, rng.randint(0, 90), rng.randrange(30), rng.randrange(32)) for i in range(90)]
    rows += [(500 + i, rng.randint(0, 90), 100 + 4 * (i % 10) + rng.randrange(4), 100 + 4 * (i % 10) + rng.randrange(4)) for i in range(90)]
    assert run(spark, rows, holders, 30) == one_by_one(rows, holders)
