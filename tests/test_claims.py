"""Claims of several unique keys against the rule taken one by one."""

import random

import pytest

from wardline.plans import claims
from wardline.plans.claims import admit_claims


def one_by_one(rows):
    """rows: (id, ts, a, b, c). Ids of the admitted requests."""
    taken, out = set(), []
    for i, ts, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        wanted = {(kind, key) for kind, key in enumerate(keys) if key is not None}
        if taken.isdisjoint(wanted):
            taken |= wanted
            out.append(i)
    return sorted(out)


def run(spark, rows, last=0, keys=("a", "b", "c")):
    asked = spark.createDataFrame(rows, "id long, ts long, a string, b long, c string, key_0 string").repartition(5)
    return sorted(r["id"] for r in admit_claims(asked, keys=keys, order=["ts", "id"], row_id="id", last=last).collect())


@pytest.mark.parametrize(("seed", "last"), [(1, 0), (2, 0), (3, 40), (4, 10**6)])
def test_random_batches(spark, seed, last):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        a = rng.choice(["hot", f"a{rng.randrange(60)}", f"a{rng.randrange(60)}"])
        b = rng.choice([None, rng.randrange(70), rng.randrange(70)])
        c = rng.choice([None, None, f"c{rng.randrange(30)}", ""])
        rows.append((i, rng.randint(0, 50), a, b, c))
    assert run(spark, [(*r, "extra") for r in rows], last) == one_by_one(rows)


@pytest.fixture
def rounds(monkeypatch):
    """Number of rounds and of doubling steps so far."""
    seen, one, many = {"rounds": 0, "steps": 0}, claims._round, claims.cut
    monkeypatch.setattr(claims, "_round", lambda *a: seen.update(rounds=seen["rounds"] + 1) or one(*a))
    monkeypatch.setattr(claims, "cut", lambda df: seen.update(steps=seen["steps"] + ("turned" in df.columns)) or many(df))
    return seen


def chain(n, ts):
    """Request i has its phone in common with one neighbour and its e-mail with the other."""
    return [(i, ts(i), f"p{(i + 1) // 2}", i // 2, None, None) for i in range(n)]


def test_a_chain_of_ten_thousand(spark, rounds):
    n = 10_000
    assert run(spark, chain(n, lambda i: i)) == list(range(0, n, 2))
    assert rounds["rounds"] <= 2 and rounds["steps"] <= 20


def test_a_chain_in_any_order(spark, rounds):
    n = 2000
    at = random.Random(5).sample(range(n), n)
    rows = chain(n, lambda i: at[i])
    assert run(spark, rows) == one_by_one([r[:5] for r in rows])
    assert rounds["rounds"] <= 3


def test_one_key_wanted_by_everybody(spark, rounds):
    rows = [(i, 3000 - i, "same", i, None, None) for i in range(3000)]
    assert run(spark, rows) == [2999]
    assert rounds["rounds"] == 1


def test_nothing_claimed_ties_and_no_rows(spark):
    rows = [(1, 5, None, None, None, None), (2, 5, None, None, None, None), (3, 5, "x", None, None, None), (4, 5, "x", 9, None, None)]
    for last in (0, 100):
        assert run(spark, rows, last) == [1, 2, 3]
        assert run(spark, [], last) == []
    assert run(spark, rows, keys=("b",)) == [1, 2, 3, 4]
