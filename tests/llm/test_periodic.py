"""Periodic runs of words against brute force."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from wardline.llm import periodic


def brute_runs(words, least=12):
    """All runs by their definition: (start, length, period)."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode()) & 0xFFFFFFFF
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def some_words(rng):
    kind = rng.randrange(5)
    words = [rng.randrange(rng.choice([1, 2, 3, 30, 400])) for _ in range(rng.randrange(0, 90))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randint(1, 25))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 9)[: rng.randint(len(unit), len(unit) * (2 + kind))]
    if kind == 4 and words:
        words[rng.randrange(len(words))] = 7
    return words


@pytest.mark.parametrize("least", [12, 2, 5, 40])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    texts = [some_words(rng) for _ in range(250)] + [[], [1], [3] * 500, [1, 2, 2] * 90, [0, 1, 1, 0, 1, 0, 0, 1] * 40]
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    texts += [thue, b, b[::-1] + b]
    ends = np.cumsum([0, *map(len, texts)])
    got = [[] for _ in texts]
    for i, *r in zip(*(x.tolist() for x in periodic.runs_of(np.array(sum(texts, []), np.int64), ends, least))):
        got[i].append(tuple(r))
    for t, found in zip(texts, got):
        assert found == brute_runs(t, least), t


def test_hashes_that_agree_by_chance_are_noticed(monkeypatch):
    rng = random.Random(5)
    texts = [some_words(rng) for _ in range(60)]
    ends = np.cumsum([0, *map(len, texts)])
    hashes = periodic.Scan.hashes
    monkeypatch.setattr(periodic.Scan, "hashes", lambda self, a, b: hashes(self, a, b) & np.uint64(1))
    got = [[] for _ in texts]
    for i, *r in zip(*(x.tolist() for x in periodic.runs_of(np.array(sum(texts, []), np.int64), ends))):
        got[i].append(tuple(r))
    assert got == [brute_runs(t) for t in texts]


def test_rare_words_split_until_nothing_changes():
    # 9 is too far from its like, 5 has none; then 1 and 2 have none in the first piece
    words = np.array([1, 2, 9, 1, 2, 1, 2, 5, 3, 3, 3, 9, 3, 3])
    starts, lengths = periodic.segments(words, np.array([0, len(words)]), 2)
    assert list(zip(starts.tolist(), lengths.tolist())) == [(3, 4), (8, 3), (12, 2)]


def test_report_equals_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "one", "a b c d " * 12, "x\ty\x0bz\n" * 30, "é " * 40, " ".join(map(str, some_words(rng))) * 2]
    texts += [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(5, texts[4]), (5, texts[4]), (None, "r s " * 20), (-3, "q " * 30), (2**40, "t u v " * 30)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, runs string").repartition(5)
    got = sorted(map(tuple, periodic.report(docs).collect()), key=str)
    assert got == sorted((brute_report(i, t) for i, t in rows), key=str)
    assert any(crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_one_long_text_and_no_text(spark):
    rng = random.Random(2)
    unit = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    text = " ".join(unit * 4 + ["end"] + ["so"] * 50_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic.periodic_runs(docs, ["doc_id"]).collect()[0]
    assert [tuple(r) for r in row["runs"] if r["length"] > 20] == [(0, 120_000, 30_000), (120_001, 50_000, 1)]
    assert row["collapsed"].split(" ") == unit + ["end", "so"]
    assert periodic.report(docs.filter("false")).collect() == []


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, periodic.report(docs).collect()))
    short = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 12_000}
    assert len(got) == docs.count()
    assert [r for r in got if r[0] in short] == sorted(brute_report(i, t) for i, t in short.items())
