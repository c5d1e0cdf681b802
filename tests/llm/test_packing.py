"""Packing against brute force: combinations, whole plans, ids of whole texts, gapless sequences."""

import functools
import itertools
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from wardline.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def test_combination_is_the_fullest():
    rng = random.Random(4)
    for _ in range(300):
        room = rng.randint(0, 40)
        lengths = [rng.randint(1, 25) for _ in range(rng.randint(0, 9))]
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
        total, taken = packing.combination(histogram(lengths, 50), room)
        assert total == best == sum(a * b for a, b in taken)
        assert all(Counter(lengths)[a] >= b for a, b in taken)


def test_plan_equals_bins_filled_one_by_one():
    rng = random.Random(9)
    for _ in range(40):
        lengths = [rng.choice([rng.randint(1, 64), 20, 7]) for _ in range(rng.randint(0, 120))]
        plan = packing.planned(histogram(lengths, 64), 64)
        bins = [parts for times, parts in plan for _ in range(times)]
        left, alone = Counter(lengths), []
        while left := +left:
            counts = histogram(list(left.elements()), 64)
            top = max(left)
            counts[top] -= 1
            one = Counter(dict(packing.combination(counts, 64 - top)[1])) + Counter([top])
            alone.append(sorted(one.items(), reverse=True))
            left -= one
        assert bins == alone
        assert Counter(x for b in bins for l, m in b for x in [l] * m) == Counter(lengths)


def check_packed(rows, capacity):
    """rows: (sequence, offset, length); returns the number of sequences."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_many_tasks(spark, capacity):
    rng = random.Random(capacity)
    lengths = [rng.choice([rng.randint(1, capacity), min(capacity, 1 + int(rng.expovariate(8 / capacity))), capacity // 3]) for _ in range(4000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long").repartition(7)
    rows = packing.pack(pieces, capacity=capacity).collect()
    assert sorted((r["k"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert n <= -(-sum(lengths) // capacity) * 1.01 + 2
    assert packing.pack(pieces.filter("false"), capacity=capacity).collect() == []
    with pytest.raises(Exception, match="lengths have to be"):
        packing.pack(spark.createDataFrame([(1, capacity + 1)], "k long, length long"), capacity=capacity).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZzİ́éßΣς .,'’—|<>!1٣\t\n  "), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_chunks_give_the_ids_of_whole_texts(texts):
    check_ids([*texts, " ".join(texts), "".join(texts)])


@functools.cache
def tokenizers():
    with open(FILE, encoding="utf-8") as file:
        return Tokenizer.from_file(FILE), packing.Chunks(file.read())


def check_ids(texts):
    whole, chunks = tokenizers()
    ids, counts = chunks.encode(texts)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_special_and_odd_texts():
    check_ids(["a<|endoftext|>b", "A<|ENDOFTEXT|>,b.", "x <|startoftext|>", "<|endof text|>", "We'Ll it's O'Re.", "é.̸=x", "İ,", "ab.́c", "", " \n"])


def test_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [tuple(r) for r in docs] + [(7, docs[3]["text"]), (7, docs[3]["text"]), (None, "one two"), (-1, None), (-2, ""), (-3, "ab. cd " * 6000)]
    df = spark.createDataFrame([(t, i, 3) for i, t in texts], "text string, doc_id long, offset int").repartition(6)
    rows = packing.report(df, FILE).collect()
    whole = Tokenizer.from_file(FILE)
    want = []
    for i, t in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096 : (p + 1) * 4096]
            want.append((i, p, p * 4096, len(part), crc32(np.array(part, "<u4").tobytes())))
    got = [tuple(r)[:5] for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    n = check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1


def test_ids_are_carried(spark):
    df = spark.createDataFrame([(1, "one two three " * 5), (2, None)], "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(df, ["doc_id"], FILE, capacity=6), capacity=6).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        by[r["doc_id"]] += r["ids"]
    assert by == {1: Tokenizer.from_file(FILE).encode("one two three " * 5, add_special_tokens=False).ids + [1], 2: [1]}
