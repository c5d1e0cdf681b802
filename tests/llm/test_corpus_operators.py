"""Joins, chats, archives, repeats, decontamination and the pipeline against brute force on small fixtures."""

import collections
import gzip
import hashlib
import itertools
import os
import random
import re
import string

import pytest

import corpus_pipeline
from wardline.llm import catalog, chat, decontaminate, repeats, shingle_join, warc

DATA = os.environ.get("TESTDATA", "/root/testdata")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_sets(rows, k=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return sets


def brute_components(rows, percent=85):
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets)], 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha Beta gamma delta é-x zeta eta".split()) + str(rng.randint(0, 30))
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "A b C d"]
    common = [word() for _ in range(20)]  # a passage that many documents share
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 7, 9, 12, 30, 60, 120]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, label int")
    got = shingle_join.near_duplicates(df.repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert shingle_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "only here"), (7, None)]
    got = sorted(shingle_join.near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 1, None), (7, 0, 7)], key=lambda r: f"Row(doc_id={r[0]}, n_shingles={r[1]}, component_id={r[2]})")


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (50, 100)]
    labels = dict(tuple(r) for r in shingle_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {labels[i] for i in range(41)} == {0} and {labels[i] for i in (98, 99, 100, 50)} == {50}


def least_cost(roles):
    best = [10**9]

    def go(i, state, cost, spare):
        if cost >= best[0]:
            return
        if i == len(roles) and state in (None, "assistant"):
            best[0] = cost
            return
        if i < len(roles):
            if state:
                go(i + 1, state, cost + chat.MERGE + chat.RELABEL * (state != roles[i]), 3)
            for x in chat._NEXT[state]:
                go(i + 1, x, cost + chat.RELABEL * (x != roles[i]), 3)
        if spare:
            for x in chat._NEXT[state]:
                go(i, x, cost + chat.INSERT, spare - 1)

    go(0, None, 0, 3)
    return best[0]


def test_repairs_are_cheapest_and_legal():
    for k in range(5):
        for roles in itertools.product((*chat.ROLES, None), repeat=k):
            cost, turns, merged, inserted, relabelled = chat.repair(roles)
            assert cost == least_cost(roles) == chat.MERGE * merged + chat.INSERT * inserted + chat.RELABEL * relabelled
            written = [r for r, _ in turns]
            assert all(b in chat._NEXT[a] for a, b in zip([None, *written], written)) and written[-1:] in ([], ["assistant"])
            assert [i for _, held in turns for i in held] == list(range(k))


def test_chats(spark):
    rows = [(1, 2, "assistant", "B"), (1, 1, "user", "A"), (2, 0, "user", None), (2, 1, "user", "x <|im_end|>"), (3, None, "bot", "q"), (None, 0, "user", "n"), (None, 0, "user", "n"), (1, 2, "assistant", "B")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    got = sorted(chat.format_chats(df).collect(), key=str)
    one = next(r for r in got if r["conv_id"] == 1)
    # the second B costs as much to append under a user turn as to merge; the cheapest is one merge
    assert (one["n_turns"], one["cost"], one["n_merged"], one["roles"]) == (3, 1, 1, "user,assistant")
    assert one["rendered"] == "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\nB\nB<|im_end|>\n"
    two = next(r for r in got if r["conv_id"] == 2)
    assert "x < |im_end| >" in two["rendered"] and two["rendered"].count("<|im_end|>") == two["n_rendered"]
    assert sum(r["conv_id"] is None for r in got) == 2 and len(got) == 5
    assert chat.format_chats(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, payload string"


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n", "b", "b"]
    rows = [(i, None if i == 2 else f"http://x/{i} é\r\n", h, "clash") for i, h in enumerate(html)] + [(None, "u", "b", None), (7, "u", "b", None)]
    folder = str(tmp_path / "warc")
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    warc.write_archives(pages, folder, min_bytes=1, per_file=2)
    got = warc.read_archives(spark, folder).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows)
    for r in got:
        text = "b" if r["page_id"] is None else html[r["page_id"]] or ""
        data = text.encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.digest(data)
        revisit = r["page_id"] is not None and len(data) >= 1 and first[text] != r["page_id"]
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (first[text] if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == data
    files = [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part-")]
    assert len(files) > 3
    for path in files:
        members = list(warc.inflated(path.read_bytes(), step=7))
        assert len(members) <= 2 and gzip.decompress(path.read_bytes()) == b"".join(m for _, m in members)


def test_large_and_damaged_records(spark):
    big = warc.record(1, "u", bytes(17 << 20), None, "2024-01-01T00:00:00Z")
    packed = warc.member(big)
    assert packed[-1] == 0 and [m for _, m in warc.inflated(packed + warc.member(b"x"))] == [big, b"x"]
    good = warc.record(1, "u", b"hello", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"hello"
    for bad in (good.replace(b"hello", b"hullo"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.inflated(warc.member(good)[:-9]))
    empty = spark.createDataFrame([], PAGES)
    assert warc.round_trip(empty).count() == 0


def brute_repeats(rows, length):
    coded = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted((x for x in coded if x[0] is not None), key=lambda x: x[0]):
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    out = []
    for i, b in coded:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1 if i is not None else 0):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gram", [(50, 16), (20, 8), (12, 5)])
def test_repeats_equal_brute_force(spark, length, gram, monkeypatch):
    rng = random.Random(length)
    noise = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(200, "abcdefgh ") for _ in range(4)]
    rows = []
    for i in range(70):
        text = ""
        for _ in range(rng.randint(0, 4)):
            kind, at = rng.random(), rng.randint(0, 150)
            text += rng.choice(passages)[at : at + rng.randint(10, 120)] if kind < 0.5 else "a" * rng.randint(0, 150) if kind < 0.7 else noise(rng.randint(0, 80), "é abcdefghijklmnop")
        rows.append((rng.choice([i, i, i, i // 2, None]), None if rng.random() < 0.05 else text))
    rows += rows[:6]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, starts int").repartition(3)
    found = repeats.removed(df, length, gram).collect()
    got = sorted(
        [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found],
        key=str,
    )
    assert got == brute_repeats(rows, length)


def test_long_texts_are_walked_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    walker = repeats.Walker(50, 16)
    monkeypatch.setattr(repeats, "PIECE", 700)
    import numpy as np

    with np.errstate(over="ignore"):
        data, ends = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        spots = [s for part in walker.texts(data, ends) for a, m in zip(part[5], part[7]) for s in range(a, a + m + 1)]
    assert sorted(spots) == list(range(len(text) - 49))


def test_repeats_of_the_test_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in catalog.QUERIES["op8_suffix_repeats"](spark, f"{DATA}/sf0.001").collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 50)
    assert repeats.report(docs.limit(0)).count() == 0


ITEM = "The train from Paris left at 10:30 and ran 300 km in 4 hours without a stop before Lyon came into view."


def test_decontamination_of_templates(spark):
    other = ITEM.replace("Paris", "Berlin").replace("10:30", "7:15").replace("300", "450").replace("4 ", "6 ").replace("Lyon", "Hamburg")
    mixed = " ".join(ITEM.split()[:8]) + " and Rome left at 9 and ran"
    twice = "He paid 5 dollars to Ann, then 5 dollars to Ann again, and 5 dollars were all that Ann had got by then."
    steady = twice.replace("5", "8").replace("Ann", "Bob")
    unsteady = twice.replace("5 dollars to Ann,", "8 dollars to Bob,").replace("then 5", "then 9").replace("and 5", "and 7")
    texts = [f"Some words before. {ITEM} And more after.", f"Words.\n{other}", "entirely different words in here, nothing of that", mixed, steady, unsteady, None, "", "tiny item", "so it is a tiny item here", ITEM.upper().replace("PARIS", "Paris").replace("LYON", "Lyon")]
    items = [(1, ITEM), (2, twice), (3, None), (4, ""), (5, "tiny item"), (None, "entirely different words in here, nothing of that")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, ITEM, 0)], "doc_id long, text string, share int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.verdicts(docs, bench).collect()}
    assert got == {0: (True, "1"), 1: (True, "1"), 2: (False, ""), 3: (False, ""), 4: (True, "2"), 5: (False, ""), 6: (False, ""), 7: (False, ""), 8: (True, "5"), 9: (True, "5"), 10: (True, "1"), None: (False, "")}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).filter("doc_id is not null").collect()) == [2, 3, 5, 6, 7]
    assert decontaminate.verdicts(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.verdicts(docs.limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    path = f"{DATA}/sf0.001"
    usual = sorted(tuple(r) for r in catalog.QUERIES["op9_benchmark_templates"](spark, path).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 3)
    assert sorted(tuple(r) for r in catalog.QUERIES["op9_benchmark_templates"](spark, path).collect()) == usual
    # whole items stand in the texts: a plain search finds the same documents
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    words = lambda t: " ".join(w.strip(".,;:!?").lower() for w in t.split())
    items = [words(r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    plain = {i for i, t in docs.items() if any(x in words(t) for x in items)}
    assert plain <= {r[0] for r in usual if r[1]}


def test_pipeline(spark):
    path = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.keep(stage(spark, frames[-1], path)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "encode"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert all(after <= before for before, after in zip(kept, kept[1:])) and len(kept[1]) > 0.9 * len(kept[0])
    second = [(r["doc_id"], r["text"]) for r in frames[1].collect()]
    assert kept[2] == {i for i, _, c in brute_components(second) if i == c}
    masked = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    assert not any(re.search(r"[\w.]+@\w+\.\w+", t) for t in masked.values())
    final = frames[5].collect()
    assert {r["doc_id"]: r["text"] for r in final} == masked and all(len(r["ids"]) == r["n_tokens"] for r in final)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.keep(stage(spark, empty, path))
    assert empty.count() == 0


def test_names_and_registration():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and collections.Counter(numbers).most_common(1)[0][1] == 1
