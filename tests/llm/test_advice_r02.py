"""Cases of the second round's advice, against brute force on small fixtures."""

import itertools
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import decontaminate, repeats


def linked_away(rows, k, percent):
    """doc_ids that links of word shingles join to a smaller one."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\S+", text.lower())
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)})
    label = {i: i for i, _ in rows}
    for (i, s), (j, t) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets)], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            a, b = label[i], label[j]
            label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    return {i for i, y in label.items() if i != y}


def test_pipeline_links_five_words_at_four_fifths(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 900))
    base = [f"v{i}" for i in range(50)]
    texts = [" ".join(base), " ".join([*base[:25], "other", *base[26:]])]  # 41 of 51 shingles of five words
    for _ in range(15):
        one = [word() for _ in range(rng.choice([4, 6, 20, 50, 90]))]
        texts.append(" ".join(one))
        for _ in range(3):
            copy = list(one)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(3), "")
    gone = linked_away(rows, 5, 80)
    assert 1 in gone and gone != linked_away(rows, 4, 85)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - gone


def test_templates_leave_out_only_what_clashes(spark):
    altered = "She gave 9 cups to Ann before noon and two of them went from Ann back to the old shelf near the door."
    sums = "Please work out how much 12 plus 7 makes and say what 12 minus 7 makes."
    names = "We saw Ann and Bob with Eve in Rome near Oslo where Max met Ann and Bob."
    fives = sums.replace("12", "5").replace("7", "5")
    mixed = names.replace("Ann", "Pia").replace("Bob", "bob").replace("Oslo", "oslo")
    clash = "Please work out how much 3 plus 4 makes and say what 8 minus 9 makes."
    texts = [altered.replace("to Ann", "to Ana"), fives, names.lower(), names.upper(), mixed, clash, "please say nothing of cups, shelf, Ann or Bob"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, altered), (2, sums), (3, names)], "item_id long, text string")
    for few in (1_000_000, 3):
        decontaminate.BROADCAST_WINDOWS, before = few, decontaminate.BROADCAST_WINDOWS
        try:
            got = {r["doc_id"]: r["item_ids"] for r in decontaminate.verdicts(docs, bench).collect()}
            shares = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.hits(docs, bench).collect()}
        finally:
            decontaminate.BROADCAST_WINDOWS = before
        assert got == {0: "1", 1: "2", 2: "3", 3: "3", 4: "3", 5: "", 6: ""}
        # five windows hold the altered name
        n = len(altered.split()) - 4
        assert shares[0, 1] == (n - 5) / n and shares[1, 2] == shares[2, 3] == shares[3, 3] == shares[4, 3] == 1


def test_a_passage_in_many_surroundings_is_no_single_part(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(150)
    texts = [noise(rng.randint(30, 80)) + passage[rng.choice([0, 0, 0, 9]) :] + noise(rng.randint(30, 80)) for _ in range(300)]
    rows = [(rng.choice([i, i, i // 2]), t) for i, t in enumerate(texts)] + [(7, texts[4]), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 40, raising=False)
    sizes, contexts = [], repeats._contexts

    def watched(*args):
        out = repeats.keep(contexts(*args))
        sizes.extend(r[1] for r in out.groupBy("range").agg(F.sum(F.size("ids"))).collect())
        return out

    monkeypatch.setattr(repeats, "_contexts", watched)
    got = sorted((r["doc_id"] is None, r["doc_id"], bytes(r["kept"])) for r in repeats.removed(docs).collect() if r["doc_id"] is not None)
    first = {}
    for i, t in sorted(rows[:-1]):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    want = []
    for i, t in rows[:-1]:
        gone = {x for j in range(len(t) - 49) if first[t[j : j + 50]] < i for x in range(j, j + 50)}
        want.append((False, i, "".join(c for x, c in enumerate(t) if x not in gone).encode()))
    assert got == sorted(want)
    assert max(sizes, default=0) <= 2 * 40
