"""op8: a passage in many surroundings deals out few strings, and removes the same bytes."""

import random

from wardline.llm import repeats


def test_settled_strings_go_on_as_runs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = word(120)
    texts = [word(60) + passage + word(60) for _ in range(150)] + [word(40) + passage[30:75] + word(40) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = []
    seen = set()
    for text in texts:
        mine, gone = {text[i : i + 50] for i in range(len(text) - 49)}, set()
        for i in range(len(text) - 49):
            if text[i : i + 50] in seen:
                gone.update(range(i, i + 50))
        seen |= mine
        want.append("".join(c for i, c in enumerate(text) if i not in gone))
    rows, one = [], repeats.keep
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 20)
    monkeypatch.setattr(repeats, "keep", lambda df: (found := one(df), "gone" in df.columns and rows.append(found.count()))[0])
    got = {r["doc_id"]: r["kept"].decode() for r in repeats.removed(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    contexts = sum(len(t) for t in texts)
    assert 0 < rows[0] < contexts / 6, rows
