"""Every labelled language is learned, however many there are."""

import random

from wardline.llm import langid


def test_eighty_languages(spark):
    rng = random.Random(4)
    words = {f"l{n:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 6))) for _ in range(5)] for n in range(80)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 80:02d}"]) for _ in range(40)), f"l{i % 80:02d}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for total, share in ((1 << 15, 20), (400, 5), (10, 1)):
        _, labels = langid.sample(docs, langid.F.lit(True), total=total)
        assert set(labels) == set(words)
        assert max(labels.count(name) for name in words) <= 4 * share
    found = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs).collect()}
    assert set(found.values()) == set(words)
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)
