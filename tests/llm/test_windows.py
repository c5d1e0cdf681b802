"""op8: only strings whose window stands in two documents are compared, and the same bytes go."""

import random

from pyspark.sql import functions as F

from wardline.llm import repeats


def brute(texts):
    seen, out = set(), []
    for text in texts:
        mine, gone = {text[i : i + 50] for i in range(len(text) - 49)}, set()
        for i in range(len(text) - 49):
            if text[i : i + 50] in seen:
                gone.update(range(i, i + 50))
        seen |= mine
        out.append("".join(c for i, c in enumerate(text) if i not in gone))
    return out


def asked(docs):
    met = repeats._meet(repeats._send(repeats._keyed(docs), 4, 50, 16), 50, 16).filter("kind > 0")
    return met.select(F.explode(F.arrays_zip("starts", "ends")).alias("z")).agg(F.expr("coalesce(sum(z.ends - z.starts - 49), 0)")).first()[0]


def test_short_passages_and_repeats_of_one_document_are_not_compared(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrases, passage = [word(34) for _ in range(20)], word(90)
    short = [word(60) + phrases[i % 20] + word(60) for i in range(600)]
    alone = ["".join(word(60) + passage for _ in range(30)) + word(60)]
    for texts in (short, alone):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert asked(docs) == 0
        got = {r["doc_id"]: r["kept"].decode() for r in repeats.removed(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts) == texts


def test_every_cell_of_a_shared_passage_is_compared(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 55, 61, 70, 84, 100)]
    texts = [word(rng.randrange(40)) + passages[i % 8] + word(rng.randrange(40)) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for limit in (0, 5, 1_000):
        monkeypatch.setattr(repeats, "HOT_CONTEXTS", limit)
        got = {r["doc_id"]: r["kept"].decode() for r in repeats.removed(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)
