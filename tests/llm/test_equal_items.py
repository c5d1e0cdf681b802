"""Many equal benchmark items: their windows are rows, whatever their hashes."""

from wardline.llm import decontaminate


def test_rows_not_hashes_bound_the_broadcast(spark, monkeypatch):
    text = "Please work out how much 12 plus 7 makes and say what 12 minus 7 makes."
    bench = spark.createDataFrame([(i, text) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Well. " + text.replace("12", "30")), (2, "nothing of that kind here"), (3, None)], "doc_id long, text string")
    want = {1: ",".join(map(str, range(60))), 2: "", 3: ""}
    hashes = decontaminate._rows(bench, "item_id", [1, 2, 3, 4, 5], None, True).select("h").distinct().count()
    plans = {}
    for limit in (1_000_000, hashes, 3):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        got = decontaminate.verdicts(docs, bench)
        assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == want
        joined = []
        kept = decontaminate.keep
        monkeypatch.setattr(decontaminate, "keep", lambda df: (joined.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
        decontaminate.hits(docs, bench)
        monkeypatch.setattr(decontaminate, "keep", kept)
        plans[limit] = "BroadcastHashJoin" in joined[-1]
    assert plans == {1_000_000: True, hashes: False, 3: False}
