"""The counts of op4 are those of its spans, whatever kinds a text has and in which order."""

import tracemalloc

from pyspark.sql import functions as F

from lodestone.llm import pii_sanitiser


def test_counts_are_of_kinds(spark):
    texts = ["+49 30 1234567 then 10.0.0.1 and 10.0.0.2", "a@b.co c@d.org +1 555 123 4567", "4111 1111 1111 1111 x@y.de 1.2.3.4", "", None, "1.2.3.4 5.6.7.8 9.9.9.9"]
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/pii-counts"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    rows = {r["doc_id"]: r for r in pii_sanitiser.op4_pii(spark, path).collect()}
    assert [[rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] for i in range(6)] == [[0, 2, 0, 1], [2, 0, 0, 1], [1, 1, 1, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 3, 0, 0]]
    for r in rows.values():
        kinds = [s.split(":")[0] for s in r["spans"].split(",")]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]


def test_slots_take_little_of_the_driver(spark):
    """A million words of slots came to the driver as Python rows, some 300 bytes each."""
    n = 300_000
    terms = spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    tracemalloc.start()
    try:
        held = pii_sanitiser.slots(terms, "term")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    assert len(held) == pii_sanitiser.SLOTS // 8 and all(pii_sanitiser.in_slots(f"w{i}", held) for i in range(0, n, 7))
    assert sum(pii_sanitiser.in_slots(f"v{i}", held) for i in range(10_000)) < 200
    assert pii_sanitiser.slots(terms.limit(0), "term") == bytes(len(held))


def test_copies_count_once(spark):
    """Beyond what may be broadcast, all texts were shuffled to count copies once."""
    texts = ["alpha beta"] * 5 + ["alpha gamma", "alpha beta gamma", None, "", "", "delta"] + [f"mail me {i} a@b.co" for i in range(3)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.groupBy(pii_sanitiser.text_key().alias("text_key")).agg(F.count("*").alias("copies"))
    words = spark.createDataFrame([(w,) for w in ("alpha", "beta", "gamma", "mail", "none")], "term string")
    counted = pii_sanitiser.count_terms(docs, keyed.filter("copies > 1"), pii_sanitiser.slots(words, "term"))
    assert {(r["term"], r["df_term"]) for r in counted.collect()} >= {("alpha", 3), ("beta", 2), ("gamma", 2), ("mail", 3)}
    assert {r["term"] for r in counted.collect()} == {"alpha", "beta", "gamma", "mail"}
    moved = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in moved


def test_only_texts_with_spans_move(spark):
    """Spans were broadcast up to 64 MB, and beyond that all texts were shuffled to meet them."""
    texts = ["alpha beta"] * 5 + ["alpha gamma", "alpha beta gamma", None, "", "", "delta"] + [f"mail me {i} a@b.co" for i in range(3)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii_sanitiser.sanitise(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "may_have" in plan
    got = dict(out.select("doc_id", "text").collect())
    assert len(got) == out.count() == len(texts)
    assert [got[i] for i in range(11)] == texts[:11] and all("[EMAIL]" in got[i] and "@" not in got[i] for i in range(11, 17))
