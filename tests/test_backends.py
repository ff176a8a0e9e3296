"""Backends by name: batches, failures and fall-backs."""

import pytest

from lodestone.operators import backends as B


@pytest.fixture
def boom():
    """Made in a function, so that workers need not import this module."""

    def f(*_):
        raise RuntimeError("down")

    return f


def test_embedder_falls_back_and_says_so(spark, boom):
    def short_lived(texts):
        if "stop" in texts:
            raise RuntimeError("down")
        assert len(texts) <= 4
        return [[1.0] for _ in texts]

    B.register_embedder("boom", boom)
    B.register_embedder("short-lived", short_lived)
    B.register_embedder("wrong-number", lambda texts: [[1.0]])
    B.register_embedder("two", lambda texts: [[2.0] for _ in texts])
    rows = spark.createDataFrame([(i, "stop" if i == 9 else None if i == 3 else "x") for i in range(20)], "id int, text string").coalesce(1)
    got = {r.id: (list(r.vec), r.backend) for r in B.embed(rows, ["boom", "wrong-number", "short-lived", "two"], batch=4).collect()}
    assert got == {i: ([1.0], "short-lived") if i < 8 else ([2.0], "two") for i in range(20)}
    assert B.embed(rows.limit(0), ["boom"]).collect() == []
    with pytest.raises(Exception, match="down"):
        B.embed(rows, ["boom"]).collect()
    with pytest.raises(ValueError, match="nobody"):
        B.embed(rows, ["nobody"])
    with pytest.raises(ValueError, match="vec or backend"):
        B.embed(rows.withColumnRenamed("id", "vec"), ["two"])


def test_reranker_falls_back_by_question(spark, boom):
    def late(question, texts):
        if question == "b" and texts[0] == "4":
            raise RuntimeError("down")
        return [float(t or -1) for t in texts]

    B.register_reranker("late", late)
    B.register_reranker("boom", boom)
    pool = spark.createDataFrame([(q, i, 0.5, i) for q in (1, 2) for i in range(6)], "question_id int, id int, dense double, rank int")
    qs = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    texts = spark.createDataFrame([(i, None if i == 2 else str(i)) for i in range(6)], "id int, text string")
    got = B.rerank(pool, qs, texts, ["boom", "late"], k=4, batch=2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.id, r.backend) for r in got] == [(1, i, "late") for i in (5, 4, 3, 1)] + [(2, i, "vector") for i in (0, 1, 2, 3)]
    assert B.rerank(pool.limit(0), qs, texts, ["late"]).collect() == []


def test_choice_and_chain(boom):
    assert B.choose_reranker() == "local-auto" and B.choose_reranker(code_ratio=0.6) == "vector"
    assert B.choose_reranker("llm-batch", "vector", 0.9) == "llm-batch" and B.choose_reranker(configured="word-overlap", code_ratio=0.9) == "word-overlap"
    assert B.choose_reranker(configured="nobody") == "local-auto"
    assert B.chain_of("vector") == [] and B.chain_of("local-mini") == ["local-mini"] and B.chain_of("cohere-auto") == ["cohere-auto", "local-auto", "local-mini"]
    with pytest.raises(ValueError, match="fall-back"):
        B.register_reranker("vector", boom)
