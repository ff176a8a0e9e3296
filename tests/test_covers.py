"""Covers against all intervals tried in turn, and an index with positions after deltas."""

import random

from lodestone.operators import covers as V
from lodestone.operators.lexical_index import index_changes
from lodestone.sources.store import Store


def brute(words, heads, needs):
    """Number of covers and density of one document; needs: the terms of each need."""
    meets = lambda a, b: all(any(w in n for w in words[a : b + 1]) for n in needs)
    found = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if meets(a, b) and not meets(a + 1, b) and not meets(a, b - 1)]
    total = 0.0
    for a, b in found:
        inside = [1 / (V.HEAD_WEIGHT if i < heads else V.BODY_WEIGHT) for i in range(a, b + 1) if any(words[i] in n for n in needs)]
        total += len(inside) / sum(inside) / (1 + b - a + 1 - len(inside))
    return len(found), round(total, 6)


def test_covers_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]) for i in range(60)]
    asked = {1: ["a", "b", "c"], 2: ["ad", "b"], 3: ["e"], 4: ["abc", "defgh"], 5: ["a", "z"]}
    rows = [(i, " ".join(h), " ".join(b) if b else None) for i, h, b in docs]
    store = Store(spark, str(tmp_path / "index"))
    chunks = spark.createDataFrame(rows, "id long, heading string, text string")
    store.commit(index_changes(store, chunks.withColumn("text", chunks.heading), positions=True))  # replaced by the next commit
    store.commit(index_changes(store, chunks, positions=True))
    wanted = spark.createDataFrame([(q, n, t) for q, needs in asked.items() for n, terms in enumerate(needs) for t in terms], "question_id long, need int, term string")
    got = {(r.question_id, r.id): (r.covers, r.density) for r in V.cover_density(store, wanted, 1000).collect()}
    expected = {(q, i): brute(h + b, len(h), needs) for q, needs in asked.items() for i, h, b in docs}
    assert got == {k: v for k, v in expected.items() if v[0]}


def test_a_term_of_two_needs_and_no_question(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.commit(index_changes(store, spark.createDataFrame([(1, "a x a"), (2, None)], "id long, text string"), positions=True))
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 1, "a")], "question_id long, need int, term string")
    assert V.cover_density(store, wanted).collect() == []
    assert V.cover_density(store, wanted.limit(0)).collect() == []


def test_postings_of_chunks_and_of_slices_of_them(spark, tmp_path, monkeypatch):
    from lodestone.operators import lexical_index as L

    rng = random.Random(8)
    docs = [(i, "s", [rng.choice("abc") for _ in range(rng.randint(0, 2))], [rng.choice(["a", "b", "ñandú", "Ǆx", "x1", "٣"]) for _ in range(rng.randint(0, 9))]) for i in range(40)]
    rows = [(i, s, " ".join(h) or None, "-".join(b) or None) for i, s, h, b in docs]
    chunks = spark.createDataFrame(rows, "id long, source string, heading string, text string").repartition(2)
    want = []
    for i, s, h, b in docs:
        words = [w.lower() for w in h + b]
        want.append((i, s, len(words), "", 0, [len(words)], 0))
        for w in set(words):
            places = [p for p, x in enumerate(words) if x == w]
            heads = sum(p < len(h) for p in places)
            want.append((i, s, len(words), w, len(places) + 4 * heads, places, heads))
    for tokens in (L.TOKENS, 1, 20):
        monkeypatch.setattr(L, "TOKENS", tokens)
        store = Store(spark, str(tmp_path / f"index{tokens}"))
        store.commit(index_changes(store, chunks, carry=("source",), positions=True))
        got = store.table("postings").select("id", "source", "len", "term", "tf", "places", "heads")
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "MapInArrow" in index_changes(store, chunks)["postings"].rows._jdf.queryExecution().optimizedPlan().toString()


def test_questions_and_documents_in_pieces_give_what_all_at_once_give(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    docs = [(i, "b" if i % 3 == 0 else "", [rng.choice("abcdexyz") for _ in range(rng.randint(0, 30))]) for i in range(50)]
    store = Store(spark, str(tmp_path / "index"))
    store.commit(index_changes(store, spark.createDataFrame([(f"d{i:02}", h, " ".join(b)) for i, h, b in docs], "id string, heading string, text string"), positions=True))
    asked = {f"q{q}": rng.sample("abcde", 4) for q in range(9)}
    for few in (1, 2):  # needs of a question
        needs = {q: ["".join(ts[n::few]) for n in range(few)] for q, ts in asked.items()}
        wanted = spark.createDataFrame([(q, n, t) for q, ns in needs.items() for n, ts in enumerate(ns) for t in ts], "question_id string, need int, term string")
        want = []
        for q, ns in needs.items():
            each = [(f"d{i:02}", *brute(h.split() + b, len(h.split()), ns)) for i, h, b in docs]
            if few == 1:  # every place counts its own weight
                each = [(f"d{i:02}", sum(w in ns[0] for w in h.split() + b), round(sum((V.HEAD_WEIGHT if p < len(h.split()) else V.BODY_WEIGHT) for p, w in enumerate(h.split() + b) if w in ns[0]), 6)) for i, h, b in docs]
            ranked = sorted((-density, i, n) for i, n, density in each if n)[:5]
            want += [(q, i, n, -density, r) for r, (density, i, n) in enumerate(ranked)]
        for cells, block in ((V.CELLS, V.QUESTION_BLOCK), (60, 4), (1, 4)):
            monkeypatch.setattr(V, "CELLS", cells)
            monkeypatch.setattr(V, "QUESTION_BLOCK", block)
            out = V.cover_density(store, wanted, 5)
            assert sorted(map(tuple, out.collect())) == sorted(want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan  # no place is a row
        monkeypatch.undo()


def test_rounding_is_that_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    xs = [0.0015625, 0.4 / 256, 1.0000005, 2.5 / 3, 0.1 + 0.2, 1234.5678915, 0.0, 7.0000025]
    assert V.rounded(np.array(xs)).tolist() == [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6)).collect()]
