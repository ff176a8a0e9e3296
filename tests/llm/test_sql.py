"""The queries that have SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lodestone.llm import registry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    rows = lambda df: sorted(map(tuple, (df := df[sorted(df.columns)].astype(object)).where(df.notna(), None).values.tolist()), key=str)
    assert rows(registry.queries()[name](spark, str(SF)).toPandas()) == rows(c.execute(registry.oracle_sql()[name]).df())


def test_pipeline(spark):
    """Every stage keeps the columns of documents but the last, and its decisions hold in the result."""
    import corpus_pipeline as p

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    names, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {}
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, str(SF)), f"test-{name}")
        if name != "best_fit_packing":
            assert docs.columns == names
        rows[name] = docs.collect()
    kept = {r["doc_id"] for r in rows["quality_rules"]}
    judged = registry.queries()["op3_quality_rules"](spark, str(SF)).collect()
    assert kept == {r["doc_id"] for r in judged if r["kept"]}
    assert len({r["doc_id"] for r in rows["jaccard_join"]}) == len(rows["jaccard_join"]) <= len(kept)
    assert {r["doc_id"] for r in rows["pii"]} == {r["doc_id"] for r in rows["jaccard_join"]}
    assert not any("@" in r["text"] and "example.com" in r["text"] for r in rows["pii"])
    assert any(r["text"] != seen[r["doc_id"]] for r in rows["pii"]) and all(r["n_chars"] == len(r["text"]) for r in rows["pii"])
    copies = [r["doc_id"] for r in rows["source_mixing"]]
    assert max(map(copies.count, set(copies))) <= 3
    assert sum(r["piece"] == 0 for r in rows["best_fit_packing"]) == len(copies)
    load = {}
    for r in rows["best_fit_packing"]:
        load[r["sequence_id"]] = load.get(r["sequence_id"], 0) + r["length"]
    assert max(load.values()) <= 2048
