"""Commits of tables on disk, the stored lexical index against a rebuild, and refreshes of an index."""

import random
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import lexical_index as li
from lodestone.operators import retrieval as r
from lodestone.operators import stored_index as si
from lodestone.sources.store import Change, Store, part_of


@pytest.fixture
def store(spark):
    return Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/store-{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def parted(spark, data):
    return spark.createDataFrame(data, "k string, v int").withColumn("part", part_of(F.col("k")))


def test_commit(spark, store):
    assert store.version == 0 and store.table("t") is None
    store.commit({"t": Change(parted(spark, [("a", 1), ("b/ =é", 2), (None, 3), ("a", 4)]))})
    before = dict(store.parts["t"])
    store.commit({"t": Change(parted(spark, [("a", 5)]), drop=["knull"])})
    assert rows(store.table("t")) == [("a", 5), ("b/ =é", 2)]
    same = {p for p in before if store.parts["t"].get(p) == before[p]}
    assert len(same) == 1 and Store(spark, store.root).parts == store.parts
    assert rows(store.table("t", ["k61"])) == [("a", 5)] and rows(store.table("t", ["none"])) == []


def test_half_a_commit_is_nothing(spark, store):
    store.commit({"t": Change(parted(spark, [("a", 1)]))})
    boom = spark.createDataFrame([("x",)], "k string").select("k", F.raise_error(F.lit("lost")).cast("int").alias("v"), F.lit("p").alias("part"))
    with pytest.raises(PySparkException):
        store.commit({"t": Change(parted(spark, [("a", 2), ("c", 3)])), "u": Change(boom)})
    again = Store(spark, store.root)
    assert again.version == 1 and rows(again.table("t")) == [("a", 1)] and again.table("u") is None
    assert rows(again.commit({"t": Change(parted(spark, [("a", 2)]))}).table("t")) == [("a", 2)]


def test_second_writer_fails(spark, store):
    other = Store(spark, store.root)
    store.commit({"t": Change(parted(spark, [("a", 1)]))})
    with pytest.raises(PySparkException):
        other.commit({"t": Change(parted(spark, [("a", 2)]))})
    assert rows(Store(spark, store.root).table("t")) == [("a", 1)]


def test_empty_table(spark, store):
    store.commit({"t": Change(parted(spark, []))})
    assert store.table("t").columns == ["k", "v"] and store.table("t").count() == 0


def test_lexical_index_equals_rebuild(spark, store):
    rng = random.Random(3)
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choices(["alpha", "beta", "getUserName", "été", "x1", "rare", "common", "common"], k=rng.randrange(12)))
    schema = "id long, text string, heading string, lang string"
    docs = {i: (i, text(), rng.choice([None, "", "alpha HttpClient", "beta"]), rng.choice(["en", None, "de"])) for i in range(80)}
    qs = spark.createDataFrame([(1, "alpha common", None), (2, "getUserName rare", "en"), (3, "", "de"), (4, "nothing here", None), (5, "httpClient été x1 the", None)], "question_id long, question string, lang string")

    def same():
        want = r.bm25_top_k(qs, spark.createDataFrame(list(docs.values()), schema), 10, ("lang",))
        got = li.search(Store(spark, store.root), qs, 10, ("lang",))
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))

    store.commit(li.index_changes(store, spark.createDataFrame(list(docs.values()), schema), carry=("lang",)))
    same()
    for step in range(3):
        new = {i: (i, text(), None, "en") for i in rng.sample(range(100), 15)}
        gone = rng.sample([i for i in docs if i not in new], 6)
        store.commit(li.index_changes(store, spark.createDataFrame(list(new.values()), schema), spark.createDataFrame([(i,) for i in [*gone, 999]], "id long"), ("lang",)))
        docs = {i: d for i, d in {**docs, **new}.items() if i not in gone}
        if step != 1:
            same()
    li.compact(store)
    same()
    assert rows(store.table("gone")) == []


def crawl(spark, pages):
    return spark.createDataFrame([(s, u, t, h, x) for (s, u), (t, h, x) in pages.items()], "source_id string, url string, title string, hash string, text string")


def test_refresh(spark, store):
    pages = {("a", "1"): ("One", "h1", "alpha beta"), ("a", "2"): (None, "h2", "beta " * 1500), ("b", "1"): ("B", "h1", "gamma"), ("a", "3"): (" ", "h3", "")}
    si.refresh(store, crawl(spark, pages))
    b_files = store.parts["chunks"][part_of_value("b")]
    state = lambda: {n: rows(store.table(n)) for n in ("chunks", "vectors", "catalog", "snapshot")}
    first = state()
    si.refresh(store, crawl(spark, {k: v for k, v in pages.items() if k[0] == "a"}))
    assert state() == first and store.parts["chunks"][part_of_value("b")] == b_files
    assert {(c[0], c[1], c[2], c[3]) for c in first["catalog"]} == {("a", "1", "One", 1), ("a", "2", "2", 2), ("b", "1", "B", 1)}

    def broken(chunks):
        return chunks.select("id", "source_id", F.raise_error(F.lit("no model")).cast("array<double>").alias("vec"))

    changed = {("a", "1"): ("One", "h9", "delta"), ("a", "4"): ("Four", "h4", "beta")}
    with pytest.raises(PySparkException):
        si.refresh(store, crawl(spark, changed), embed=broken)
    assert {n: rows(Store(spark, store.root).table(n)) for n in first} == first
    store.load()
    si.refresh(store, crawl(spark, changed))
    assert [c[1:3] for c in rows(store.table("catalog", [part_of_value("a")]))] == [("1", "One"), ("4", "Four")]
    assert {(s[1], s[3]) for s in rows(store.table("snapshot", [part_of_value("a")]))} == {("1", False), ("4", False), ("2", True), ("3", True)}
    ids = {c["id"] for c in store.table("chunks").collect()}
    assert {v["id"] for v in store.table("vectors").collect()} == ids == {c["id"] for c in li.live_chunks(store).collect()}

    si.refresh(store, crawl(spark, {}), spark.createDataFrame([("b",)], "source_id string"))
    assert rows(store.table("catalog", [part_of_value("b")])) == [] and rows(store.table("snapshot", [part_of_value("b")])) == [("b", "1", "h1", True)]
    si.delete_sources(store, spark.createDataFrame([("a",), ("zz",)], "source_id string"))
    assert store.table("chunks").count() == 0 and store.table("totals").collect()[0]["n"] == 0
    with pytest.raises(ValueError):
        si.refresh(store, crawl(spark, {(None, "1"): ("N", "h", "x")}))


def part_of_value(v):
    return "k" + v.encode().hex()


def test_refresh_leaves_no_shuffles(spark, store):
    """Shuffles of texts and postings stayed on the disks after their tables were written, and texts were checkpointed as they are."""
    rng = random.Random(7)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))
    pages = {(f"s{i % 3}", str(i)): ("T", f"h{i}", text()) for i in range(300)}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = disk.getAllFiles().iterator()
        out = 0
        while files.hasNext():
            f = files.next()
            out += f.length() if f.getName().startswith("shuffle_") else 0
        return out

    before = left()
    si.refresh(store, crawl(spark, pages))
    assert left() - before < 200_000
    again = {k: (t, h + "x" * (int(k[1]) % 7 == 0), x) for k, (t, h, x) in pages.items() if int(k[1]) % 10}
    before = left()
    si.refresh(store, crawl(spark, again))
    assert left() - before < 200_000
    whole = Store(spark, store.root + "-whole")
    si.refresh(whole, crawl(spark, again))
    for name in ("chunks", "vectors", "catalog"):
        assert rows(store.table(name)) == rows(whole.table(name))
    assert rows(li.live_chunks(store).select("id", "len")) == rows(li.live_chunks(whole).select("id", "len"))


def test_many_files_of_a_part_are_dealt_again(spark, store, monkeypatch):
    pages = {("a", str(i)): ("T", "h", f"alpha {i}") for i in range(40)}
    si.refresh(store, crawl(spark, pages))
    state = rows(store.table("chunks"))
    si.refresh(store, crawl(spark, pages))
    monkeypatch.setattr(si, "FILES", 0)
    si.refresh(store, crawl(spark, pages))
    assert rows(store.table("chunks")) == state and len(store.table("chunks").inputFiles()) == 1


def test_segments_of_the_older_form_are_searched(spark, store):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)} w{i}") for i in range(30)], "id long, text string")
    qs = spark.createDataFrame([(1, "alpha beta"), (2, "w7 w8")], "question_id long, question string")
    store.commit(li.index_changes(store, docs))
    want = rows(li.search(store, qs, 5))
    older = F.when(F.col("term") == "", "docs").otherwise(li.older_bucket(F.col("term")))
    store.commit({"postings": Change(store.table("postings").withColumn("part", F.concat(older, F.lit("x1"))), drop=list(store.parts["postings"]))})
    assert {p[0] for p in store.parts["postings"]} == {"b", "d"} and rows(li.search(store, qs, 5)) == want


def test_embedder_counts_slots(spark):
    from zlib import crc32

    texts = ["", "alpha beta alpha", " ".join(f"w{i}" for i in range(500))]
    chunks = spark.createDataFrame([(str(i), "s", t) for i, t in enumerate(texts)], "id string, source_id string, text string")
    for size in (16, 200, 201):
        for r in si.hash_embedder(chunks, size).collect():
            n = [0] * size
            for w in texts[int(r["id"])].split():
                n[crc32(w.encode()) % size] += 1
            length = sum(x * x for x in n) ** 0.5
            assert r["vec"] == pytest.approx([x / length if length else 0.0 for x in n])
