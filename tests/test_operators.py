"""Hand-computed expectations."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import refresh
from lodestone.operators import retrieval as R
from lodestone.operators.chunking import chunk_windows, heading_stack
from lodestone.operators.dialogue import intent_gate
from lodestone.operators.urls import canonical_dedupe


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("word, parts", [("observeHandler", ["observe", "handler"]), ("XPathResolver", ["xpath", "resolver"]), ("a_b", ["ab"]), ("v2", ["v2"]), ("foo2bar", ["foo", "2bar"])])
def test_split_identifier(spark, word, parts):
    assert one(spark, X.split_identifier(F.lit(word))) == parts


@pytest.mark.parametrize("url, key", [("https://Docs.Ex.com:443/v3/guide/?q=1#t", "https://docs.ex.com/guide"), ("http://ex.com/", "http://ex.com"), ("Not a url", "not a url")])
def test_canonical_url(spark, url, key):
    assert one(spark, X.canonical_url(F.lit(url))) == key


def test_canonical_dedupe(spark):
    rows = spark.createDataFrame([(0, "https://e.com/a?x=1"), (1, "https://e.com/b"), (2, "https://e.com/a")], "page_id long, url string")
    assert {(r["url"], r["place"]) for r in canonical_dedupe(rows).collect()} == {("https://e.com/a", 0), ("https://e.com/b", 1)}


@pytest.mark.parametrize("url, same, any_host", [("https://e.com/docs", True, True), ("https://e.com/docs/x", True, True), ("https://e.com/docsx", False, False), ("http://e.com/docs", False, True), ("https://www.e.com/docs/y", False, True)])
def test_prefix(spark, url, same, any_host):
    root = F.lit("https://e.com/docs")
    assert one(spark, X.under_prefix(F.lit(url), root)) is same
    assert one(spark, X.under_prefix_any_host(F.lit(url), root)) is any_host


def test_fusion_and_reranks(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.8, 1), (1, "c", 0.7, 2)], "question_id int, id string, dense double, rank int")
    lexical = spark.createDataFrame([(1, "c", 3.0, 0), (1, "d", 2.0, 1), (1, "a", 1.0, 2)], "question_id int, id string, lexical double, rank int")
    fused = R.fuse_hybrid(dense, lexical)
    got = [(r["id"], round(r["rrf"], 6), r["dense"]) for r in fused.orderBy("rank").collect()]
    assert got == [("a", 0.032266, 0.9), ("c", 0.032266, 0.7), ("b", 0.016129, 0.8), ("d", 0.016129, 0.7)]
    assert [(r["id"], round(r["score"], 2)) for r in R.vector_only_rerank(fused).orderBy("rank").collect()] == [("a", 0.94), ("c", 0.72), ("b", 0.68), ("d", 0.52)]
    sem = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.5), ("d", 0.4)], "id string, semantic double")
    assert [(r["id"], round(r["score"], 2)) for r in R.weighted_rerank(fused.join(sem, "id")).orderBy("rank").collect()] == [("b", 0.79), ("c", 0.61), ("a", 0.57), ("d", 0.46)]


@pytest.mark.parametrize("scores, flag", [([0.9, 0.7, 0.5], False), ([0.69, 0.1], True), ([0.9, 0.85], True), ([0.9, 0.8, 0.79], True)])
def test_ambiguity(spark, scores, flag):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "question_id int, rank int, score double")
    assert R.ambiguous(df).first()["ambiguous"] is flag


def test_round_robin(spark):
    df = spark.createDataFrame([(1, 0, 0, "a1"), (1, 0, 1, "a2"), (1, 1, 0, "b1")], "question_id int, source_no int, rank int, id string")
    assert [r["id"] for r in R.round_robin(df).orderBy("rank").collect()] == ["a1", "b1", "a2"]


def test_snapshots(spark):
    prior = spark.createDataFrame([("s", "p1", "h1", False), ("s", "p2", "h2", False), ("s", "p3", "h3", False), ("s", "p4", "h4", True)], "source_id string, url string, hash string, tombstoned boolean")
    new = spark.createDataFrame([("s", "p1", "h1"), ("s", "p2", "hX"), ("s", "p4", "h4"), ("s", "p5", "h5")], "source_id string, url string, hash string")
    assert {r["url"]: r["change"] for r in refresh.snapshot_diff(prior, new).collect()} == {"p1": "unchanged", "p2": "updated", "p3": "removed", "p4": "added", "p5": "added"}
    assert {r["url"]: r["tombstoned"] for r in refresh.snapshot_next(prior, new).collect()} == {"p1": False, "p2": False, "p3": True, "p4": False, "p5": False}


def test_header_change(spark):
    cases = [("e", None, None, None, 304, "unchanged"), (None, None, "e", None, 200, "baseline"), ("e", None, "f", None, 200, "changed"), ("e", None, None, None, 200, "unchanged")]
    for *args, want in cases:
        assert one(spark, refresh.header_change(*[F.lit(a).cast("string") for a in args[:4]], F.lit(args[4]))) == want


def test_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "x" * 4096), (3, None)], "doc_id int, text string")
    assert sorted((r["doc_id"], len(r["text"])) for r in chunk_windows(docs).collect()) == [(1, 1504), (1, 4096), (2, 4096)]


def test_headings(spark):
    lines = F.array(*[F.lit(x) for x in ("# A", "text", "## B", "### C", "## D")])
    assert one(spark, heading_stack(lines)) == ["A", "D"]


@pytest.mark.parametrize("text, want", [("hey there", ("greetings", 0.98)), ("thanks", ("thanks", 0.95)), ("how do I x", ("question", 0.95)), ("install", ("unknown", 0.0)), ("word " * 25, ("question", 0.7)), (None, ("unknown", 0.0))])
def test_intent(spark, text, want):
    label, score = intent_gate(F.lit(text).cast("string"))
    assert (one(spark, label), one(spark, score)) == want


@pytest.mark.parametrize("text, want", [("canñe", ("question", 0.95)), ("canones", ("unknown", 0.0)), ("do\u00e9", ("question", 0.95)), ("is_x", ("unknown", 0.0)), ("can", ("question", 0.95)), ("one two?\x0b", ("unknown", 0.0)), ("thanks!\u2028", ("thanks", 0.95))])
def test_intent_reads_ascii_words(spark, text, want):
    label, score = intent_gate(F.lit(text))
    assert (one(spark, label), one(spark, score)) == want
    from lodestone.operators.dialogue import ORACLE_SQL

    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations AS SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, ?::VARCHAR AS text", [text])
    assert duck.execute(ORACLE_SQL["intent_gate"]).fetchone()[2:] == want


def test_stream_equals_batch(spark, tmp_path):
    from lodestone.sources.tables import table
    from lodestone.streaming.limits import stream_counts, windowed_counts

    events = table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    q = stream_counts(spark, str(tmp_path / "in"), events.schema).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))


def test_last_mile(spark):
    from lodestone.operators.ranking import last_mile, name_overlap, path_role

    assert one(spark, name_overlap(F.array(F.lit("timeout"), F.lit("x1")), F.array(F.lit("timeouts")))) == 1.0
    roles = {"src/a.test.ts": "test", "tests/a.ts": "test", "examples/a.ts": "example", "docs/a.ts": "docs", "readme.md": "docs", "vite.config.ts": "config", "src/a.ts": "source"}
    for path, role in roles.items():
        assert one(spark, path_role(F.lit(path))) == role
    cols = "question_id int, rank int, score double, terms array<string>, intent string, identifier boolean, path string, symbol string, kind string, page string"
    rows = [
        (1, 0, 0.9, ["retry", "timeout"], "implementation", False, "src/queue.ts", None, "source", "p1"),
        (1, 1, 0.8, ["retry", "timeout"], "implementation", False, "src/retryTimeout.ts", "retryTimeout", "source", "p2"),
        (1, 2, 0.7, ["retry", "timeout"], "implementation", False, "test/retryTimeout.test.ts", None, "test", "p3"),
        (2, 0, 0.5, ["a"], "concept", False, None, None, "docs", "p1"),
        (2, 1, 0.6, ["a"], "concept", False, None, None, "docs", "p1"),
    ]
    out = last_mile(spark.createDataFrame(rows, cols)).collect()
    assert [(r["page"], r["score"]) for r in sorted((r for r in out if r["question_id"] == 1), key=lambda r: r["rank"])] == [("p2", 0.9), ("p1", 0.8), ("p3", 0.7)]
    assert [r["score"] for r in sorted((r for r in out if r["question_id"] == 2), key=lambda r: r["rank"])] == [0.5, 0.6]


def test_extract(spark):
    from lodestone.functions import extract as E

    lit = F.lit
    assert one(spark, E.sitemap_locations(lit("<url><loc> https://e.com/a?x=1&amp;y=2 </loc></url><loc>https://e.com/b</loc><loc>https://e.com/b</loc>"))) == ["https://e.com/a?x=1&y=2", "https://e.com/b"]
    robots = lit("User-agent: *\nDisallow: /x\ndisallow: /y\nDisallow:\nSitemap: https://e.com/s.xml\n")
    assert one(spark, E.robots_sitemaps(robots)) == ["https://e.com/s.xml"] and one(spark, E.robots_disallows(robots)) == 2
    assert [one(spark, E.status_reason(lit(s).cast("int"))) for s in (204, 404, 500, None)] == [None, "gone", "status_500", "no_response"]
    assert one(spark, E.markdown_links(lit("[a](https://e.com/x#y) [b](/no) [c](https://e.com/x)"))) == ["https://e.com/x"]
    assert one(spark, E.keyword_terms(lit("How to Run the run"))) == ["how", "run", "the"]
    assert one(spark, E.clean_query(lit("why `x()` fails?!  now"))) == "why fails now"
    assert one(spark, E.route_matches(lit("/a/:id/b"), lit("/a/7/b"))) and not one(spark, E.route_matches(lit("/a/:id"), lit("/a/7/b")))
    assert one(spark, E.route_specificity(lit("/a/:id"))) == 21
    assert [one(spark, E.clamp_score(lit(x).cast("double"))) for x in (1.5, -1.0, 0.3, float("nan"), None)] == [1.0, 0.0, 0.3, 0.0, 0.0]
    assert one(spark, E.logistic(lit(0.0))) == 0.5 and one(spark, E.json_at(lit('{"a":{"b":3}}'), "a.b")) == "3"
    assert E.strictness("strict") == (0.65, 0.5, False) and E.strictness("permissive") == (0.5, 0.5, True)
    assert E.strictness("strict", 0.4) == (0.4, 0.4, False) and E.strictness("strict", None) == (0.0, 0.0, False)


def test_layers(spark):
    from lodestone.plans.layers import compile_plan, longest_path_layers

    rows = [(1, 0, "trigger.manual", [("x", 1), ("y", 1)]), (1, 1, "control.if", [("yes", 2), ("no", 1)]), (1, 2, "tool.call", None), (1, 3, "agent.ask", [("t", 1)])]
    nodes, edges = compile_plan(spark.createDataFrame(rows, "plan int, phase_no int, spec string, branches array<struct<id:string,steps:int>>"))
    depth = {r["node"]: r["depth"] for r in longest_path_layers(nodes, edges).collect()}
    assert depth == {"p0-x": 0, "p0-y": 0, "merge-0": 1, "p1": 2, "p1-yes-1": 3, "p1-no-1": 3, "p1-yes-2": 4, "p2": 5, "p3": 6, "p3-t": 7}
    assert {(r["dst"], r["handle"]) for r in edges.collect() if r["handle"]} == {("p1-yes-1", "yes"), ("p1-no-1", "no")}
    with pytest.raises(ValueError):
        longest_path_layers(nodes, edges.select("src", "dst").unionByName(spark.createDataFrame([("p2", "p1")], "src string, dst string")))


def test_stateful_limits_equal_batch(spark, tmp_path):
    """A stream judges events as the batch does, over several micro-batches in order of time."""
    from lodestone.streaming.limits import _timed, anchored_windows, stream_limits

    e = _timed(spark, "/root/testdata/sf0.001").select("user_id", "event_id", "t")
    cut = e.selectExpr("percentile(t, array(0.3, 0.7))").first()[0]
    for i, (lo, hi) in enumerate(zip([-1e18, *cut], [*cut, 1e18])):
        e.filter((F.col("t") > lo) & (F.col("t") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_limits(stream, 400_000).writeStream.outputMode("append").format("memory").queryName("limits").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r["event_id"], r["allowed"]) for r in anchored_windows(e, 400_000).collect()}
    assert {(r["event_id"], r["allowed"]) for r in spark.table("limits").collect()} == batch and len({a for _, a in batch}) == 2


def test_many_events_of_a_key_are_linear(spark):
    from lodestone.streaming.limits import anchored_windows

    e = spark.range(300_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.col("id").alias("t"))
    assert anchored_windows(e, 100, 7).filter("allowed").count() == 3000 * 7


def test_unique_ids_are_asked_for(spark):
    from lodestone.operators.sinks import assert_unique

    with pytest.raises(ValueError, match="id is not unique"):
        assert_unique(spark.createDataFrame([(1,), (1,), (2,)], "id int"), "id")


def test_json_keys(spark):
    from lodestone.operators.flows import missing_keys

    assert one(spark, missing_keys(F.lit('{"a":[{"b":{"c":1}}]}'), ["a", "b", "c", "d"])) == ["d"]
    assert one(spark, missing_keys(F.lit('{"rows":[]}'), ["a"], "rows")) == [] and one(spark, missing_keys(F.lit("{}"), ["a"], "rows")) == ["rows"]


def test_last_mile_deals_scores_anew(spark):
    from lodestone.operators.ranking import last_mile

    rows = [(1, i, 0.9 - i / 10, f"src/v{i + 1}/other.ts" if i < 3 else "src/limits/rate.ts", None, "source", f"p{i}", ["rate", "limits"], "implementation", False) for i in range(4)]
    df = spark.createDataFrame(rows, "question_id int, rank int, score double, path string, symbol string, kind string, page string, terms array<string>, intent string, identifier boolean")
    out = last_mile(df).orderBy("rank").collect()
    assert sorted(r["score"] for r in out) == sorted(r[2] for r in rows) and [r["page"] for r in out] == ["p3", "p2", "p1", "p0"]
    none = last_mile(df.withColumn("path", F.lit(None).cast("string"))).orderBy("rank").collect()
    assert [r["page"] for r in none] == ["p0", "p1", "p2", "p3"]


def test_snapshot_files(spark, tmp_path):
    from lodestone.sources.tables import load_snapshot

    (tmp_path / "s.json").write_text('[{"id": "a", "pages": 3},\n {"id": "b", "name": null}]')
    got = load_snapshot(spark, str(tmp_path / "s.json"), "id string, name string, pages int", {"name": "unnamed", "pages": 0})
    assert sorted(map(tuple, got.collect())) == [("a", "unnamed", 3), ("b", "unnamed", 0)]


def test_catalog_filter_reads_rare_words_only(spark):
    """Equal to scoring all pairs, and of pages that share frequent words few pairs are made."""
    import random

    from lodestone.operators import ranking as G

    rng, common = random.Random(5), ["the", "and", "for", "with"]
    titles = [" ".join(rng.sample(common, 3) + [f"w{rng.randrange(150)}" for _ in range(rng.randrange(4))]) for _ in range(300)] + ["the and for", "", None, "x y", "The The the w1"]
    pages = spark.createDataFrame([(i, f"https://a.org/{rng.choice(['en', 'w7', 'with-w8', 'p' + str(i)])}/x.html", t) for i, t in enumerate(titles)], "page_id long, url string, title string")
    more = [" wholly unlike words stand here and there", "", " w7 w8", " the"]
    qs = pages.select(F.col("page_id").alias("item_id"), F.concat("title", F.element_at(F.array(*map(F.lit, more)), (F.col("page_id") % 4 + 1).cast("int"))).alias("question"))
    brute = {}
    for r in G.catalog_scores(qs, pages).collect():
        key = (round(r["score"], 9), -r["page_id"])
        brute[r["item_id"]] = max(brute.get(r["item_id"], key), key)
    want = {(i, -p, s) for i, (s, p) in brute.items() if s >= 0.7}
    assert {(r["item_id"], r["page_id"], r["score"]) for r in G.catalog_url_filter(qs, pages).collect()} == want and len(want) > 200
    asked = qs.select(F.col("item_id").alias("qid"), G.catalog_words(F.col("question")).alias("ws")).filter(F.size("ws") > 0)
    classes = pages.select(F.col("page_id").alias("cid"), F.lower("title").alias("t"), F.array_distinct(G.catalog_words(F.coalesce("title", F.lit("")))).alias("ws"))
    assert G.catalog_candidates(asked, classes, 1.0).count() < 300 * 300 / 4


def test_pages_of_roots_without_pairs(spark):
    """Every root and page of one host and folder: counted, and no page is joined to a root."""
    from lodestone.operators.flows import roots_with_pages

    urls = ["https://a.org/en/x", "https://a.org/en", "https://a.org/fr/y", "https://a.org/", "https://a.org/en/x/z", "http://b.org/en/x", None]
    pages = spark.createDataFrame([(i, urls[i % 7], ["en", "none", "fr", "", None][i % 5]) for i in range(70)], "page_id long, url string, category string")
    roots = spark.createDataFrame(list(enumerate([*urls, "https://a.org/none/such", "https://c.org/en"])), "root_id long, url string")
    host = lambda u: u.split("/")[2]
    parts = lambda u: [s for s in u.split("/")[3:] if s]
    under = lambda r, p, c: p and r and host(p) == host(r) and (parts(p)[: len(parts(r))] == parts(r) or (parts(r) and c == parts(r)[0]))
    want = {i: sum(bool(under(r, p, c)) for _, p, c in pages.collect()) for i, r in roots.collect()}
    out = roots_with_pages(roots, pages)
    assert dict(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "page_id" in x and "LogicalRDD" not in x]


def test_bm25_moves_postings_once(spark):
    """However many questions ask for a term, its postings are dealt once and only the best rows of a task are ranked."""
    import math

    docs = [(i, " ".join(["common"] * (1 + i % 3) + ["w%d" % (i % 11), "v%d" % (i % 7)] * (1 + i % 2))) for i in range(400)] + [(400, None), (401, "")]
    qs = spark.createDataFrame([(q, f"common w{q % 11} v{q % 7} absent", "even" if q % 2 else None) for q in range(60)], "question_id long, question string, kind string")
    chunks = spark.createDataFrame([(i, t, "even" if i % 2 == 0 else "odd") for i, t in docs], "id long, text string, kind string")
    sizes = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, sizes.values())) / len(sizes)
    seen = {w: sum(w in t for t in sizes.values()) for t in sizes.values() for w in t}
    idf = {w: (lambda x: x if x > 0 else 1e-6)(math.log((len(docs) - n + 0.5) / (n + 0.5))) for w, n in seen.items()}
    for equal in ((), ("kind",)):
        want = set()
        for q in range(60):
            terms = ["common", f"w{q % 11}", f"v{q % 7}"]
            pool = [i for i in sizes if any(t in sizes[i] for t in terms) and (not equal or q % 2 == 0 or i % 2 == 0)]
            score = lambda i: round(sum(idf[t] * (c := sizes[i].count(t)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(sizes[i]) / avg)) for t in terms), 6)
            want |= {(q, i, r) for r, (_, i) in enumerate(sorted((-score(i), i) for i in pool)[:20])}
        out = R.bm25_top_k(qs, chunks, 20, equal)
        assert {(r["question_id"], r["id"], r["rank"]) for r in out.collect()} == want
        assert "MapInPandas" in out._jdf.queryExecution().optimizedPlan().toString()


def test_hits_go_to_the_scan_of_chunks_and_a_fused_pool_is_searched_once(spark):
    from lodestone.operators import answering, retrieval

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = "/root/testdata/sf0.001"
        pool = answering._pool(spark, d)
        assert "MapInPandas" not in plan(pool)  # else each use scans all vectors again
        hits = retrieval.vector_only_rerank(pool).select("question_id", "id", "rank", "score")
        assert "SortMergeJoin" not in plan(answering._meta(spark, d).join(retrieval.broadcast_if_small(hits), "id"))
        assert "SortMergeJoin" not in plan(retrieval._pages(hits, spark, d))
        met = plan(answering._siblings(spark, d, retrieval._pages(hits, spark, d)))
        assert "documents.parquet" not in met  # texts stay in their scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_retrieval_makes_the_metadata_of_its_pool_once(spark):
    from lodestone.operators import answering

    d = "/root/testdata/sf0.001"
    assert "documents.parquet" not in answering.retrieve_full(spark, d)._jdf.queryExecution().executedPlan().toString()  # else each step reads all texts again
    pool = answering._pool(spark, d).filter("rank < 3")
    every = {r["id"]: r for r in answering._meta(spark, d).collect()}
    want = [every[i] for i in {r["id"] for r in pool.collect()} if i in every]
    assert want and sorted(answering._meta(spark, d, pool).collect()) == sorted(want)
