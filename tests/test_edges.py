"""Cases outside the tables' values: numbers, deep sitemaps, missing times, long and cyclic graphs, code fences."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import crawl, flows, structure
from lodestone.plans.layers import longest_path_layers
from lodestone.streaming import limits

NUMBERS = {"": 0.0, " \t": 0.0, "3.5": 3.5, "-4": -4.0, "1e3": 1000.0, "12345678901": 12345678901.0, "+.5": 0.5, "5.": 5.0, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, " 7\n": 7.0,
           "1e999": None, "Infinity": None, "NaN": None, "1,000": None, "1d": None, "abc": None, "--1": None, "1 2": None, "0x": None, ".": None, "٣": None}


def test_number(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", X.number(F.col("v")).alias("n")).collect()} == NUMBERS


def test_flow_if(spark):
    df = spark.createDataFrame([(k,) for k in [*NUMBERS, None]], "v string")
    for op, f in {"gt": lambda a: a > -4, "gte": lambda a: a >= -4, "lt": lambda a: a < -4, "lte": lambda a: a <= -4}.items():
        got = {r["v"]: r["x"] for r in df.select("v", flows.flow_if(F.col("v"), op, "-4.0").alias("x")).collect()}
        assert got == {k: n is not None and f(n) for k, n in {**NUMBERS, None: 0.0}.items()}
    assert not any(r[0] for r in df.select(flows.flow_if(F.col("v"), "lt", "many")).collect())


def test_schema_numbers(spark):
    rules = [{"path": "k", "type": "number", "min": 10, "max": 90}]
    values = {"-5": "k: below 10", "200.5": "k: above 90", "50.5": "", "1e3": "k: above 90", "12345678901": "k: above 90", '"x"': "k: not a number", "5E-1": "k: below 10"}
    df = spark.createDataFrame([(v, f'{{"k":{v}}}') for v in values], "v string, json string")
    assert {r["v"]: r["e"] for r in df.select("v", F.array_join(flows.schema_errors(F.col("json"), rules), "; ").alias("e")).collect()} == values


def test_deep_sitemaps(spark):
    loc = lambda *urls: "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    files = [(f"s{i}", loc(f"s{i + 1}", f"p{i}", "s0")) for i in range(9)] + [("s9", loc("p9"))]
    got = crawl.expand_sitemaps(spark.createDataFrame([("r", "s0")], "root string, url string"), spark.createDataFrame(files, "url string, xml string"))
    assert sorted(r["url"] for r in got.collect()) == [f"p{i}" for i in range(10)]
    assert crawl.expand_sitemaps(spark.createDataFrame([], "root string, url string"), spark.createDataFrame(files, "url string, xml string")).count() == 0


def test_deep_links(spark):
    links = spark.createDataFrame([(f"u{i:03d}", 0, f"u{i + 1:03d}") for i in range(25)], "src string, order int, dst string")
    got = crawl.discover(spark.createDataFrame([("u000",)], "url string"), links)
    assert {r["url"]: r["depth"] for r in got.collect()} == {f"u{i:03d}": i for i in range(26)}


def test_events_without_time(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, 100), (1, 4, 200), (1, 5, None), (2, 6, 5), (None, 7, None)]
    got = limits.anchored_windows(spark.createDataFrame(rows, "user_id long, event_id long, t long"), 3600, 2)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == {1: True, 2: True, 5: False, 3: True, 4: True, 6: True, 7: True}
    assert {r["t"] for r in got.collect()} == {None, 100, 200, 5}
    asked = spark.createDataFrame([(i, t, "d", "a", "s", "o") for i, t in enumerate([None, None, 7, 8, 9])], "event_id long, t long, day string, ip string, site string, origin string")
    denied = {r["event_id"]: r["denied_by"] for r in limits.layered_limits(asked, (("ip", ["ip"], 60, 2), ("site", ["site"], 60, 1))).collect()}
    assert denied == {0: None, 1: "site", 2: None, 3: "site", 4: "ip"}


def test_long_and_cyclic_graphs(spark):
    n = 5000
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(0, 4000), (0, 1), (17, 4999)], "src long, dst long"))
    assert {r["node"]: r["depth"] for r in longest_path_layers(nodes, chain).collect()} == {**{i: i for i in range(n)}, n: 0}
    for edges in ([(1, 2), (2, 3), (3, 1)], [(1, 1)], [(0, 1), (1, 2), (2, 1), (2, 3)]):
        with pytest.raises(ValueError, match="cycle"):
            longest_path_layers(spark.range(5).select(F.col("id").alias("node")), spark.createDataFrame(edges, "src long, dst long"))


def test_headings_in_fences(spark):
    text = "intro\n# A\n```sh\n# comment\n```\n~~~\n```\n## no\n~~~ x\n# no\n~~~~\n## B\nx\n````\n# no\n```\n# no\n````\n### C\n    ```\n# D\n```\n# open to the end"
    got = [(r["section_no"], r["heading_path"], r["text"]) for r in structure.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_no").collect()]
    assert [(p, t.split("\n")[0]) for _, p, t in got] == [([], "intro"), (["A"], "# A"), (["A", "B"], "## B"), (["A", "B", "C"], "### C"), (["D"], "# D")]
    assert "\n".join(t for *_, t in got) == text
