"""Small functions over values that the tables do not reach."""

from pyspark.sql import functions as F

from lodestone.operators import display as D


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_packages_and_links(spark):
    names = ["@types/node", None, "node-fetch", "Node-X", "ms", "react-is", "reactive", "My-Starter-kit", "eslint-plugin-x", "@langchain/core", "left"]
    f = F.col("n")
    assert values(spark, [(n,) for n in names], "n string", D.infra_package(f)) == [True, True, False, True, True, True] + [False] * 5
    assert values(spark, [(n,) for n in names], "n string", D.junk_package(f)) == [False] * 7 + [True, True, False, False]
    none = F.lit(None)
    assert values(spark, [(n,) for n in names], "n string", D.typed_package(f, none.cast("array<string>"), none.cast("string"), none.cast("boolean"))) == [False] * 5 + [True, True, False, False, True, False]
    assert values(spark, [("x", ["TS"], None, None), ("x", [None], "Type-safe things", None), ("x", None, "typedefs", False), ("x", None, None, True), ("x-demo", ["ts"], None, True)], "n string, k array<string>, d string, t boolean", D.typed_package(f, F.col("k"), F.col("d"), F.col("t"))) == [True, True, False, True, False]
    urls = ["https://www.npmjs.com/a", "http://a.npmjs.com", "https://x.com:80/", "https://max.com/", "https://a.org/LICENSE.md", "https://a.org/docs", "nonsense", None, "https://me@github.com/a"]
    assert values(spark, [(u,) for u in urls], "u string", D.noise_url(F.col("u"))) == [True, True, True, False, True, False, True, True, True]


def test_example_sections(spark):
    page = "intro\n# One\nfirst code line here\nmore\n## Two ##\nlast   code\nline of it all"
    bodies = [("first code line here", None), ("last code line of it all", None), ("first code line here\nrewritten", None), ("intro", None), ("absent", None), ("", None), (None, None), ("x", " S ")]
    got = values(spark, bodies, "b string, g string", D.example_section(F.lit(page), F.col("b"), F.col("g"), F.lit("T")))
    assert got == ["One", "Two ##", "One", "One", "One", "One", "One", "S"]
    assert values(spark, [("a", " T "), (None, " "), ("", None)], "m string, t string", D.example_section(F.col("m"), F.lit("a"), F.lit(None).cast("string"), F.col("t"))) == ["T", "General", "General"]


def test_keys_and_texts(spark):
    code = ["return { a, 'b c': 1, d : 2 }; return{a}", "return { ...x, 5: 1, text }", "no", None, "return {\n  kind:\n 1,\n}"]
    assert values(spark, [(c,) for c in code], "c string", D.return_keys(F.col("c"))) == [["a", "b c", "d"], ["text"], [], None, ["kind"]]
    assert values(spark, [(k,) for k in (["z", "kind", "text"], ["z"], [])], "k array<string>", D.shape_field(F.col("k"))) == ["text", "z", "text"]
    stats = [(0.2, 0, False), (999.4, 1234, False), (1000.0, 1, True), (9940.0, None, None), (10500.0, -3, False), (None, 1000000, True), (None, None, None)]
    assert values(spark, stats, "ms double, n long, e boolean", D.message_stats(F.col("ms"), F.col("n"), F.col("e"))) == ["1ms", "999ms · 1,234 tokens", "1.0s · ~1 tokens (est.)", "9.9s", "11s", "~1,000,000 tokens (est.)", None]
