"""Catalogues, families, sets, rankings over metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.tables import table
from .flows import expand_sets, with_precedence


def _docs(spark, d):
    """Documents as chunks: 50 to a page, the language as category, the source as section."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("page"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def page_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Per page: chunks, the longest title (first on a tie; the language stands for it), the first category."""
    title = F.max_by("lang", F.struct(F.length("lang"), -F.col("doc_id")))
    return _docs(spark, d).groupBy("page").agg(F.count("*").alias("chunks"), title.alias("title"), F.min_by("lang", "doc_id").alias("category"))


def category_section_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).rollup("lang", "source").agg(F.count("*").alias("chunks"), F.countDistinct("page").alias("pages"), F.grouping_id().alias("level"))
    return rows.select(F.col("lang").alias("category"), F.col("source").alias("section"), "chunks", "pages", F.col("level").cast("long").alias("level"))


def category_options(spark: SparkSession, d: str) -> DataFrame:
    tags = _docs(spark, d).select(F.explode(F.array_distinct(F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short")))).alias("category"))
    return tags.groupBy("category").agg(F.count("*").alias("documents"))


def family_versions(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation stand for versions of a family: the newest first, and the next free number."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("versions"), F.max("c_custkey").alias("newest"))
    return per.select(F.col("c_nationkey").alias("family"), "versions", "newest", (F.col("newest") + 1).alias("next_version"))


def source_set_expand(spark: SparkSession, d: str) -> DataFrame:
    """Sets of source ids, one of each customer, to suppliers in the order of the array; ids that are not there are dropped."""
    k = F.col("c_custkey")
    sets = table(spark, d, "customer").select(k.alias("set_id"), F.array(k + 3, k % 7, F.lit(-5).cast("long"), k).alias("ids"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return expand_sets(sets, sources).select("set_id", F.array_join("names", ",").alias("names"))


def page_rank_order(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by account balance, unknown ones last, ties by key; as a share of the ranking.

    The ranks are global, so rows are ranked within ranges of the balance and shifted by the sizes of the ranges above.
    """
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("score"))
    cell = F.when(F.col("score").isNull(), F.lit(1e18)).otherwise(F.floor(-F.col("score") / 100))
    cells = s.withColumn("cell", cell)
    above = cells.groupBy("cell").count().withColumn("above", F.coalesce(F.sum("count").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("cell", "above")
    own = F.row_number().over(W.partitionBy("cell").orderBy(F.desc_nulls_last("score"), "s_suppkey"))
    return cells.withColumn("own", own).join(above, "cell").select("s_suppkey", (F.col("own") + F.col("above")).cast("long").alias("place"))


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type, with its value: later rows overwrite earlier ones, others stay."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return last.select("user_id", "event_type", F.col("x.event_id").alias("event_id"), F.round("x.value", 6).alias("value"))


def local_over_cloud(spark: SparkSession, d: str) -> DataFrame:
    """Two stores of parts: the local row of an id wins."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return with_precedence([p.filter("id % 2 = 0"), p.withColumn("name", F.lower("name"))], "id")


def collapse_by_url(spark: SparkSession, d: str) -> DataFrame:
    """One part per brand: the dearest, ties to the smaller key."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("price"))
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("price", -F.col("p_partkey"))).alias("p_partkey"), F.count("*").alias("members"))


def owner_join(spark: SparkSession, d: str) -> DataFrame:
    """Sources of an owner's projects that are not global: customers, their orders, and a status."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    joined = o.filter(F.col("o_orderstatus") != "P").join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.round(F.sum("price"), 2).alias("total"))


def pages_per_root(spark: SparkSession, d: str) -> DataFrame:
    """Nations as roots: suppliers and customers of each, with 0 where there are none."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    return n.join(s, "n_nationkey", "left").select("n_name", F.coalesce("s", F.lit(0)).alias("suppliers"))


def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("orders"))


def catalog_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by size until a budget of characters is spent: stops at the first group that does not fit.

    One row for each source is ordered in one task, as a catalogue of sources is.
    """
    g = _docs(spark, d).groupBy("source").agg(F.sum("n_chars").alias("chars"))
    spent = F.sum("chars").over(W.orderBy(F.desc("chars"), "source"))
    total = F.sum("chars").over(W.partitionBy())
    return g.withColumn("spent", spent).withColumn("total", total).filter(F.col("spent") * 2 <= F.col("total")).select("source", "chars", "spent")


def json_path_switch(spark: SparkSession, d: str) -> DataFrame:
    """A value by JSON path, compared as a number; what is no number counts as false."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    json = F.concat(F.lit('{"k":'), F.when(i % 3 == 0, F.concat(F.lit("-"), k)).when(i % 3 == 1, F.concat(k, F.lit(".5e-1"))).otherwise(k), F.lit("}"))
    v = X.number(F.get_json_object(json, "$.k"))
    branch = F.when(F.coalesce(v >= 50, F.lit(False)), "high").when(F.coalesce(v < 10, F.lit(False)), "low").otherwise("default")
    return table(spark, d, "events").groupBy(branch.alias("branch")).agg(F.count("*").alias("events"))


QUERIES = {
    "page_catalog": page_catalog, "category_section_rollup": category_section_rollup, "category_options": category_options, "family_versions": family_versions,
    "source_set_expand": source_set_expand, "page_rank_order": page_rank_order, "latest_wins": latest_wins, "local_over_cloud": local_over_cloud, "collapse_by_key": collapse_by_url,
    "owner_join": owner_join, "pages_per_root": pages_per_root, "conditional_counts": conditional_counts, "catalog_groups": catalog_groups, "json_path_switch": json_path_switch,
}

_D = "d AS (SELECT doc_id, lang, source, source || '/' || (doc_id // 50)::VARCHAR AS page, coalesce(n_chars, 0) AS n_chars FROM documents)"
ORACLE_SQL = {
    "page_catalog": f"WITH {_D} SELECT page, count(*) AS chunks, first(lang ORDER BY length(lang) DESC, doc_id) AS title, first(lang ORDER BY doc_id) AS category FROM d GROUP BY 1",
    "category_section_rollup": f"WITH {_D} SELECT lang AS category, source AS section, count(*) AS chunks, count(DISTINCT page) AS pages, grouping(lang, source)::BIGINT AS level FROM d GROUP BY ROLLUP (lang, source)",
    "category_options": f"WITH {_D}, t AS (SELECT lang AS category FROM d UNION ALL SELECT CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END FROM d) SELECT category, count(*) AS documents FROM t GROUP BY 1",
    "family_versions": "SELECT c_nationkey AS family, count(*) AS versions, max(c_custkey) AS newest, max(c_custkey) + 1 AS next_version FROM customer GROUP BY 1",
    "source_set_expand": """WITH s AS (SELECT c_custkey AS set_id, [c_custkey + 3, c_custkey % 7, -5, c_custkey] AS ids FROM customer)
SELECT set_id, string_agg(s_name, ',' ORDER BY pos) AS names FROM s, unnest(ids) WITH ORDINALITY AS u(id, pos) JOIN supplier ON s_suppkey = id GROUP BY 1""",
    "page_rank_order": "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal::DOUBLE DESC NULLS LAST, s_suppkey) AS place FROM supplier",
    "latest_wins": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "local_over_cloud": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE lower(p_brand) END AS name FROM part",
    "collapse_by_key": "SELECT p_brand, first(p_partkey ORDER BY p_retailprice::DOUBLE DESC, p_partkey) AS p_partkey, count(*) AS members FROM part GROUP BY 1",
    "owner_join": "SELECT c_nationkey, count(*) AS orders, round(sum(o_totalprice::DOUBLE), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1",
    "pages_per_root": "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "conditional_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS orders FROM orders GROUP BY 1",
    "catalog_groups": f"WITH {_D}, g AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM d GROUP BY 1), s AS (SELECT *, sum(chars) OVER (ORDER BY chars DESC, source)::BIGINT AS spent, sum(chars) OVER () AS total FROM g) SELECT source, chars, spent FROM s WHERE spent * 2 <= total",
    "json_path_switch": "WITH v AS (SELECT try_cast(CASE event_id % 3 WHEN 0 THEN '-' || k WHEN 1 THEN k || '.5e-1' ELSE k END AS DOUBLE) AS v FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)) SELECT CASE WHEN coalesce(v >= 50, false) THEN 'high' WHEN coalesce(v < 10, false) THEN 'low' ELSE 'default' END AS branch, count(*) AS events FROM v GROUP BY 1",
}
