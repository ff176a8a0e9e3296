"""Urls and crawl lists: segments, canonical keys, scope, clusters, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.tables import table

EXCLUDE, INCLUDE = ("/de/", ".html"), ("/en/", "/fr/")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def url_segments(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", X.url_host(u).alias("host"), X.url_path(u).alias("path"), X.url_segment(u, 0, "root").alias("category"), X.url_segment(u, 1, "general").alias("section"), X.registrable_domain(X.url_host(u)).alias("domain"))


def url_ids(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", X.url_hash(u).alias("url_hash"), X.chunk_id(F.lit("web"), u, F.lit(0)).alias("chunk_id"), X.slugify(u).alias("slug"), X.path_id(u).alias("path_id"))


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


def canonical_dedupe(df: DataFrame) -> DataFrame:
    """page_id, url in order of page_id -> kept row per canonical url: no query first, then no fragment, then the earliest.

    A kept row stands at the place of the first member of its group. Groups are ranked by window, with partial sums by key.
    """
    keyed = df.withColumn("canonical", X.canonical_url(F.col("url")))
    preference = F.when(F.contains("url", F.lit("?")), 2).otherwise(0) + F.when(F.contains("url", F.lit("#")), 1).otherwise(0)
    best = keyed.groupBy("canonical").agg(F.min(F.struct(preference.alias("p"), "page_id", "url")).alias("b"), F.min("page_id").alias("place"), F.count("*").alias("members"))
    return best.select("canonical", F.col("b.page_id").alias("page_id"), F.col("b.url").alias("url"), "place", "members")


def canonical_dedupe_q(spark: SparkSession, d: str) -> DataFrame:
    return canonical_dedupe(pages(spark, d))


def crawl_scope(df: DataFrame, exclude=EXCLUDE, include=INCLUDE) -> DataFrame:
    """The first reason to leave a url out: excluded, a download, out of scope; null if it is taken."""
    u = F.col("url")
    hit = lambda pats: F.greatest(*[F.contains(u, F.lit(p)).cast("int") for p in pats], F.lit(0)) == 1
    reason = F.when(hit(exclude), "excluded").when(F.regexp_like(X.url_path(u), F.lit(r"(?i)([.]pdf$|[.]pdf/)")), "download").when(~hit(include), "out_of_scope")
    return df.select("page_id", reason.alias("reason"))


def crawl_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return crawl_scope(pages(spark, d))


def path_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The 12 first segments with the most urls, and their first three page ids (a report, so limited)."""
    seg = pages(spark, d).withColumn("segment", X.url_segment(F.col("url"), 0, "root"))
    n = F.row_number().over(W.partitionBy("segment").orderBy("page_id"))
    first = seg.withColumn("n", n).filter("n <= 3").groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("samples"))
    top = seg.groupBy("segment").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "segment").limit(12)
    return top.join(first, "segment")


def path_prefix_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every path prefix to depth 4 with its urls; the 40 largest (a report, so limited)."""
    segs = X.path_segments(X.url_path(F.col("url")))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(segs))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segs, F.lit(1), i), "/")))
    rows = pages(spark, d).filter(F.size(segs) > 0).select(F.explode(prefixes).alias("prefix"))
    return rows.groupBy("prefix").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "prefix").limit(40)


def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """Both prefix predicates against the root of each page's host and first segment under https."""
    u = F.col("url")
    root = F.concat(F.lit("https://"), F.regexp_replace(X.url_host(u), "^www[.]", ""), F.lit("/"), X.url_segment(u, 0, ""))
    return pages(spark, d).select("page_id", X.under_prefix(u, root).alias("same_origin"), X.under_prefix_any_host(u, root).alias("any_host"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of all pages by target, with how often and from how many pages."""
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)'), 1)).alias("href"))
    return rows.groupBy("href").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


def longest_root(spark: SparkSession, d: str) -> DataFrame:
    """Each page's crawl root with the longest path: an equi-join on host and an exploded list of its path prefixes."""
    u = F.col("url")
    p = pages(spark, d).withColumn("host", X.url_host(u)).withColumn("segs", X.path_segments(X.url_path(u)))
    roots = p.groupBy("host", X.url_segment(u, 0, "").alias("seg")).count().filter("count >= 2").select("host", F.concat(F.lit("/"), "seg").alias("root"))
    roots = roots.unionByName(p.select("host", F.lit("/").alias("root"))).distinct()
    tries = p.select("page_id", "host", F.explode(F.transform(F.sequence(F.lit(0), F.size("segs")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("segs", F.lit(1), i), "/")))).alias("root"))
    return tries.join(roots, ["host", "root"]).groupBy("page_id").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("root"))


def version_hints(spark: SparkSession, d: str) -> DataFrame:
    """Path segments that look like a version or a preview, the 30 most frequent (a report, so limited)."""
    seg = F.explode(X.path_segments(F.lower(X.url_path(F.col("url")))))
    rows = pages(spark, d).select(seg.alias("segment")).filter(F.regexp_like("segment", F.lit(r"^(v?[0-9]+([.][0-9]+)*|next|canary|beta|alpha|preview|legacy)$")))
    return rows.groupBy("segment").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "segment").limit(30)


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first title that is not weak: title, first h1; else the slug."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"^\s+|\s+$", "")
    title = clean(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    h1 = clean(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1))
    weak = lambda c: (F.length(c) < 3) | F.lower(c).isin("home", "docs", "documentation", "index", "untitled")
    return table(spark, d, "pages").select("page_id", F.when(~weak(title), title).when(~weak(h1), h1).otherwise(F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)).alias("title"))


QUERIES = {
    "url_segments": url_segments, "url_ids": url_ids, "canonical_keys": canonical_keys, "canonical_dedupe": canonical_dedupe_q, "crawl_url_filter": crawl_url_filter,
    "page_path_breakdown": path_breakdown, "path_prefix_clusters": path_prefix_clusters, "url_prefix_match": prefix_match, "page_links": page_links,
    "longest_crawl_root": longest_root, "version_hints": version_hints, "page_titles": page_titles,
}

_U = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u)"""
_CANON = _U + r""", c AS (SELECT *, list_filter(segs, lambda x: NOT regexp_full_match(lower(x), 'v?[0-9]+([.][0-9]+)*')) AS kept,
  CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS h FROM s),
k AS (SELECT page_id, url, CASE WHEN scheme = '' THEN lower(trim(url)) ELSE scheme || '://' || h || CASE WHEN len(kept) > 0 THEN '/' || array_to_string(kept, '/') ELSE '' END END AS canonical FROM c)"""
ORACLE_SQL = {
    "url_segments": f"WITH {_U} SELECT page_id, host, path, coalesce(segs[1], 'root') AS category, coalesce(segs[2], 'general') AS section, array_to_string(string_split(regexp_replace(host, '^www[.]', ''), '.')[-2:], '.') AS domain FROM s",
    "url_ids": r"""WITH h AS (SELECT page_id, url, substr(translate(base64(unhex(sha256(url))), '+/', '-_'), 1, 32) AS x FROM pages)
SELECT page_id, x AS url_hash, 'web:' || x || ':0' AS chunk_id,
  substr(regexp_replace(regexp_replace(translate(lower(url), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug,
  'p' || lower(to_base(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(url, ''), lambda x: unicode(x)::HUGEINT)), lambda a, x: (a * 31 + x) % 4294967296)::BIGINT, 36)) AS path_id FROM h""",
    "canonical_keys": f"WITH {_CANON} SELECT page_id, canonical FROM k",
    "canonical_dedupe": f"""WITH {_CANON}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY CASE WHEN contains(url, '?') THEN 2 ELSE 0 END + CASE WHEN contains(url, '#') THEN 1 ELSE 0 END, page_id) AS n,
  min(page_id) OVER (PARTITION BY canonical) AS place, count(*) OVER (PARTITION BY canonical) AS members FROM k) SELECT canonical, page_id, url, place, members FROM r WHERE n = 1""",
    "crawl_url_filter": f"""WITH {_U} SELECT page_id, CASE WHEN contains(url, '/de/') OR contains(url, '.html') THEN 'excluded' WHEN regexp_matches(path, '(?i)([.]pdf$|[.]pdf/)') THEN 'download'
WHEN NOT (contains(url, '/en/') OR contains(url, '/fr/')) THEN 'out_of_scope' END AS reason FROM u""",
    "page_path_breakdown": f"""WITH {_U}, g AS (SELECT page_id, coalesce(segs[1], 'root') AS segment FROM s)
SELECT segment, count(*) AS urls, array_to_string(list_sort(list(page_id))[1:3], ',') AS samples FROM g GROUP BY segment ORDER BY urls DESC, segment LIMIT 12""",
    "path_prefix_clusters": f"WITH {_U}, p AS (SELECT '/' || array_to_string(segs[1:i], '/') AS prefix FROM s, unnest(range(1, least(4, len(segs)) + 1)) AS r(i)) SELECT prefix, count(*) AS urls FROM p GROUP BY 1 ORDER BY urls DESC, prefix LIMIT 40",
    "url_prefix_match": f"""WITH {_U}, r AS (SELECT *, regexp_replace(host, '^www[.]', '') AS bare, '/' || coalesce(segs[1], '') AS rp FROM s), b AS (SELECT *, rtrim(rp, '/') AS base FROM r)
SELECT page_id, scheme = 'https' AND host = bare AND (path = base OR starts_with(path, base || '/') OR base = '') AS same_origin, (path = base OR starts_with(path, base || '/') OR base = '') AS any_host FROM b""",
    "page_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href FROM pages) SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""",
    "longest_crawl_root": f"""WITH {_U}, roots AS (SELECT host, '/' || coalesce(segs[1], '') AS root FROM s GROUP BY 1, 2 HAVING count(*) >= 2 UNION SELECT host, '/' FROM s),
t AS (SELECT page_id, host, '/' || array_to_string(segs[1:i], '/') AS root FROM s, unnest(range(0, len(segs) + 1)) AS r(i))
SELECT page_id, arg_max(root, length(root)) AS root FROM t JOIN roots USING (host, root) GROUP BY 1""",
    "version_hints": f"""WITH {_U}, g AS (SELECT unnest(list_filter(string_split(lower(path), '/'), lambda x: x <> '')) AS segment FROM u)
SELECT segment, count(*) AS urls FROM g WHERE regexp_full_match(segment, '(v?[0-9]+([.][0-9]+)*|next|canary|beta|alpha|preview|legacy)') GROUP BY 1 ORDER BY urls DESC, segment LIMIT 30""",
    "page_titles": r"""WITH t AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g') AS a, regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '^\s+|\s+$', '', 'g') AS b FROM pages)
SELECT page_id, CASE WHEN length(a) >= 3 AND lower(a) NOT IN ('home', 'docs', 'documentation', 'index', 'untitled') THEN a WHEN length(b) >= 3 AND lower(b) NOT IN ('home', 'docs', 'documentation', 'index', 'untitled') THEN b
ELSE regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) END AS title FROM t""",
}
