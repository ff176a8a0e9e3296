"""Package and link noise, the section of an example, keys that code returns, and display strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table
from .structure import _MD, _markdown

# Names of packages that are no subject of documentation, hosts that document nothing, and heads of packages kept in any case.
INFRA_NAMES = [
    "uuid", "nanoid", "ms", "chalk", "debug", "semver", "minimatch", "glob", "rimraf", "wrappy", "once", "inherits", "safe-buffer", "string_decoder", "readable-stream", "source-map",
    "source-map-js", "picocolors", "tslib", "scheduler", "loose-envify", "object-assign", "prop-types", "react-is", "csstype", "type-fest", "ajv", "clsx", "postcss", "ws", "undici", "rollup",
    "acorn", "yallist", "lru-cache",
]
INFRA_HEADS = "^(is-|has-|get-|set-|strip-|wrap-|path-|fs-|json-|cross-|npm-|node-)"
INFRA_EXCEPT = ["node-fetch", "node-html-parser"]
JUNK_PARTS = ["boilerplate", "starter", "template", "example"]
JUNK_ENDS = "-demo$|^create-|^eslint-config-|^eslint-plugin-"
POPULAR_HEADS = "^(react|vue|svelte|express|next|nuxt|vite|webpack|eslint|jest|vitest|zod|axios|lodash|cheerio|jsdom|playwright|cypress|prisma|mongoose|redux|graphql|langchain|langsmith|langgraph)|^@langchain/"
TYPED_WORDS = r"\btypescript\b|\btype[ -]?safe\b|\btyped\b"
NOISE_HOSTS = [
    "npmjs.com", "img.shields.io", "shields.io", "badge.fury.io", "travis-ci.org", "travis-ci.com", "codecov.io", "coveralls.io", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be",
    "discord.gg", "discord.com", "opensource.org", "spdx.org", "creativecommons.org", "github.com",
]
PREFERRED_FIELDS = ["text", "kind", "value", "message", "data"]
LEAST_LINE, LEAST_COMPACT, COMPACT_CHARS = 12, 16, 120


def infra_package(name: Column) -> Column:
    """Whether a package is plumbing; no name is."""
    named = F.coalesce(name, F.lit(""))
    helper = F.regexp_like(F.lower(named), F.lit(INFRA_HEADS)) & ~named.isin(INFRA_EXCEPT)
    return (named == "") | F.startswith(named, F.lit("@types/")) | helper | named.isin(INFRA_NAMES)


def junk_package(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.regexp_like(n, F.lit("|".join(JUNK_PARTS) + "|" + JUNK_ENDS))


def typed_package(name: Column, keywords: Column, description: Column, types: Column) -> Column:
    """Whether a package is for TypeScript users: typed, said to be by its keywords or description, or popular; junk never."""
    words = F.exists(F.coalesce(keywords, F.expr("cast(array() as array<string>)")), lambda k: F.coalesce(F.contains(F.lower(k), F.lit("typescript")) | F.lower(k).isin("ts", "types"), F.lit(False)))
    said = F.regexp_like(F.lower(F.coalesce(description, F.lit(""))), F.lit(TYPED_WORDS))
    return ~junk_package(name) & (F.coalesce(types, F.lit(False)) | words | said | F.regexp_like(F.lower(F.coalesce(name, F.lit(""))), F.lit(POPULAR_HEADS)))


def noise_url(url: Column) -> Column:
    """Whether a link documents nothing: badges, social sites, registries and licenses; what is no url is noise."""
    host = F.regexp_replace(F.regexp_replace(X.url_host(url), "^[^@]*@|:[0-9]*$", ""), r"^www\.", "")
    path = F.lower(X.url_path(url))
    return F.coalesce((host == "") | host.isin(NOISE_HOSTS) | F.endswith(host, F.lit(".npmjs.com")) | F.contains(path, F.lit("/license")), F.lit(True))


def _headings(markdown: Column) -> Column:
    titles = F.transform(F.split(markdown, "\n"), lambda x: X.trim_all(F.regexp_extract(X.trim_all(x), r"^#{1,6}\s+(.+)$", 1)))
    return F.filter(titles, lambda t: t != "")


def example_place(markdown: Column, body: Column) -> Column:
    """Characters before an example in a page: where its text is, else its first line of LEAST_LINE characters or more, else about where
    its first COMPACT_CHARS characters are with white space run together; -1 if nowhere."""
    needle = X.trim_all(body)
    first = F.get(F.filter(F.transform(F.split(needle, "\n"), lambda x: X.trim_all(x)), lambda x: x != ""), F.lit(0))
    compact = lambda c: X.trim_all(F.regexp_replace(c, r"\s+", " "))
    short, page = F.substring(compact(needle), 1, COMPACT_CHARS), compact(markdown)
    whole, line, loose = F.instr(markdown, needle), F.when(F.length(first) >= LEAST_LINE, F.instr(markdown, first)), F.when(F.length(short) >= LEAST_COMPACT, F.instr(page, short))
    about = F.floor((loose - 1) / F.greatest(F.length(page), F.lit(1)) * F.length(markdown)).cast("int")
    return F.coalesce(F.when(needle == "", -1).when(whole > 0, whole - 1).when(line > 0, line - 1).when(loose > 0, about), F.lit(-1))


def example_section(markdown: Column, body: Column, given: Column, title: Column) -> Column:
    """The section of an example: what is given, else the nearest heading above it, else the page's first, else its title, else General."""
    said = lambda c: F.nullif(X.trim_all(c), F.lit(""))
    page = F.coalesce(markdown, F.lit(""))
    above = F.substr(page, F.lit(1), F.greatest(example_place(page, F.coalesce(body, F.lit(""))), F.lit(0)))
    return F.coalesce(said(given), F.try_element_at(_headings(above), F.lit(-1)), F.get(_headings(page), F.lit(0)), said(title), F.lit("General"))


def return_keys(code: Column) -> Column:
    """The different keys of the object literals that code returns, in order; literals are cut at their first brace."""
    parts = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"return\s*\{([^}]*)\}"), 1), lambda b: F.split(b, ",")))
    plain = lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*(?::|$)", 1)
    quoted = lambda p: F.regexp_extract(p, r"""^\s*['"]([^'"]+)['"]\s*:""", 1)
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.when(plain(p) != "", plain(p)).otherwise(quoted(p))), lambda k: k != ""))


def shape_field(keys: Column) -> Column:
    """The key that shows an output: the first preferred one it has, else its first, else text."""
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(p) for p in PREFERRED_FIELDS]), lambda p: F.array_contains(keys, p)), F.lit(0)), F.get(keys, F.lit(0)), F.lit("text"))


def duration_text(ms: Column) -> Column:
    """Milliseconds, tenths of a second below ten seconds, whole seconds from there; halves go up."""
    whole = F.floor(ms + 0.5).cast("long")
    seconds = F.format_string("%.1fs", ms / 1000)
    return F.when(ms < 1000, F.concat(F.greatest(F.lit(1), whole).cast("string"), F.lit("ms"))).when(ms < 10000, seconds).otherwise(F.concat(F.floor(ms / 1000 + 0.5).cast("string"), F.lit("s")))


def tokens_text(tokens: Column, estimated: Column) -> Column:
    n = F.format_number(F.greatest(F.lit(0), tokens), 0)
    return F.when(estimated, F.concat(F.lit("~"), n, F.lit(" tokens (est.)"))).otherwise(F.concat(n, F.lit(" tokens")))


def message_stats(ms: Column, tokens: Column, estimated: Column) -> Column:
    """Duration and tokens where they are above zero; null where neither is."""
    return F.nullif(F.concat_ws(" · ", F.when(ms > 0, duration_text(ms)), F.when(tokens > 0, tokens_text(tokens, estimated))), F.lit(""))


# --- queries over the tables ---------------------------------------------------------------------------------------


def package_noise(spark: SparkSession, d: str) -> DataFrame:
    """The words of every text as names of packages, with the text's source as a keyword and whether they are noise."""
    docs = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:-[a-z]+)*"), 0)).alias("name"))
    named = docs.groupBy("name").agg(F.min("lang").alias("lang"), F.count("*").alias("n"))
    typed = typed_package(F.col("name"), F.array(F.when(F.col("n") % 7 == 0, "TypeScript-first").otherwise(F.col("lang"))), F.concat(F.lit("a type"), F.when(F.col("n") % 5 == 0, "-safe ").otherwise("writer "), "name"), F.col("n") % 11 == 0)
    return named.select("name", infra_package(F.col("name")).alias("infra"), junk_package(F.col("name")).alias("junk"), typed.alias("typed"))


def noise_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of every page, and its own url on a host of the list in turn."""
    i = F.col("page_id")
    moved = F.regexp_replace("url", "://[^/?#]*", "")
    hosts = F.array(*[F.lit(h) for h in NOISE_HOSTS])
    other = F.concat(F.lit("https://www."), F.get(hosts, (i % (2 * len(NOISE_HOSTS))).cast("int")), F.regexp_replace(moved, "^https?", ""))
    pages = table(spark, d, "pages").select("page_id", F.coalesce(F.when(i % 2 == 0, other), F.col("url")).alias("url"))
    return pages.select("page_id", noise_url(F.col("url")).alias("noise"))


def example_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section of a line of each document with headings, the line that its number gives."""
    md = _markdown(spark, d)
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.startswith(x, F.lit("#")))
    body = F.get(lines, (F.col("doc_id") % F.greatest(F.size(lines), F.lit(1))).cast("int"))
    given = F.when(F.col("doc_id") % 17 == 0, F.lit(" Given "))
    return md.select("doc_id", example_section(F.col("text"), body, given, F.concat(F.lit("Page "), F.col("doc_id").cast("string"))).alias("section"))


def returned_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document as an object that code returns, with its words as keys; every third document quotes its last key."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[{}'\"]", "")
    body = F.regexp_replace(F.regexp_replace(text, " ", ", "), "\n", " }\nreturn { ")
    code = F.concat(F.lit("return { "), body, F.when(F.col("doc_id") % 3 == 0, F.lit(", 'message' : 1 }")).otherwise(F.lit(" }")))
    keys = return_keys(code)
    return table(spark, d, "documents").select("doc_id", F.size(keys).cast("long").alias("keys"), F.sha2(F.array_join(keys, " "), 256).alias("keys_hash"), shape_field(keys).alias("field"))


def event_stats_text(spark: SparkSession, d: str) -> DataFrame:
    ms, tokens = F.round(F.col("value") * 100), F.col("event_id") * 37 - 500
    return table(spark, d, "events").select("event_id", message_stats(ms, tokens, F.col("user_id") % 2 == 0).alias("stats"))


QUERIES = {"package_noise": package_noise, "noise_links": noise_links, "example_sections": example_sections, "returned_keys": returned_keys, "event_stats_text": event_stats_text}

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ORACLE_SQL = {
    "package_noise": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*')) AS name FROM documents), g AS (SELECT name, min(lang) AS lang, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT *, split_part(name, '-', 1) AS head, list_bool_or(list_transform({_list(JUNK_PARTS)}, lambda p: contains(name, p))) OR name LIKE '%-demo' OR name LIKE 'create-%' OR name LIKE 'eslint-config-%' OR name LIKE 'eslint-plugin-%' AS junk FROM g)
SELECT name, list_contains({_list(INFRA_NAMES)}, name) OR (contains(name, '-') AND head IN ('is', 'has', 'get', 'set', 'strip', 'wrap', 'path', 'fs', 'json', 'cross', 'npm', 'node') AND name NOT IN ('node-fetch', 'node-html-parser')) AS infra, junk,
  NOT junk AND (n % 11 = 0 OR n % 7 = 0 OR coalesce(contains(lang, 'typescript') OR lang IN ('ts', 'types'), false) OR n % 5 = 0 OR contains('-' || name || '-', '-typescript-') OR contains('-' || name || '-', '-typed-') OR regexp_matches(name, '\\btype-?safe\\b')
    OR list_bool_or(list_transform(string_split('react vue svelte express next nuxt vite webpack eslint jest vitest zod axios lodash cheerio jsdom playwright cypress prisma mongoose redux graphql langchain langsmith langgraph', ' '), lambda p: starts_with(name, p)))) AS typed FROM h""",
    "noise_links": f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, url FROM pages),
v AS (SELECT *, page_id % 2 = 0 AND page_id % {2 * len(NOISE_HOSTS)} < {len(NOISE_HOSTS)} AND url IS NOT NULL AS moved FROM u)
SELECT page_id, moved OR url IS NULL OR host = '' OR list_contains({_list(NOISE_HOSTS)}, regexp_replace(lower(host), '^www[.]', '')) OR lower(host) LIKE '%.npmjs.com' OR contains(lower(path), '/license') AS noise FROM v""",
    "example_sections": rf"""WITH {_MD},
k AS (SELECT doc_id, list(x ORDER BY i) AS xs, string_agg(CASE WHEN lv > 0 THEN repeat('#', lv::INT) || ' H' || i || chr(10) ELSE '' END || x, chr(10) ORDER BY i) AS t FROM md1 GROUP BY 1),
b AS (SELECT doc_id, t, regexp_replace(xs[(doc_id % len(xs)) + 1], '^\s+|\s+$', '', 'g') AS body FROM k),
p AS (SELECT *, CASE WHEN body = '' THEN '' ELSE left(t, instr(t, body) - 1) END AS above FROM b)
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'Given' ELSE coalesce(list_last(regexp_extract_all(above, '(?m)^#+ (H[0-9]+)$', 1)), list_first(regexp_extract_all(t, '(?m)^#+ (H[0-9]+)$', 1)), 'Page ' || doc_id) END AS section FROM p""",
    "returned_keys": r"""WITH l AS (SELECT doc_id, line, n FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[{}''"]', '', 'g'), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS u(line, n)),
v AS (SELECT doc_id, n, x, m FROM l, unnest(string_split(line, ' ')) WITH ORDINALITY AS u(x, m)), w AS (SELECT doc_id, n, m, j, p FROM v, unnest(string_split(x, ',')) WITH ORDINALITY AS u(p, j)),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, m, j) AS o, regexp_extract(p, '^\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*(:|$)', 1) AS k FROM w
  UNION ALL SELECT doc_id, 1::BIGINT << 40, 'message' FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT doc_id, k, min(o) AS o FROM c WHERE k <> '' GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS keys, string_agg(k, ' ' ORDER BY o) AS s, list(k ORDER BY o) AS ks FROM k GROUP BY 1)
SELECT doc_id, coalesce(keys, 0) AS keys, sha256(coalesce(s, '')) AS keys_hash, coalesce(list_filter(['text', 'kind', 'value', 'message', 'data'], lambda p: list_contains(ks, p))[1], ks[1], 'text') AS field FROM documents LEFT JOIN g USING (doc_id)""",
    "event_stats_text": """WITH e AS (SELECT event_id, round(value * 100)::BIGINT AS ms, event_id * 37 - 500 AS n, user_id % 2 = 0 AS est FROM events),
t AS (SELECT event_id, CASE WHEN ms <= 0 THEN NULL WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 10000 THEN ((ms + 50) // 1000) || '.' || ((ms + 50) // 100 % 10) || 's' ELSE ((ms + 500) // 1000) || 's' END AS a,
  CASE WHEN n <= 0 THEN NULL WHEN est THEN '~' || format('{:,}', n) || ' tokens (est.)' ELSE format('{:,}', n) || ' tokens' END AS b FROM e)
SELECT event_id, nullif(concat_ws(' · ', a, b), '') AS stats FROM t""",
}
