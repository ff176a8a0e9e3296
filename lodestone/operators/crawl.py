"""Crawl files and page intake: sitemaps, robots, statuses, alternates, repository files, titles, icons, exclude patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import extract as E
from ..functions import text as X
from ..sources.tables import checkpointed, table
from .ranking import path_role
from .urls import pages

LLMS_BYTES, REPO_PAGE_BYTES = 512_000, 200_000
#: Path segments of pages that are seldom documentation.
NOISE_SEGMENTS = (
    "changelog", "changelogs", "blog", "blogs", "news", "release-notes", "releases", "tags", "tag", "authors", "author", "category", "categories",
    "archive", "archives", "legacy", "old", "canary", "nightly", "unstable", "preview", "alpha", "beta", "next", "versions", "version",
)
VERSIONISH = r"(?i)^(v[0-9]+([.][0-9]+)*(-[a-z0-9.]+)?|version-[0-9]+([.][0-9]+)*|[0-9]+[.][0-9]+([.][0-9]+)*(-[a-z0-9.]+)?)$"
#: Sections of a documentation site, and of what is none.
SECTION_NAMES = (
    "api", "apis", "changelog", "doc", "docs", "documentation", "example", "examples", "guide", "guides", "handbook", "learn", "reference", "releases",
    "sdk", "sdks", "spec", "specification", "tutorial", "tutorials",
)
SKIP_SECTIONS = ("about", "blog", "careers", "community", "contact", "discord", "github", "legal", "login", "news", "pricing", "privacy", "signin", "signup", "terms", "twitter")
#: Names of languages and what they stand for.
LANGUAGE_ALIASES = {
    "js": "javascript", "javascript": "javascript", "node": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "ts": "typescript", "typescript": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "python": "python", "python3": "python",
    "json": "json", "jsonc": "json", "json5": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "sh": "bash", "bash": "bash", "shell": "bash", "zsh": "bash",
    "shellscript": "bash", "docker": "docker", "dockerfile": "docker", "html": "html", "htm": "html", "xml": "xml", "svg": "xml", "css": "css", "scss": "scss",
    "sql": "sql", "go": "go", "golang": "go", "rust": "rust", "rs": "rust", "java": "java", "kotlin": "kotlin", "kt": "kotlin", "swift": "swift", "ruby": "ruby",
    "rb": "ruby", "php": "php", "csharp": "csharp", "c#": "csharp", "cs": "csharp", "cpp": "cpp", "c++": "cpp", "c": "c", "md": "markdown", "markdown": "markdown",
    "other": "other",
}
#: Endings of files that are read from a checkout.
REPO_EXTENSIONS = r"(?i)[.]([cm]?[jt]s|[jt]sx|md|mdx)$"
#: Folders of a checkout that are not walked.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "out", "coverage", "vendor", ".next", ".turbo", ".cache")


# --- crawl files ---------------------------------------------------------------------------------------------------


def expand_sitemaps(starts: DataFrame, files: DataFrame) -> DataFrame:
    """starts: root, url of sitemaps; files: url, xml -> root, url of every page that a sitemap or a nested one lists.

    A breadth-first walk, one join for each level of nesting until no new file is found: what is listed and is itself a file is
    opened in the next round, once. Lineage is cut by checkpoint() in each round.
    """
    listed = files.select(F.col("url").alias("file"), F.explode(E.sitemap_locations(F.col("xml"))).alias("url"))
    level = seen = checkpointed(starts.select("root", "url").distinct())
    found = starts.select("root", "url").limit(0)
    while not level.isEmpty():
        inside = checkpointed(level.select("root", F.col("url").alias("file")).join(listed, "file").select("root", "url").distinct())
        found = found.unionByName(inside)
        level = checkpointed(inside.join(files.select("url"), "url", "left_semi").join(seen, ["root", "url"], "left_anti").select("root", "url"))
        seen = seen.unionByName(level)
    return found.distinct().join(files.select("url"), "url", "left_anti").select("root", "url")


def discover(seeds: DataFrame, links: DataFrame, most: int = 1000, per_page: int = 500) -> DataFrame:
    """seeds: url; links: src, order, dst -> url, depth: what a crawl finds, breadth first, at most ``most`` pages.

    A frontier a round: the first links of each page of it that were not found before. The limits are those of a crawl; pages
    that come too late are the deepest, then the last by url. Lineage is cut by checkpoint() in each round.
    """
    n = F.row_number().over(W.partitionBy("src").orderBy("order"))
    few = links.withColumn("_n", n).filter(F.col("_n") <= per_page).select("src", F.col("dst").alias("url"))
    found = frontier = checkpointed(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not frontier.isEmpty() and found.count() < most:
        depth += 1
        fresh = few.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select("url").distinct().join(found, "url", "left_anti")
        frontier = checkpointed(fresh.withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    return found.orderBy("depth", "url").limit(most)


def link_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A site whose page n links to the pages 2n + 1, 2n + 2 and 0, crawled from the first."""
    p = pages(spark, d).select("page_id")
    u = lambda c: F.concat(F.lit("https://e.org/"), F.lpad(c.cast("string"), 9, "0"))
    links = p.select(u(F.col("page_id")).alias("src"), F.posexplode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.lit(0).cast("long"))).alias("order", "to"))
    links = links.join(p.withColumnRenamed("page_id", "to"), "to").select("src", "order", u(F.col("to")).alias("dst"))
    return discover(p.filter("page_id = 0").select(u(F.col("page_id")).alias("url")), links, most=150).withColumn("depth", F.col("depth").cast("long"))


def sitemap_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps made of the pages: an index for each domain, a file for each of its hosts."""
    p = pages(spark, d).select("url", X.url_host(F.col("url")).alias("host")).withColumn("root", X.registrable_domain(F.col("host")))
    loc = lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    hosts = p.groupBy("root", "host").agg(F.array_join(F.collect_list(loc(F.col("url"))), "\n").alias("xml"))
    address = F.concat(F.lit("sitemap:"), "host")
    index = hosts.groupBy("root").agg(F.array_join(F.collect_list(loc(address)), "\n").alias("xml")).select("root", F.concat(F.lit("index:"), "root").alias("url"), "xml")
    return expand_sitemaps(index, index.select("url", "xml").unionByName(hosts.select(address.alias("url"), "xml")))


def robots_files(spark: SparkSession, d: str) -> DataFrame:
    """robots.txt files made of the pages: their sitemaps and how many paths they disallow."""
    p = pages(spark, d).select(X.url_host(F.col("url")).alias("host"), X.url_segment(F.col("url"), 0, "root").alias("seg"))
    lines = p.groupBy("host").agg(F.array_join(F.collect_set(F.concat(F.lit("Disallow: /"), "seg")), "\n").alias("lines"))
    text = F.concat(F.lit("User-agent: *\n"), "lines", F.lit("\nDisallow:\nSitemap: https://"), "host", F.lit("/sitemap.xml\n"))
    return lines.select("host", F.array_join(E.robots_sitemaps(text), ",").alias("sitemaps"), E.robots_disallows(text).cast("long").alias("disallowed"))


def _status() -> Column:
    return F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 7 == 2, 503).when(F.col("page_id") % 7 != 1, 200)


def status_probe(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a status of 2xx, and why others are skipped."""
    return pages(spark, d).groupBy(E.status_reason(_status()).alias("reason")).agg(F.count("*").alias("pages"))


def markdown_alternates(u: Column) -> Column:
    """Where a page's own markdown may be; none for a url that is markdown."""
    base = F.substring_index(u, "#", 1)
    more = F.when(base.endswith("/"), F.concat(F.regexp_replace(base, "/$", ""), F.lit(".md")))
    return F.when(base.endswith(".md"), F.expr("cast(array() as array<string>)")).otherwise(F.array_compact(F.array(F.concat(base, F.lit(".md")), more)))


def is_markdown(content_type: Column, body: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(kind, F.lit("text/markdown")) | (~F.contains(kind, F.lit("text/html")) & F.regexp_like(body, F.lit(r"^\s*[#>]")))


def markdown_alternate_pages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("text/markdown"), F.lit(None).cast("string")), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\n# "), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.array_join(markdown_alternates(F.col("url")), " ").alias("alternates"), is_markdown(kind, body).alias("markdown"))


def llms_text(body: Column) -> Column:
    """A root text file: null where it is blank or html; at most LLMS_BYTES bytes, whole characters."""
    cut = F.decode(F.substring(F.encode(body, "utf-8"), 1, LLMS_BYTES), "utf-8")
    whole = F.when(F.octet_length(body) <= LLMS_BYTES, body).otherwise(F.regexp_replace(cut, "\\uFFFD+$", ""))
    return F.when(~F.regexp_like(body, F.lit(r"^\s*$")) & ~F.regexp_like(body, F.lit(r"(?i)^\s*<(!doctype|html)")), whole)


def llms_files(spark: SparkSession, d: str) -> DataFrame:
    """Root files made of the documents: every third is html, every fifth blank, every seventh longer than the limit."""
    text = F.coalesce("text", F.lit(""))
    long = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# x\n"), F.repeat(F.lit("y"), LLMS_BYTES))).otherwise(F.concat(F.lit("# x\n"), text))
    body = F.when(F.col("doc_id") % 3 == 0, F.lit(" <!DOCTYPE html><p>")).when(F.col("doc_id") % 5 == 0, F.lit("\n ")).otherwise(long)
    return table(spark, d, "documents").select("source", llms_text(body).alias("t")).groupBy("source").agg(F.count("t").alias("files"), F.sum(F.octet_length("t")).cast("long").alias("bytes"))


# --- repository files ----------------------------------------------------------------------------------------------


def file_drop_reason(path: Column, tests: bool = False, docs: bool = False) -> Column:
    """Null for a file that is indexed, else why the walk leaves it out."""
    segs = X.path_segments(path)
    dirs = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    role = path_role(path)
    reason = F.when(F.exists(dirs, lambda s: s.isin(*SKIP_DIRS)), "skipped_folder").when(~F.regexp_like(path, F.lit(REPO_EXTENSIONS)), "extension")
    if not tests:
        reason = reason.when(role == "test", "test")
    if not docs:
        reason = reason.when(F.regexp_like(path, F.lit(r"(?i)[.]mdx?$")), "readme")
    return reason


def _files(spark, d):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".md", ".test.ts", ".png", ".tsx")]), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "node_modules", "lib", "docs")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(folder, F.lit("/"), F.concat_ws("/", X.url_segment(F.col("url"), 0, "root"), F.col("page_id").cast("string")), ending).alias("path"), F.octet_length("html").alias("bytes"), "html")


def repo_walk(spark: SparkSession, d: str) -> DataFrame:
    """How many files the walk keeps (null) and drops, by reason."""
    return _files(spark, d).groupBy(file_drop_reason(F.col("path")).alias("reason")).agg(F.count("*").alias("files"))


def repo_page_load(spark: SparkSession, d: str) -> DataFrame:
    """Files that are indexed: within the size limit, not empty, with their role and language."""
    language = F.when(F.regexp_like("path", F.lit("(?i)[.]mdx?$")), "markdown").when(F.regexp_like("path", F.lit("(?i)[.]([mc]?ts|tsx)$")), "ts").when(F.regexp_like("path", F.lit("(?i)[.]([mc]?js|jsx)$")), "js")
    fits = (F.col("bytes") <= REPO_PAGE_BYTES) & ~F.regexp_like("html", F.lit(r"^\s*$"))
    return _files(spark, d).filter(file_drop_reason(F.col("path"), tests=True, docs=True).isNull() & fits).select("page_id", "path", path_role(F.col("path")).alias("role"), language.alias("language"))


# --- titles, links, icons ------------------------------------------------------------------------------------------


def weak_title(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) < 3) | F.regexp_like(t, F.lit(r"(?i)^(docs?|documentation|home|overview|untitled|page)$")) | F.regexp_like(t, F.lit(r"(?i)^https?://"))


def resolve_title(url: Column, candidates: list[Column]) -> Column:
    """The first strong candidate (the url's slug is the last), else the first, else the url."""
    every = F.array_compact(F.transform(F.array(*candidates, X.title_from_slug(url)), lambda c: F.nullif(F.trim(c), F.lit(""))))
    return F.coalesce(F.get(F.filter(every, lambda c: ~weak_title(c)), F.lit(0)), F.get(every, F.lit(0)), url)


def title_candidates(html: Column, markdown: Column) -> list[Column]:
    """From a page: title, meta title, first h1, first strong markdown heading of level 1 or 2."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    heads = F.filter(F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*#{1,2}\s+(.+)$"), 1), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\s+", " "))), lambda h: ~weak_title(h))
    return [plain(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)), F.regexp_extract(html, r'<meta[^>]*(?:property|name)="(?:og|twitter):title"[^>]*content="([^"]*)"', 1), plain(F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1)), F.get(heads, F.lit(0))]


def page_title_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages of which every third has a weak title, and every fifth a weak heading too."""
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "<title>Docs</title>")).otherwise(F.col("html"))
    html = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(html, "<h1[^>]*>[^<]*</h1>", "<h1>Home</h1>")).otherwise(html)
    markdown = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("text\n## Page\n# [Guide](/g) to "), F.col("page_id").cast("string"))).otherwise("")
    return table(spark, d, "pages").withColumn("h", html).withColumn("m", markdown).select("page_id", resolve_title(F.col("url"), title_candidates(F.col("h"), F.col("m"))).alias("title"))


def absolute(href: Column, page: Column) -> Column:
    """A link as an absolute url without its fragment: absolute, of the page's scheme, of its site or below its folder."""
    origin = F.concat(X.url_scheme(page), F.lit("://"), X.url_host(page))
    folder = F.regexp_replace(X.url_path(page), "[^/]*$", "")
    full = F.when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(X.url_scheme(page), F.lit(":"), href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(origin, folder, href))
    return F.regexp_replace(full, "#.*$", "")


def same_origin_links(hrefs: Column, page: Column) -> Column:
    """The distinct absolute links of a page that stay on its origin, in order."""
    origin = F.concat(X.url_scheme(page), F.lit("://"), X.url_host(page))
    full = F.transform(F.filter(hrefs, lambda h: ~F.startswith(h, F.lit("#"))), lambda h: absolute(h, page))
    return F.array_distinct(F.filter(full, lambda u: F.concat(X.url_scheme(u), F.lit("://"), X.url_host(u)) == origin))


def _hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1)


def page_site_links(spark: SparkSession, d: str) -> DataFrame:
    links = same_origin_links(F.concat(_hrefs(F.col("html")), F.array(F.lit("sub/page#x"), F.lit("https://elsewhere.example.org/"), F.col("url"))), F.col("url"))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.sha2(F.array_join(links, "\n"), 256).alias("links_hash"))


def header_nav_paths(url: Column, html: Column, sections=SECTION_NAMES, most: int = 8) -> Column:
    """Paths of a page's first header or navigation that lead to other sections of its documentation, at most eight."""
    scope = F.coalesce(F.nullif(F.regexp_extract(html, "(?s)<header[^>]*>(.*?)</header>", 1), F.lit("")), F.regexp_extract(html, "(?s)<nav[^>]*>(.*?)</nav>", 1))
    here = F.coalesce(F.nullif(F.regexp_replace(X.url_path(url), "/+$", ""), F.lit("")), F.lit("/"))
    paths = F.array_distinct(F.transform(same_origin_links(F.filter(_hrefs(scope), lambda h: ~F.startswith(h, F.lit("javascript:"))), url), lambda u: F.regexp_replace(X.url_path(u), "/+$", "")))

    def is_section(p: Column) -> Column:
        segs = F.transform(X.path_segments(p), F.lower)
        return (F.size(segs) > 0) & (F.size(segs) <= 2) & ~F.exists(segs, lambda s: s.isin(*SKIP_SECTIONS)) & F.exists(segs, lambda s: s.isin(*sections))

    return F.slice(F.filter(paths, lambda p: is_section(p) & (p != here) & ((here == "/") | ~F.startswith(p, F.concat(here, F.lit("/"))))), 1, most)


def header_nav_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose navigation names sections; the tables' sections are words of their prose."""
    found = header_nav_paths(F.col("url"), F.col("html"), ("the", "and", "to", "for", "de", "la", "der", "in"))
    return table(spark, d, "pages").select("page_id", F.array_join(found, ",").alias("paths")).filter(F.col("paths") != "")


def icon_score(rel: Column, width: Column, href: Column) -> Column:
    bonus = lambda cond, n: F.when(cond, n).otherwise(0)
    return F.coalesce(width, F.lit(0)) + bonus(F.contains(F.lower(rel), F.lit("apple-touch-icon")), 256) + bonus(href.endswith(".svg"), 48) + bonus(href.endswith(".png"), 24)


def best_icons(spark: SparkSession, d: str) -> DataFrame:
    """The best icon of every host, of icons made of its pages."""
    rel = F.when(F.col("page_id") % 9 == 0, "apple-touch-icon").otherwise("icon")
    href = F.concat(F.lit("/i"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".svg"), F.lit(".png"), F.lit(".ico")), (F.col("page_id") % 3 + 1).cast("int")))
    icons = pages(spark, d).select("page_id", X.url_host(F.col("url")).alias("host"), rel.alias("rel"), href.alias("href"), (F.col("page_id") % 5 * 16).alias("width"))
    score = icon_score(F.col("rel"), F.col("width"), F.col("href"))
    return icons.groupBy("host").agg(F.max_by("href", F.struct(score.alias("s"), (-F.col("page_id")).alias("n"))).alias("icon"), F.max(score).cast("long").alias("score"))


# --- names ---------------------------------------------------------------------------------------------------------


def normalize_language(c: Column) -> Column:
    """The language that a name or file ending stands for; null if it is none."""
    name = F.lower(F.trim(c))
    return F.get(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in LANGUAGE_ALIASES.items()]), lambda x: x["k"] == name), lambda x: x["v"]), F.lit(0))


def language_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made of the documents' numbers."""
    names = F.array(*[F.lit(x) for x in ("JS", " py ", "c++", "Golang", "klingon", "", "tsx", "Dockerfile", "C#", "yml", "md")])
    name = F.element_at(names, (F.col("doc_id") % 11 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(normalize_language(name).alias("language"), "lang").agg(F.count("*").alias("documents"))


def url_words(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    label = X.version_label(F.col("page_id") % 9, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2."), (F.col("page_id") % 10).cast("string"))), F.when(F.col("page_id") % 4 == 0, F.lit(" stable ")))
    slug = X.category_slug(F.concat(X.url_segment(u, 0, "root"), F.lit(" / "), X.url_segment(u, 1, "x")))
    return pages(spark, d).select("page_id", X.path_keywords(u).alias("keywords"), X.normalize_domain(u).alias("domain"), slug.alias("category"), X.category_label(slug).alias("label"), label.alias("version"), X.url_key(u).alias("url_key"))


def unique_slugs(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds slug: the slugs of names, with -2, -3 and so on for later rows of the same one.

    Rows of one slug are numbered in one task, as each needs the number of those before it.
    """
    slug = df.withColumn("_base", X.slugify(F.col(name)))
    n = F.row_number().over(W.partitionBy("_base").orderBy(order))
    return slug.withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string")))).drop("_base")


def unique_page_slugs(spark: SparkSession, d: str) -> DataFrame:
    return unique_slugs(pages(spark, d).withColumn("name", X.url_host(F.col("url"))), "name", "page_id").select("page_id", "slug")


def docs_candidate_score(u: Column, brand: Column) -> Column:
    """How much a url looks like a package's documentation; -1 for a repository. The points are fixed values."""
    host, path = F.regexp_replace(X.url_host(u), "^www[.]", ""), F.lower(X.url_path(u))
    has = lambda *names: F.greatest(*[F.contains(path, F.lit(n)) for n in names], F.lit(False))
    bare = F.regexp_replace(F.lower(brand), "[^a-z0-9]", "")
    rules = [
        (F.startswith(host, F.lit("docs.")), 80), (host.endswith(".github.io"), 50), (has("/docs", "/documentation"), 40), (has("/overview") | F.regexp_like(path, F.lit("/docs/?$")), 35),
        (has("/learn", "/guide", "/guides"), 15), (F.regexp_like(path, F.lit("/(api|reference|tutorial)")), 20), (has("/javascript", "/typescript", "/js/"), 30), (has("/python", "/py/"), -25),
        ((bare != "") & F.contains(host, bare), 25), (F.contains(host, F.lit("langchain")), 15), (path == "/", 5),
    ]
    total = sum((F.when(cond, n).otherwise(0) for cond, n in rules), F.lit(0))
    return F.when((host == "github.com") | host.endswith(".githubusercontent.com") | (host == ""), -1).otherwise(total)


def docs_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every domain."""
    u = F.concat("url", F.when(F.col("page_id") % 4 == 0, F.lit("/docs")).when(F.col("page_id") % 4 == 1, F.lit("/api/python")).otherwise(F.lit("")))
    p = pages(spark, d).select("page_id", u.alias("url")).withColumn("domain", X.registrable_domain(X.url_host(F.col("url"))))
    score = docs_candidate_score(F.col("url"), F.substring_index("domain", ".", 1))
    return p.groupBy("domain").agg(F.max(score).cast("long").alias("score"), F.max_by("page_id", F.struct(score.alias("s"), (-F.col("page_id")).alias("n"))).alias("page_id"))


# --- exclude patterns and scope ------------------------------------------------------------------------------------


def scope_reason(u: Column, exclude: list[str], include: list[str], regex: bool = False) -> Column:
    """The first reason to leave a url out: excluded, a download, out of scope. Patterns are literal parts or regexes."""
    fits = lambda p: F.regexp_like(u, F.lit(p)) if regex else F.contains(u, F.lit(p))
    some = lambda ps: F.array_max(F.array(F.lit(False), *[fits(p) for p in ps]))
    out = F.when(some(exclude), "excluded").when(F.regexp_like(X.url_path(u), F.lit(r"(?i)([.]pdf$|[.]pdf/)")), "download")
    return out.when(~some(include), "out_of_scope") if include else out


def crawl_scope_regex(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", scope_reason(F.col("url"), ["/(de|es)/[0-9]+$", "[?&]utm_"], ["^https?://[^/]+/(en|fr|es)/"], regex=True).alias("reason"))


def start_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of origin and first path segment that a crawl starts from."""
    u = F.col("url")
    return pages(spark, d).select(F.concat(X.url_scheme(u), F.lit("://"), X.url_host(u)).alias("origin"), F.concat(F.lit("/"), X.url_segment(u, 0, "")).alias("prefix")).dropDuplicates(["origin", "prefix"])


def exclude_patterns(urls: DataFrame, start_urls: list[str], existing: list[str] = (), most: int = 12, max_ratio: float = 0.35, min_hits: int = 2, noise=NOISE_SEGMENTS) -> DataFrame:
    """url rows -> the patterns worth excluding, with their votes and hits: noise and version segments, not those of the start urls.

    A pattern is one segment between slashes, so that none contains another, and its hits are counted by an equi-join on
    segments. The best twelve (a report, so limited).
    """
    u = urls.select("url", X.url_path(F.col("url")).alias("path"))
    seg = u.select(F.posexplode(X.path_segments(F.col("path"))).alias("i", "segment"), X.path_segments(F.lower("path")).alias("lower"))
    locale = F.regexp_like("segment", F.lit("(?i)^[a-z]{2}(-[a-z]{2})?$")) & (F.col("i") > 0) & F.get("lower", F.col("i") - 1).isin("docs", "documentation", "guide")
    weight = F.when(F.lower("segment").isin(*noise), 2).otherwise(0) + F.when(F.regexp_like("segment", F.lit(VERSIONISH)), 1).otherwise(0) + F.when(locale, 1).otherwise(0)
    votes = seg.select(F.concat(F.lit("/"), "segment", F.lit("/")).alias("pattern"), weight.alias("w")).filter("w > 0").groupBy("pattern").agg(F.sum("w").alias("votes"))
    inner = F.array_distinct(F.slice(F.split("url", "/"), F.lit(2), F.greatest(F.size(F.split("url", "/")) - 2, F.lit(0))))
    hits = u.select(F.explode(inner).alias("s")).groupBy(F.concat(F.lit("/"), "s", F.lit("/")).alias("pattern")).agg(F.count("*").alias("hits"))
    every = votes.join(hits, "pattern")
    whole = u.filter(F.lower("path").endswith("all.html")).agg((F.count("*") * 3).alias("votes"))
    spread = u.filter(F.contains("url", F.lit("all.html"))).agg(F.count("*").alias("hits"))
    page = whole.crossJoin(spread).filter("votes > 0").select(F.lit("all.html").alias("pattern"), "votes", "hits")  # one row each
    total = urls.agg(F.count("*").alias("n"))
    shown = [F.lit(s) for s in start_urls]
    hidden = F.array_max(F.array(F.lit(False), *[F.contains(s, F.col("pattern")) for s in shown]))
    protected = {f"/{s.lower()}/" for x in start_urls for s in x.split("://")[-1].split("/")[1:] if s}
    kept = every.unionByName(page).crossJoin(F.broadcast(total)).filter(~hidden & ~F.lower("pattern").isin(*protected, "") & ~F.col("pattern").isin(*existing, ""))
    kept = kept.filter(((F.col("hits") >= min_hits) | (F.col("pattern") == "all.html")) & (F.col("hits") / F.col("n") <= max_ratio))
    return kept.orderBy(F.desc("votes"), "pattern").limit(most).select("pattern", "votes", "hits")


def exclude_pattern_report(spark: SparkSession, d: str) -> DataFrame:
    """The tables' urls have locales and numbers: some get a version or a noise segment here."""
    part = F.when(F.col("page_id") % 6 == 0, "/docs/v2.1/").when(F.col("page_id") % 10 == 1, "/Blog/").when(F.col("page_id") % 15 == 2, "/guide/pt-br/").otherwise("/")
    u = F.concat(F.substring_index("url", "/", 3), part, F.coalesce(F.regexp_extract("url", "^[^/]*//[^/]*/(.*)$", 1), F.lit("")))
    return exclude_patterns(pages(spark, d).select(u.alias("url")), ["https://a.example.org/start/v2.1x/"])


def merged_patterns(existing: Column, suggested: Column) -> Column:
    """Both lists, trimmed, each pattern once, in order."""
    return F.array_distinct(F.filter(F.transform(F.concat(existing, suggested), lambda p: F.trim(p)), lambda p: p != ""))


def pattern_merge(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    first, second = F.concat(F.lit("/"), X.url_segment(u, 0, "root"), F.lit("/")), F.concat(F.lit(" /"), X.url_segment(u, 1, "root"), F.lit("/ "))
    return pages(spark, d).select("page_id", F.array_join(merged_patterns(F.array(first, F.lit("")), F.array(second, first, F.lit(" /x/"))), " ").alias("patterns"))


def segment_urls(spark: SparkSession, d: str) -> DataFrame:
    """The distinct urls under any of the chosen first segments."""
    return pages(spark, d).filter(X.url_segment(F.col("url"), 0, "root").isin("de", "fr")).select("url").distinct()


# --- examples in pages ---------------------------------------------------------------------------------------------


def example_signals(markdown: Column) -> tuple[Column, Column, Column]:
    """Whether a page has fenced code, indented code, or a heading of examples or set-up."""
    words = r"example|examples|usage|quick\s*start|quickstart|getting\s+started|setup|install(?:ation)?|configuration|config|how\s+to|tutorial|walkthrough"
    return F.contains(markdown, F.lit("```")), F.regexp_like(markdown, F.lit(r"(?:^|\n)(?: {4}|\t).+\n(?:(?: {4}|\t).+\n)+")), F.regexp_like(markdown, F.lit(rf"(?im)^#{{1,6}}\s+.*\b({words})\b"))


def enrich_skip(markdown: Column) -> Column:
    """Null for a page with possible examples, else why it is not enriched."""
    fenced, indented, heading = example_signals(markdown)
    return F.when(F.coalesce(F.regexp_like(markdown, F.lit(r"^\s*$")), F.lit(True)), "empty_page").when(~(fenced | indented | heading), "info_only")


def enrich_gate(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("```js\nx\n```\n"), F.lit("\n    a b\n    c d\n"), F.lit("## Quick  start\n"), F.lit("# About\n"), F.lit("\tone line\n")), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 9 == 0, F.lit(" \n")).otherwise(F.concat(head, F.translate(F.coalesce("text", F.lit("")), "`#\t\n", "....")))
    return table(spark, d, "documents").groupBy("lang", enrich_skip(text).alias("skip")).agg(F.count("*").alias("documents"))


def response_status(title: Column) -> tuple[Column, Column]:
    """Status and its text from a title like ``404 Not Found``; nulls where it is none."""
    code, said = F.regexp_extract(F.trim(title), r"^([0-9]{3})\s+(.+)$", 1), F.trim(F.regexp_extract(F.trim(title), r"^([0-9]{3})\s+(.+)$", 2))
    ok = (code != "") & code.between("100", "599") & (said != "")
    return F.when(ok, F.try_to_number(code, F.lit("999")).cast("int")), F.when(ok, said)


def response_error(body: Column) -> Column:
    """error.code, else code, of a JSON body, where it is a string."""
    at = lambda path: F.nullif(F.trim(F.get_json_object(body, path)), F.lit(""))
    return F.when(F.regexp_like(body, F.lit(r"^\s*[\[{]")), F.coalesce(at("$.error.code"), at("$.code")))


def response_type(body: Column) -> Column:
    return F.when(F.regexp_like(body, F.lit(r"^\s*[\[{]")), "json").when(F.regexp_like(body, F.lit(r"^\s*<")), "xml").otherwise("text")


def api_response_meta(spark: SparkSession, d: str) -> DataFrame:
    """Status, error code and type of answers made of the events."""
    k = F.get_json_object("props", "$.k")
    title = F.concat((F.col("event_id") % 7 * 100).cast("string"), F.lit(" "), "event_type")
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"error":{"code":"E'), k, F.lit('"}}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(' {"code":" C'), k, F.lit('"}'))).when(F.col("event_id") % 4 == 2, "<x/>").otherwise(F.col("event_type"))
    status, said = response_status(title)
    return table(spark, d, "events").groupBy(status.cast("long").alias("status"), said.alias("said"), response_error(body).alias("code"), response_type(body).alias("type")).agg(F.count("*").alias("answers"))


QUERIES = {
    "sitemap_expansion": sitemap_expansion, "link_crawl": link_crawl, "robots_files": robots_files, "status_probe": status_probe, "markdown_alternates": markdown_alternate_pages, "repo_walk": repo_walk, "llms_files": llms_files,
    "repo_page_load": repo_page_load, "page_title_resolution": page_title_resolution, "page_site_links": page_site_links, "header_nav_paths": header_nav_pages, "best_icons": best_icons,
    "language_names": language_names, "url_words": url_words, "unique_page_slugs": unique_page_slugs, "docs_candidates": docs_candidates, "crawl_scope_regex": crawl_scope_regex,
    "start_scopes": start_scopes, "exclude_patterns": exclude_pattern_report, "pattern_merge": pattern_merge, "segment_urls": segment_urls, "enrich_gate": enrich_gate,
    "api_response_meta": api_response_meta,
}

_S = "[A-Za-z][A-Za-z0-9+.-]*"


def path_sql(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^{_S}://[^/?#]*([^?#]*)', 1), ''), '/')"


def host_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^{_S}://([^/?#]*)', 1))"


def scheme_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^({_S})://', 1))"


def segs_sql(u: str) -> str:
    return f"list_filter(string_split({path_sql(u)}, '/'), lambda s: s <> '')"


def domain_sql(u: str) -> str:
    labels = f"string_split(regexp_replace({host_sql(u)}, '^www[.]', ''), '.')"
    return f"array_to_string({labels}[-2:], '.')"


_FILES = f"""files AS (SELECT page_id, html, strlen(html) AS bytes, ['src', 'node_modules', 'lib', 'docs'][page_id % 4 + 1] || '/' || coalesce({segs_sql('url')}[1], 'root') || '/' || page_id || ['.ts', '.md', '.test.ts', '.png', '.tsx'][page_id % 5 + 1] AS path FROM pages),
roles AS (SELECT *, CASE WHEN regexp_matches(path, '[.]test[.]ts$') THEN 'test' WHEN regexp_matches(path, '[.]md$') OR starts_with(path, 'docs/') THEN 'docs' ELSE 'source' END AS role FROM files)"""
_alias = "CASE lower(trim(n)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_ALIASES.items()) + " END"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_ORIGIN = f"{scheme_sql('url')} || '://' || {host_sql('url')}"
ORACLE_SQL = {
    "link_crawl": "SELECT 'https://e.org/' || lpad(page_id::VARCHAR, 9, '0') AS url, floor(log2(page_id + 1))::BIGINT AS depth FROM pages ORDER BY 2, 1 LIMIT 150",
    "sitemap_expansion": f"SELECT DISTINCT {domain_sql('url')} AS root, url FROM pages",
    "robots_files": f"SELECT {host_sql('url')} AS host, 'https://' || {host_sql('url')} || '/sitemap.xml' AS sitemaps, count(DISTINCT coalesce({segs_sql('url')}[1], 'root')) AS disallowed FROM pages GROUP BY 1, 2",
    "status_probe": "SELECT CASE WHEN page_id % 7 = 1 THEN 'no_response' WHEN page_id % 7 = 0 THEN 'gone' WHEN page_id % 7 = 2 THEN 'status_503' END AS reason, count(*) AS pages FROM pages GROUP BY 1",
    "markdown_alternates": r"""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS b, ['text/html; charset=utf-8', 'text/markdown', ''][page_id % 3 + 1] AS k, CASE WHEN page_id % 2 = 0 THEN chr(10) || '# ' ELSE '' END || html AS body FROM pages)
SELECT page_id, CASE WHEN b LIKE '%.md' THEN '' WHEN b LIKE '%/' THEN b || '.md ' || regexp_replace(b, '/$', '') || '.md' ELSE b || '.md' END AS alternates, contains(k, 'text/markdown') OR (NOT contains(k, 'text/html') AND regexp_matches(body, '^\s*[#>]')) AS markdown FROM p""",
    "llms_files": "SELECT source, count(*) FILTER (doc_id % 3 <> 0 AND (doc_id % 5 <> 0)) AS files, sum(CASE WHEN doc_id % 7 = 0 THEN 512000 ELSE 4 + strlen(coalesce(text, '')) END) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0)::BIGINT AS bytes FROM documents GROUP BY 1",
    "repo_walk": f"""WITH {_FILES} SELECT CASE WHEN starts_with(path, 'node_modules/') THEN 'skipped_folder' WHEN path LIKE '%.png' THEN 'extension' WHEN role = 'test' THEN 'test' WHEN path LIKE '%.md' THEN 'readme' END AS reason, count(*) AS files FROM roles GROUP BY 1""",
    "repo_page_load": f"WITH {_FILES} SELECT page_id, path, role, CASE WHEN path LIKE '%.md' THEN 'markdown' ELSE 'ts' END AS language FROM roles WHERE NOT starts_with(path, 'node_modules/') AND path NOT LIKE '%.png' AND bytes <= 200000 AND trim(html) <> ''",
    "page_title_resolution": rf"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Docs' ELSE trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) END AS t,
  CASE WHEN page_id % 5 = 0 THEN 'Home' ELSE trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '\s+', ' ', 'g')) END AS h, CASE WHEN page_id % 2 = 0 THEN 'Guide to ' || page_id ELSE '' END AS m, coalesce({segs_sql('url')}[-1], '') AS last FROM pages),
s AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(last, '[.][A-Za-z0-9]+$', ''), '[-_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS slug FROM p),
c AS (SELECT page_id, url, list_filter([t, h, m, slug], lambda x: x <> '') AS l FROM s)
SELECT page_id, coalesce(list_filter(l, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '(?i)^(docs?|documentation|home|overview|untitled|page)$') AND NOT regexp_matches(x, '(?i)^https?://'))[1], l[1], url) AS title FROM c""",
    "page_site_links": rf"""WITH h AS (SELECT page_id, url, {_ORIGIN} AS o, regexp_replace({path_sql('url')}, '[^/]*$', '') AS f, list_concat(regexp_extract_all(html, 'href="([^"]+)"', 1), ['sub/page#x', 'https://elsewhere.example.org/', url]) AS l FROM pages),
u AS (SELECT page_id, o, i, regexp_replace(CASE WHEN regexp_matches(x, '^{_S}:') THEN x WHEN starts_with(x, '//') THEN split_part(url, ':', 1) || ':' || x WHEN starts_with(x, '/') THEN o || x ELSE o || f || x END, '#.*$', '') AS u FROM h, unnest(l) WITH ORDINALITY AS t(x, i) WHERE NOT starts_with(x, '#')),
k AS (SELECT page_id, u, min(i) AS i FROM u WHERE {scheme_sql('u')} || '://' || {host_sql('u')} = o GROUP BY 1, 2)
SELECT page_id, count(*) AS links, sha256(string_agg(u, chr(10) ORDER BY i)) AS links_hash FROM k GROUP BY 1""",
    "header_nav_paths": rf"""WITH h AS (SELECT page_id, {_ORIGIN} AS o, coalesce(nullif(regexp_replace({path_sql('url')}, '/+$', ''), ''), '/') AS here, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), 'href="([^"]+)"', 1) AS l FROM pages),
p AS (SELECT page_id, here, min(i) AS i, regexp_replace(regexp_replace(x, '[?#].*$', ''), '/+$', '') AS p FROM h, unnest(l) WITH ORDINALITY AS t(x, i) WHERE starts_with(x, '/') AND NOT starts_with(x, '//') GROUP BY page_id, here, p),
s AS (SELECT *, list_transform(list_filter(string_split(p, '/'), lambda w: w <> ''), lambda w: lower(w)) AS segs FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM s WHERE len(segs) BETWEEN 1 AND 2 AND NOT list_has_any(segs, [{_quoted(SKIP_SECTIONS)}]) AND list_has_any(segs, ['the', 'and', 'to', 'for', 'de', 'la', 'der', 'in']) AND p <> here AND (here = '/' OR NOT starts_with(p, here || '/')))
SELECT page_id, string_agg(p, ',' ORDER BY i) AS paths FROM k WHERE n <= 8 GROUP BY 1""",
    "best_icons": f"""WITH i AS (SELECT page_id, {host_sql('url')} AS host, '/i' || page_id || ['.svg', '.png', '.ico'][page_id % 3 + 1] AS href, page_id % 5 * 16 + CASE WHEN page_id % 9 = 0 THEN 256 ELSE 0 END + [48, 24, 0][page_id % 3 + 1] AS s FROM pages)
SELECT host, first(href ORDER BY s DESC, page_id) AS icon, max(s)::BIGINT AS score FROM i GROUP BY 1""",
    "language_names": f"WITH n AS (SELECT lang, ['JS', ' py ', 'c++', 'Golang', 'klingon', '', 'tsx', 'Dockerfile', 'C#', 'yml', 'md'][doc_id % 11 + 1] AS n FROM documents) SELECT {_alias} AS language, lang, count(*) AS documents FROM n GROUP BY 1, 2",
    "url_words": rf"""WITH p AS (SELECT page_id, url, {segs_sql('url')} AS segs, {host_sql('url')} AS host, {scheme_sql('url')} AS scheme FROM pages),
w AS (SELECT page_id, w, min(i) AS i FROM (SELECT page_id, i, lower(trim(regexp_replace(regexp_replace(s, '(?i)[.][a-z0-9]+$', ''), '[-_]+', ' ', 'g'))) AS w FROM p, unnest(segs) WITH ORDINALITY AS t(s, i)) WHERE length(w) >= 2 AND w NOT IN ('docs', 'doc', 'documentation', 'en', 'api', 'www', 'v1', 'v2', 'blob', 'tree', 'raw', 'refs', 'heads', 'main', 'master') GROUP BY 1, 2),
k AS (SELECT page_id, string_agg(w, ' ' ORDER BY i) AS k FROM w GROUP BY 1),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(coalesce(segs[1], 'root') || ' / ' || coalesce(segs[2], 'x'))), '/', '-'), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS c,
  list_filter(segs, lambda s: NOT regexp_matches(lower(s), '^v?[0-9]+([.][0-9]+)*$|^(nextjs|react|vue|angular)-[0-9]+')) AS kept FROM p)
SELECT c.page_id, coalesce(k, '') AS keywords, regexp_replace(regexp_replace(host, ':[0-9]+$', ''), '^www[.]', '') AS domain, CASE WHEN c <> '' AND length(c) <= 48 THEN c END AS category, replace(CASE WHEN c <> '' AND length(c) <= 48 THEN c END, '-', '/') AS label,
  CASE WHEN c.page_id % 4 = 0 THEN 'stable' WHEN c.page_id % 3 = 0 THEN 'v2.' || (c.page_id % 10) ELSE 'v' || (c.page_id % 9) END AS version, scheme || '://' || regexp_replace(host, '^www[.]', '') || CASE WHEN len(kept) > 0 THEN '/' || array_to_string(kept, '/') ELSE '' END AS url_key
FROM c LEFT JOIN k ON k.page_id = c.page_id""",
    "unique_page_slugs": f"""WITH s AS (SELECT page_id, left(regexp_replace(regexp_replace({host_sql('url')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS b FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id) AS n FROM s)
SELECT page_id, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM n""",
    "docs_candidates": f"""WITH p AS (SELECT page_id, {domain_sql('url')} AS domain, url || CASE WHEN page_id % 4 = 0 THEN '/docs' WHEN page_id % 4 = 1 THEN '/api/python' ELSE '' END AS url FROM pages),
h AS (SELECT *, regexp_replace({host_sql('url')}, '^www[.]', '') AS host, lower({path_sql('url')}) AS path FROM p),
s AS (SELECT *, 80 * starts_with(host, 'docs.')::INT + 40 * (contains(path, '/docs') OR contains(path, '/documentation'))::INT + 35 * (contains(path, '/overview') OR regexp_matches(path, '/docs/?$'))::INT + 15 * (contains(path, '/learn') OR contains(path, '/guide'))::INT
  + 20 * regexp_matches(path, '/(api|reference|tutorial)')::INT + 30 * (contains(path, '/javascript') OR contains(path, '/typescript') OR contains(path, '/js/'))::INT - 25 * (contains(path, '/python') OR contains(path, '/py/'))::INT
  + 25 * contains(host, regexp_replace(lower(split_part(domain, '.', 1)), '[^a-z0-9]', '', 'g'))::INT + 5 * (path = '/')::INT AS s FROM h)
SELECT domain, max(s)::BIGINT AS score, first(page_id ORDER BY s DESC, page_id) AS page_id FROM s GROUP BY 1""",
    "crawl_scope_regex": f"""SELECT page_id, CASE WHEN regexp_matches(url, '/(de|es)/[0-9]+$') OR regexp_matches(url, '[?&]utm_') THEN 'excluded' WHEN regexp_matches({path_sql('url')}, '(?i)([.]pdf$|[.]pdf/)') THEN 'download' WHEN NOT regexp_matches(url, '^https?://[^/]+/(en|fr|es)/') THEN 'out_of_scope' END AS reason FROM pages""",
    "start_scopes": f"SELECT DISTINCT {_ORIGIN} AS origin, '/' || coalesce({segs_sql('url')}[1], '') AS prefix FROM pages",
    "exclude_patterns": rf"""WITH u AS (SELECT regexp_extract(url, '^([^/]*//[^/]*)', 1) || CASE WHEN page_id % 6 = 0 THEN '/docs/v2.1/' WHEN page_id % 10 = 1 THEN '/Blog/' WHEN page_id % 15 = 2 THEN '/guide/pt-br/' ELSE '/' END || regexp_extract(url, '^[^/]*//[^/]*/(.*)$', 1) AS url FROM pages),
g AS (SELECT list_transform({segs_sql('url')}, lambda s: s) AS segs FROM u),
v AS (SELECT '/' || segs[i] || '/' AS pattern, 2 * (lower(segs[i]) IN ({_quoted(NOISE_SEGMENTS)}))::INT + regexp_matches(segs[i], '{VERSIONISH}')::INT + coalesce(i > 1 AND regexp_matches(segs[i], '(?i)^[a-z]{{2}}(-[a-z]{{2}})?$') AND lower(segs[i - 1]) IN ('docs', 'documentation', 'guide'), false)::INT AS w FROM g, unnest(range(1, len(segs) + 1)) AS t(i)),
k AS (SELECT pattern, sum(w)::BIGINT AS votes FROM v WHERE w > 0 GROUP BY 1 UNION ALL SELECT 'all.html', 3 * count(*) FROM u WHERE lower({path_sql('url')}) LIKE '%all.html' HAVING count(*) > 0),
c AS (SELECT pattern, votes, (SELECT count(*) FROM u WHERE contains(url, pattern)) AS hits, (SELECT count(*) FROM u) AS n FROM k)
SELECT pattern, votes, hits FROM c WHERE NOT contains('https://a.example.org/start/v2.1x/', pattern) AND lower(pattern) NOT IN ('/start/', '/v2.1x/') AND (hits >= 2 OR pattern = 'all.html') AND hits / n::DOUBLE <= 0.35 ORDER BY votes DESC, pattern LIMIT 12""",
    "pattern_merge": f"""WITH p AS (SELECT page_id, '/' || coalesce({segs_sql('url')}[1], 'root') || '/' AS a, '/' || coalesce({segs_sql('url')}[2], 'root') || '/' AS b FROM pages)
SELECT page_id, a || CASE WHEN b <> a THEN ' ' || b ELSE '' END || CASE WHEN '/x/' NOT IN (a, b) THEN ' /x/' ELSE '' END AS patterns FROM p""",
    "segment_urls": f"SELECT DISTINCT url FROM pages WHERE coalesce({segs_sql('url')}[1], 'root') IN ('de', 'fr')",
    "enrich_gate": "SELECT lang, CASE WHEN doc_id % 9 = 0 THEN 'empty_page' WHEN doc_id % 5 >= 3 THEN 'info_only' END AS skip, count(*) AS documents FROM documents GROUP BY 1, 2",
    "api_response_meta": """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, event_id % 7 AS c FROM events)
SELECT CASE WHEN c BETWEEN 1 AND 5 THEN c * 100 END AS status, CASE WHEN c BETWEEN 1 AND 5 THEN event_type END AS said, CASE event_id % 4 WHEN 0 THEN 'E' || k WHEN 1 THEN 'C' || k END AS code, ['json', 'json', 'xml', 'text'][event_id % 4 + 1] AS type, count(*) AS answers FROM e GROUP BY 1, 2, 3, 4""",
}
