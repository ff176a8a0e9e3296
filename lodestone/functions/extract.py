"""Column functions for crawl files, routes, scores and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def sitemap_locations(xml: Column) -> Column:
    """The distinct addresses of a sitemap or a sitemap index, in order."""
    raw = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return F.array_distinct(F.transform(raw, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def robots_sitemaps(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), 1))


def robots_disallows(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?im)^[ \t]*disallow:[ \t]*\S"))


def status_reason(status: Column) -> Column:
    """Null for a status that is kept, else why the page is skipped."""
    return F.when(status.isNull(), "no_response").when(status.between(200, 299), None).when(status.isin(404, 410), "gone").otherwise(F.concat(F.lit("status_"), status.cast("string")))


def markdown_links(text: Column) -> Column:
    """Absolute link targets without fragments, distinct, in order."""
    raw = F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)\s]+)\)"), 1)
    return F.array_distinct(F.transform(raw, lambda u: F.regexp_replace(u, "#.*$", "")))


def clean_query(text: Column) -> Column:
    """Code and punctuation gone, white space collapsed, at most 400 characters; the text as it is where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), "`[^`]+`", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, "[?!.,;:]+", " "), r"\s+", " "))
    return F.substring(F.when(plain == "", F.trim(text)).otherwise(plain), 1, 400)


def keyword_terms(text: Column, most: int = 10) -> Column:
    """Distinct words of a cleaned question with three letters, digits, dots, dashes or lines or more, first seen first."""
    words = F.transform(F.split(F.lower(clean_query(text)), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9_.-]", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), 1, most)


def error_snippet(text: Column) -> Column:
    """The first line that names an error, else the first name that ends in Error; null if there is none."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    said = F.get(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"\b(Error|Exception|Traceback|SyntaxError|KeyError|TypeError|ValueError|AttributeError)\b"))), F.lit(0))
    named = F.nullif(F.regexp_extract(text, r"\b[A-Z][a-zA-Z]*Error(?::\s*[^\n]{0,80})?", 0), F.lit(""))
    return F.substring(F.coalesce(said, named), 1, 120)


def code_snippet(text: Column) -> Column:
    """Three lines of the first code block that say something, else the first code in a line; null if there is none."""
    block = F.regexp_extract(text, r"```[A-Za-z0-9_-]*\n([\s\S]{8,500}?)\n```", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"(?i)^\s*(import\s+|from\s+.+\s+import|#|//|/\*|\*\s|const\s+[A-Za-z0-9_]+\s*=\s*require\()")))
    condensed = F.trim(F.regexp_replace(F.array_join(F.slice(lines, 1, 3), " "), r"\s+", " "))
    inline = F.nullif(F.trim(F.regexp_extract(text, "`([^`\n]{8,80})`", 1)), F.lit(""))
    return F.when(F.length(condensed) >= 8, F.substring(condensed, 1, 100)).otherwise(inline)


def rerank_query(text: Column) -> Column:
    """What candidates are reranked by: the cleaned question, and an error and code that it does not hold already."""
    base = F.substring(clean_query(text), 1, 200)
    new = lambda c, n: c.isNotNull() & ~F.contains(base, F.substring(c, 1, n))
    error, code = error_snippet(text), code_snippet(text)
    parts = F.array_compact(F.array(base, F.when(new(error, 24), F.concat(F.lit("Error: "), error)), F.when(new(code, 20), F.concat(F.lit("Snippet: "), code))))
    return F.substring(F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")), 1, 220)


def route_matches(template: Column, path: Column) -> Column:
    """Segments that start with a colon stand for anything."""
    a, b = F.filter(F.split(template, "/"), lambda s: s != ""), F.filter(F.split(path, "/"), lambda s: s != "")
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.startswith(x, F.lit(":")) | F.coalesce(x == y, F.lit(False))), lambda ok: ok)


def route_specificity(template: Column) -> Column:
    """Ten for each segment, one more for each that is literal."""
    segs = F.filter(F.split(template, "/"), lambda s: s != "")
    return F.size(segs) * 10 + F.size(F.filter(segs, lambda s: ~F.startswith(s, F.lit(":"))))


def clamp_score(score: Column) -> Column:
    """Finite scores within 0 and 1, others 0."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def logistic(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def json_at(json: Column, path: str) -> Column:
    """The value at a dotted path as a string."""
    return F.get_json_object(json, "$." + path)


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(1e-6))


def strictness(name: str, threshold: float | None = -1.0) -> tuple[float, float, bool]:
    """(threshold, relaxed threshold, weak evidence allowed). -1: the default of that name; None: no threshold."""
    if threshold is None:
        return 0.0, 0.0, name == "permissive"
    if name == "permissive":
        base = C.RELAXED_THRESHOLD if threshold == -1.0 else min(max(threshold, 0.0), 1.0)
        return base, min(C.RELAXED_THRESHOLD, base), True
    base = C.STRICT_THRESHOLD if threshold == -1.0 else min(max(threshold, 0.0), 1.0)
    return base, min(C.RELAXED_THRESHOLD, base), False
