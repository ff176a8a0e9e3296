"""Html to markdown by the structure of elements, with Spark functions only.

A page is cut into tags, texts and raw elements (scripts, styles, comments). One fold over them carries what is open: how deep in an
excluded element, in the content, in ``pre``, in lists, a link, a heading, a table. Each token is then written for the state before
it. Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import states_before
from ..sources.tables import table

#: Elements without content, whose end is never awaited; elements that are lines of their own; headings.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "body", "dd", "details", "dl", "dt", "div", "fieldset", "figure", "figcaption", "form", "header", "html", "main", "p", "section", "summary", "tbody", "tfoot", "thead")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
EXCLUDE = ("nav", "footer", "head", "svg", "noscript", "template", "button")
CONTENT = ("main", "article")
#: Words on links and buttons that copy something.
COPY = r"(?i)copy (?:page|link)"
TOKEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|</?[a-z][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>|<[!?][^>]*>|[^<]+|<"
#: Stand for spaces and newlines that stay while white space is cleaned.
KEPT_SPACE, KEPT_LINE = "\x01", "\x02"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an open tag, empty where there is none."""
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def decode(c: Column) -> Column:
    """The entities that texts have most; others stay as they are."""
    for e, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(e), F.lit(plain))
    return c


def tokens(html: Column) -> Column:
    """array<struct<name, close, tok, id, href>>: lower-case names, empty for texts and raw elements; id and href of open tags."""
    clean = F.translate(F.coalesce(html, F.lit("")), KEPT_SPACE + KEPT_LINE, "")
    name = lambda t: F.when(F.regexp_like(t, F.lit(r"(?is)^<(?:script|style)\b.*>.*<|^<!")), "").otherwise(F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1)))
    named = F.transform(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(name(t).alias("name"), F.startswith(t, F.lit("</")).alias("close"), t.alias("tok")))
    of = lambda x, a, names: F.when(x["name"].isin(*names) & ~x["close"], attribute(x["tok"], a)).otherwise("")
    return F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["close"].alias("close"), x["tok"].alias("tok"), of(x, "id", HEADINGS).alias("id"), of(x, "href", ("a",)).alias("href")))


def html_markdown(pages: DataFrame, content: tuple[str, ...] = CONTENT, exclude: tuple[str, ...] = EXCLUDE, exclude_tags: str | None = None) -> DataFrame:
    """pages: html, and url if there is one -> pages with markdown.

    Elements named in ``exclude``, or whose open tag matches the regex ``exclude_tags``, go with all that is in them, whatever is nested. Of
    ``content`` the first name that the page has outside of those is the content: all its elements in order; the whole page where it has none.
    Headings with an id are links to it on the page's url; links within a page are dropped from headings, and links that copy something
    everywhere. An excluded or content element that is never closed reaches to the page's end. Null html gives an empty text.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "#.*$", "") if "url" in pages.columns else F.lit("")
    whole = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), tokens(F.col("html")).alias("ts"), url.alias("base"))
    has = lambda n: F.exists("ts", lambda t: (t["name"] == n) & ~t["close"])
    whole = whole.withColumn("main", F.coalesce(*[F.when(has(n), n) for n in content], F.lit("")))
    copies = lambda i: F.regexp_like(F.coalesce(F.get("ts", i + 1)["tok"], F.lit("")), F.lit(COPY))
    whole = whole.withColumn("ts", F.transform("ts", lambda t, i: F.struct(*[t[f].alias(f) for f in ("name", "close", "tok", "id", "href")], ((t["name"] == "a") & ~t["close"] & copies(i)).alias("copies"))))

    def hides(s: Column, t: Column) -> Column:
        """Whether an open tag begins an excluded element."""
        out = t["name"].isin(*exclude) | t["copies"] | ((s["head"] > 0) & (t["name"] == "a") & F.startswith(t["href"], F.lit("#")))
        return (out | F.regexp_like(t["tok"], F.lit(exclude_tags)) if exclude_tags else out) & ~t["close"] & (t["name"] != "") & ~t["name"].isin(*VOID)

    def step(s: Column, t: Column) -> Column:
        n, opens, closes = t["name"], (t["name"] != "") & ~t["close"], t["close"]
        skipping = s["skip"] > 0
        skip = F.when(skipping, s["skip"] + F.when(n != s["skipped"], 0).when(closes, -1).otherwise(1)).when(hides(s, t), 1).otherwise(0)
        live = ~skipping & (skip == 0)
        depth = lambda field, *names: F.when(~live | ~n.isin(*names), s[field]).when(closes, F.greatest(s[field] - 1, F.lit(0))).otherwise(s[field] + 1)
        inside = F.when(~live | (n != F.col("main")) | (F.col("main") == ""), s["main"]).when(closes, F.greatest(s["main"] - 1, F.lit(0))).otherwise(s["main"] + 1)
        lists = F.when(~live | ~n.isin("ul", "ol"), s["lists"]).when(closes, F.left(s["lists"], F.greatest(F.length(s["lists"]) - 1, F.lit(0)))).otherwise(F.concat(s["lists"], F.left(n, F.lit(1))))
        head = F.when(~live | ~n.isin(*HEADINGS), s["head"]).when(closes, 0).otherwise(F.substring(n, 2, 1).cast("int"))
        rows = F.when(~live, s["rows"]).when((n == "table") & opens, 0).when((n == "tr") & closes, s["rows"] + 1).otherwise(s["rows"])
        cells = F.when(~live, s["cells"]).when(n == "tr", 0).when(n.isin("td", "th") & opens, s["cells"] + 1).otherwise(s["cells"])
        return F.struct(
            skip.alias("skip"), F.when(~skipping & (skip > 0), n).otherwise(s["skipped"]).alias("skipped"), inside.alias("main"), depth("pre", "pre").alias("pre"), lists.alias("lists"),
            head.alias("head"), F.when(live & n.isin(*HEADINGS), t["id"]).otherwise(s["id"]).alias("id"), F.when(live & (n == "a"), t["href"]).otherwise(s["href"]).alias("href"),
            rows.alias("rows"), cells.alias("cells"), F.when(live & n.isin("td", "th"), opens).when(live & (n == "table"), F.lit(False)).otherwise(s["cell"]).alias("cell"),
        )

    zero = F.struct(*[F.lit(v).alias(k) for k, v in {"skip": 0, "skipped": "", "main": 0, "pre": 0, "lists": "", "head": 0, "id": "", "href": "", "rows": 0, "cells": 0, "cell": False}.items()])
    folded = whole.withColumn("states", states_before(F.col("ts"), zero, step))

    def write(s: Column, t: Column, after: Column) -> Column:
        n, opens = t["name"], ~t["close"]
        text = decode(t["tok"])
        linked = (s["id"] != "") & (F.col("base") != "")
        reaches = lambda href: (href != "") & ~F.regexp_like(href, F.lit("(?i)^(?:#|javascript:|data:)"))
        language = F.coalesce(F.nullif(F.regexp_extract(t["tok"], r"(?i)\blanguage-([\w+#-]+)", 1), F.lit("")), F.regexp_extract(F.coalesce(after, F.lit("")), r"(?i)^<code[^>]*\blanguage-([\w+#-]+)", 1))
        raw = F.translate(F.regexp_replace(text, "\r\n?", "\n"), " \n", KEPT_SPACE + KEPT_LINE)
        item = F.concat(F.lit("\n"), F.repeat(F.lit(KEPT_SPACE * 2), F.greatest(F.length(s["lists"]) - 1, F.lit(0))), F.when(F.right(s["lists"], F.lit(1)) == "o", "1. ").otherwise("- "))
        rule = F.concat(F.lit(" |"), F.when(s["rows"] == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), s["cells"]))).otherwise(""))
        source, alt = attribute(t["tok"], "src"), attribute(t["tok"], "alt")
        picture = F.when((source != "") & ~F.regexp_like(source, F.lit("(?i)^(?:data|blob):")), F.concat(F.lit("!["), alt, F.lit("]("), source, F.lit(")"))).otherwise("")
        heading = F.when(opens, F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(n, 2, 1).cast("int")), F.lit(" "), F.when((t["id"] != "") & (F.col("base") != ""), "[").otherwise("")))
        heading = heading.otherwise(F.concat(F.when(linked, F.concat(F.lit("]("), F.col("base"), F.lit("#"), s["id"], F.lit(")"))).otherwise(""), F.lit("\n\n")))
        flow = F.when(n == "", F.when(F.startswith(t["tok"], F.lit("<")) & (t["tok"] != "<"), "").otherwise(F.regexp_replace(text, r"\s+", " "))).when(n == "br", "\n").when(n == "hr", "\n\n---\n\n").when(n == "img", picture)
        flow = flow.when(n.isin(*HEADINGS), heading).when(n == "pre", F.concat(F.lit("\n\n```"), language, F.lit("\n"))).when(n == "code", "`")
        flow = flow.when((n == "a") & linked & (s["head"] > 0), "").when((n == "a") & opens, F.when(reaches(t["href"]), "[").otherwise("")).when(n == "a", F.when(reaches(s["href"]), F.concat(F.lit("]("), decode(s["href"]), F.lit(")"))).otherwise(""))
        flow = flow.when(n == "li", F.when(opens, item).otherwise("")).when(n.isin("ul", "ol"), F.when(F.length(s["lists"]) > F.when(opens, 0).otherwise(1), "").otherwise("\n\n"))
        flow = flow.when(n == "table", "\n\n").when(n == "tr", F.when(opens, "\n| ").when(s["cells"] > 0, rule).otherwise("")).when(n.isin("td", "th"), F.when(opens & (s["cells"] > 0), " | ").otherwise(""))
        flow = flow.when(n == "blockquote", "\n\n").when(n == "p", "\n\n").when(n.isin(*BLOCKS), "\n").otherwise("")
        flow = F.when(s["cell"] & ~n.isin("td", "th", "tr", "table"), F.regexp_replace(F.regexp_replace(flow, r"\s+", " "), r"\|", r"\\|")).otherwise(flow)
        closed = F.when((n == "pre") & t["close"], "\n```\n\n").when(n == "", raw).when(n == "br", KEPT_LINE).otherwise("")
        seen = (s["skip"] == 0) & ((F.col("main") == "") | (s["main"] > 0) | ((n == F.col("main")) & opens)) & ~hides(s, t)
        return F.when(~seen, "").when(s["pre"] > 0, closed).otherwise(flow)

    written = F.transform("ts", lambda t, i: write(F.get("states", i), t, F.get("ts", i + 1)["tok"]))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(written, ""), "[ \t]*\n[ \t]*", "\n"), "[ \t]{2,}", " ")
    joined = F.regexp_replace(joined, r" \]\(", "](")
    laid = X.trim_all(F.regexp_replace(joined, "\n{3,}", "\n\n"))
    done = folded.select("row", laid.alias("laid"))
    fenced = F.translate(F.regexp_replace("laid", f"{KEPT_LINE}*\n```(?=\n|$)", "\n```"), KEPT_SPACE + KEPT_LINE, " \n")
    return done.select("row", fenced.alias("markdown")).select("row.*", "markdown") if "markdown" not in pages.columns else done.select(*[F.col(f"row.{c}") for c in pages.columns if c != "markdown"], fenced.alias("markdown"))


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    out = html_markdown(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.sha2("markdown", 256).alias("markdown_hash"), F.length("markdown").cast("long").alias("chars"))


QUERIES = {"page_markdown": page_markdown}

#: The pages' content is one article of headings, paragraphs, breaks, bold texts, links and lists; rewritten tag by tag.
MARKDOWN_SQL = r"""m0 AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '\s+', ' ', 'g') AS c FROM pages),
m1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '<a href="([^"#][^"]*)">([^<]*)</a>', '[\2](\1)', 'g'), '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?p>|</h1>|</?ul>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'), '<li>', chr(10) || '- ', 'g') AS c FROM m0),
m2 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS c FROM m1),
md AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[ \t]*\n[ \t]*', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' \]\(', '](', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM m2)"""
ORACLE_SQL = {"page_markdown": f"WITH {MARKDOWN_SQL} SELECT page_id, sha256(c) AS markdown_hash, length(c) AS chars FROM md"}
