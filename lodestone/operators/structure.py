"""Chunks with structure: headings, sections, examples and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import constants as C
from ..functions import text as X
from ..sources.tables import table
from .chunking import chunk_windows
from .html import MARKDOWN_SQL, html_markdown

SECTION_CHARS, JOIN_CHARS, EXAMPLE_CHARS = C.CHUNK_CHARS, 2000, 2000


def headings_outside_fences(text: Column) -> Column:
    """array<boolean>, for each line that looks like a heading: whether no code fence is open there.

    A fence opens with three or more of ` or ~ and closes at a line of at least as many of the same and nothing else.
    """
    marks = F.regexp_extract_all(text, F.lit(r"\n(?: {0,3}(?:`{3,}|~{3,})[^\n]*|#{1,6}(?=\s))"), F.lit(0))
    fence = lambda m: F.regexp_extract(m, r"^\n *(`{3,}|~{3,})", 1)
    closes = lambda a, m: F.regexp_like(m, F.lit(r"^\n *(?:`+|~+)[ \t\r]*$")) & F.startswith(fence(m), a["open"])
    zero = F.struct(F.lit("").alias("open"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(a: Column, m: Column) -> Column:
        opened = F.when(fence(m) == "", a["open"]).when(a["open"] == "", fence(m)).when(closes(a, m), "").otherwise(a["open"])
        return F.struct(opened.alias("open"), F.when(fence(m) == "", F.array_append(a["out"], a["open"] == "")).otherwise(a["out"]).alias("out"))

    return F.aggregate(marks, zero, step, lambda a: a["out"])


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, section_no, heading_path, text: a section starts at each heading line outside code fences and carries its headings.

    The headings that hold are found per level: the last heading of a level that no higher one has followed. A window over
    the sections of a document, whose size is that of the document.
    """
    rows = docs.select("doc_id", F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("doc_id", F.split("text", r"\n(?=#{1,6}\s)").alias("parts"), headings_outside_fences(F.col("text")).alias("opens"))
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: (i == 0) | F.get("opens", i - 1)))
    whole = F.transform("starts", lambda s, k: F.array_join(F.slice("parts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("parts")) - s), "\n"))
    rows = rows.select("doc_id", F.posexplode(whole).alias("section_no", "text")).withColumn("text", X.trim_all(F.col("text")))
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    title = F.trim(F.regexp_extract("text", r"^#{1,6}\s+([^\n]*)", 1))
    marked = rows.withColumns({"level": level, "title": title})
    here = W.partitionBy("doc_id").orderBy("section_no").rowsBetween(W.unboundedPreceding, 0)
    last = {k: F.max(F.when(F.col("level") == k, F.col("section_no"))).over(here) for k in range(1, 7)}
    named = {f"h{k}": F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(here) for k in range(1, 7)}
    laid = marked.withColumns({f"p{k}": c for k, c in last.items()} | named)
    # A heading holds if it came after every heading of a higher level.
    holds = [F.when(F.col(f"p{k}").isNotNull() & (F.greatest(*[F.coalesce(f"p{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1)) < F.col(f"p{k}")), F.col(f"h{k}")) for k in range(1, 7)]
    return laid.filter("text <> ''").select("doc_id", "section_no", F.array_compact(F.array(*holds)).alias("heading_path"), "text")


def packed(rows: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Adds pack: neighbours in order go together while their sizes fit the budget; one beyond it stands alone.

    Greedy, so a group is folded in order; by document or page, whose sections fit a row. The fold keeps sizes alone.
    """
    listed = rows.withColumn("_size", size.cast("long")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, "_size"))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.lit(-1).cast("long").alias("pack"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["held"] > 0) & (a["held"] + x["_size"] <= budget)
        pack = F.when(joins, a["pack"]).otherwise(a["pack"] + 1)
        held = F.when(joins, a["held"] + x["_size"]).when(x["_size"] > budget, 0).otherwise(x["_size"])
        return F.struct(held.cast("long").alias("held"), pack.alias("pack"), F.array_append(a["out"], pack).alias("out"))

    packs = listed.select(*by, F.explode(F.arrays_zip(F.transform("xs", lambda x: x[order]).alias("o"), F.aggregate("xs", zero, step, lambda a: a["out"]).alias("p"))).alias("z"))
    return rows.join(packs.select(*by, F.col("z.o").alias(order), F.col("z.p").alias("pack")), [*by, order])


def heading_chunks(docs: DataFrame, size: int = SECTION_CHARS, join: int = JOIN_CHARS) -> DataFrame:
    """doc_id, text -> doc_id, chunk_index, heading_path, text: small neighbouring sections together, large ones in windows."""
    sections = packed(markdown_sections(docs), ["doc_id"], "section_no", F.length("text"), join)
    whole = sections.groupBy("doc_id", "pack").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min_by("heading_path", "section_no").alias("heading_path"))
    cut = chunk_windows(whole.select("doc_id", "pack", "heading_path", "text"), size).withColumn("window", F.col("chunk_index")).drop("chunk_index")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("pack", "window")) - 1
    return cut.select("doc_id", n.alias("chunk_index"), "heading_path", "text")


def recursive_chunks(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters: paragraphs, the lines of longer ones, and windows of longer lines."""
    none = F.expr("cast(array() as array<string>)")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / F.lit(float(size))).cast("int") - 1, F.lit(0))), lambda i: F.substr(s, i * size + 1, F.lit(size)))
    lines = lambda p: F.flatten(F.transform(F.split(p, "\n"), lambda x: F.when(F.length(x) <= size, F.array(x)).otherwise(cut(x))))
    every = F.flatten(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(lines(p))))
    return F.coalesce(F.filter(F.transform(every, lambda x: X.trim_all(x)), lambda x: x != ""), none)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """url, heading_path, category, section, text -> adds category, section, kind and sizes: what is given, else headings, else the url."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    u = F.col("url")
    return chunks.withColumns({
        "category": F.coalesce(said("category"), X.url_segment(u, 0, "root")),
        "section": F.coalesce(said("section"), F.get("heading_path", F.lit(0)), X.url_segment(u, 1, "general")),
        "tokens": X.estimate_tokens(F.col("text")), "chars": F.length("text"), "chunk_kind": F.lit("text"),
    })


def embed_text(page: Column, section: Column, kind: Column, language: Column, title: Column, body: Column, part: Column) -> Column:
    """What an example is found by: its place, kind and topic before its body."""
    name = F.concat(F.lit("Kind: "), kind, F.coalesce(F.concat(F.lit(" | Language: "), F.nullif(F.trim(language), F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" | "), part), F.lit("")))
    return F.concat(F.lit("Page: "), F.coalesce(F.nullif(F.trim(page), F.lit("")), F.lit("Untitled")), F.lit(" | Section: "), section, F.lit(" | "), name, F.lit(" | Topic: "), title, F.lit(" | Example:\n"), body)


def example_chunks(examples: DataFrame, most: int = EXAMPLE_CHARS) -> DataFrame:
    """source_id, url, example_index, page, section, kind, language, title, body -> id, part, parts, text: long bodies in parts."""
    pieces = F.when(F.length("body") <= most, F.array("body")).otherwise(recursive_chunks(F.col("body"), most))
    cut = examples.withColumn("_n", F.size(pieces)).select("*", F.posexplode(pieces).alias("part", "_piece"))
    label = F.when(F.col("_n") > 1, F.concat(F.lit("Part "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string")))
    base = F.concat_ws(":", "source_id", X.url_hash(F.col("url")), F.lit("ex"), F.col("example_index").cast("string"))
    text = embed_text(F.col("page"), F.col("section"), F.col("kind"), F.col("language"), F.col("title"), F.col("_piece"), label)
    return cut.select("source_id", "url", F.when(F.col("_n") > 1, F.concat(base, F.lit(":p:"), F.col("part").cast("string"))).otherwise(base).alias("id"), "part", F.col("_n").alias("parts"), text.alias("text"))


def merged_examples(results: DataFrame) -> DataFrame:
    """page, section_no, order, body -> page, example_index, body: bodies once (white space and case aside), numbered anew."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("body", r"\s+", " "))))
    first = results.filter(~F.regexp_like("body", F.lit(r"^\s*$"))).groupBy("page", key.alias("_k")).agg(F.min(F.struct("section_no", "order", "body")).alias("f"))
    n = F.row_number().over(W.partitionBy("page").orderBy("f.section_no", "f.order")) - 1
    return first.select("page", n.alias("example_index"), F.col("f.body").alias("body"))


def catalog_prompt(pages: DataFrame, budget: int = 28_000, most: int = 60) -> DataFrame:
    """source_id, category, url, title -> source_id, place, line: the catalogue as text within a budget of characters.

    A catalogue that fits is flat. Else categories come by size, with at most 60 pages each, until the first line that does
    not fit. One source's catalogue, without texts, is ordered in one task.
    """
    line = F.concat(F.lit("- "), "title", F.lit(" ("), "url", F.lit(")"))
    rows = pages.withColumn("line", line).withColumn("size", F.length("line") + 1)
    per = W.partitionBy("source_id")
    rows = rows.withColumns({"total": F.sum("size").over(per), "members": F.count("*").over(W.partitionBy("source_id", "category")), "n": F.row_number().over(W.partitionBy("source_id", "category").orderBy("url"))})
    flat = rows.filter(F.col("total") <= budget).select("source_id", F.lit(0).cast("long").alias("members"), F.lit("").alias("category"), F.lit(1).alias("n"), "url", "line", "size")
    grouped = rows.filter((F.col("total") > budget) & (F.col("n") <= most))
    heads = grouped.filter("n = 1").select("source_id", "members", "category", F.lit(0).alias("n"), F.lit("").alias("url"), F.concat(F.lit("## "), "category").alias("line"), (F.length("category") + 4).alias("size"))
    every = flat.unionByName(grouped.select("source_id", "members", "category", "n", "url", "line", "size")).unionByName(heads)
    order = W.partitionBy("source_id").orderBy(F.desc("members"), "category", "n", "url")
    laid = every.withColumns({"place": F.row_number().over(order), "spent": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
    return laid.filter(F.col("spent") <= budget).select("source_id", "place", "line")


# --- queries over the tables ---------------------------------------------------------------------------------------


def _markdown(spark, d):
    """Documents with a heading before every fourth line, of levels 1 to 4."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    head = lambda i: F.concat(F.repeat(F.lit("#"), ((i + F.col("doc_id")) % 4 + 1).cast("int")), F.lit(" H"), i.cast("string"), F.lit("\n"))
    text = F.array_join(F.transform(lines, lambda x, i: F.when(i % 4 == 1, F.concat(head(i), F.regexp_replace(x, "^#+", ""))).otherwise(F.regexp_replace(x, "^#+", ""))), "\n")
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return markdown_sections(_markdown(spark, d)).select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.array_join("heading_path", " > ").alias("headings"), F.sha2("text", 256).alias("text_hash"))


def section_packs(spark: SparkSession, d: str) -> DataFrame:
    out = packed(markdown_sections(_markdown(spark, d)), ["doc_id"], "section_no", F.length("text"), 500)
    return out.groupBy("doc_id", "pack").agg(F.count("*").alias("sections"), F.sum(F.length("text")).cast("long").alias("chars"))


def heading_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents with headings, with their metadata, by document and section."""
    c = heading_chunks(_markdown(spark, d)).withColumn("url", F.concat(F.lit("https://e.org/docs/p"), F.col("doc_id").cast("string"))).withColumns({"category": F.lit(" "), "section": F.lit(None).cast("string")})
    return chunk_metadata(c).groupBy("doc_id", "category", "section").agg(F.count("*").alias("chunks"), F.sum("chars").cast("long").alias("chars"), F.sum("tokens").cast("long").alias("tokens"))


def recursive_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.explode(recursive_chunks(F.coalesce("text", F.lit("")), 300))
    return table(spark, d, "documents").select("doc_id", pieces.alias("p")).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("p")).cast("long").alias("chars"), F.max(F.length("p")).cast("long").alias("longest"))


def _example_rows(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("https://e.org/"), F.floor(i / 3).cast("string")).alias("url"), (i % 3).alias("example_index"), F.when(i % 5 != 0, "Page").otherwise(" ").alias("page"), F.col("lang").alias("section"), F.lit("code").alias("kind"), F.when(i % 2 == 0, "js").alias("language"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def example_chunk_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts of examples whose bodies fit one chunk, and the number of parts of the others."""
    c = example_chunks(_example_rows(spark, d))
    return c.groupBy("url", "parts").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"), F.max(F.when(F.col("parts") == 1, F.sha2("text", 256))).alias("text_hash")).withColumn("parts", F.col("parts").cast("long")).filter("parts = 1 or chunks > 0")


def merged_example_bodies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    body = F.when(i % 4 == 0, F.concat(F.lit("  "), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(F.col("source").alias("page"), F.floor(i / 10).alias("section_no"), i.alias("order"), body.alias("body"))
    return merged_examples(rows).select("page", F.col("example_index").cast("long").alias("example_index"), F.sha2("body", 256).alias("body_hash"))


def catalog_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("category"), F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"))
    return catalog_prompt(docs, budget=400, most=4).withColumn("place", F.col("place").cast("long"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the web pages, from their markdown."""
    md = html_markdown(table(spark, d, "pages").select("page_id", "url", "html")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return markdown_sections(md).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("sections"))


QUERIES = {
    "heading_sections": heading_sections, "section_packs": section_packs, "heading_chunks": heading_chunk_index, "recursive_pieces": recursive_pieces, "example_chunk_drafts": example_chunk_drafts,
    "merged_examples": merged_example_bodies, "catalog_prompt": catalog_prompts, "page_sections": page_sections,
}

_MD = r"""md0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
md1 AS (SELECT doc_id, i - 1 AS i, CASE WHEN (i - 1) % 4 = 1 THEN (i - 1 + doc_id) % 4 + 1 ELSE 0 END AS lv, regexp_replace(x, '^#+', '') AS x FROM md0, unnest(l) WITH ORDINALITY AS u(x, i)),
md2 AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM md1),
md3 AS (SELECT doc_id, s::BIGINT AS section_no, max(lv) AS lv, max(CASE WHEN lv > 0 THEN 'H' || i END) AS h, regexp_replace(string_agg(CASE WHEN lv > 0 THEN repeat('#', lv::INT) || ' H' || i || chr(10) ELSE '' END || x, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS t FROM md2 GROUP BY 1, 2),
md4 AS (SELECT a.doc_id, a.section_no, a.t, (SELECT coalesce(string_agg(b.h, ' > ' ORDER BY b.lv), '') FROM md3 b WHERE b.doc_id = a.doc_id AND b.section_no <= a.section_no AND b.lv > 0 AND NOT EXISTS (SELECT 1 FROM md3 c WHERE c.doc_id = a.doc_id AND c.section_no <= a.section_no AND c.section_no > b.section_no AND c.lv > 0 AND c.lv <= b.lv)) AS path FROM md3 a WHERE t <> '')"""


def _pack_sql(budget: int) -> str:
    return f"""pk0 AS (SELECT doc_id, section_no, t, path, length(t) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS k FROM md4),
pk AS (SELECT doc_id, section_no, t, path, k, 0::BIGINT AS pack, CASE WHEN z > {budget} THEN 0 ELSE z END AS held FROM pk0 WHERE k = 1
  UNION ALL SELECT p.doc_id, p.section_no, p.t, p.path, p.k, CASE WHEN pk.held > 0 AND pk.held + p.z <= {budget} THEN pk.pack ELSE pk.pack + 1 END, CASE WHEN pk.held > 0 AND pk.held + p.z <= {budget} THEN pk.held + p.z WHEN p.z > {budget} THEN 0 ELSE p.z END FROM pk JOIN pk0 p ON p.doc_id = pk.doc_id AND p.k = pk.k + 1)"""


_RC = """l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS p FROM documents), m AS (SELECT doc_id, unnest(CASE WHEN length(p) <= {n} THEN [p] ELSE string_split(p, chr(10)) END) AS x FROM l),
c AS (SELECT doc_id, regexp_replace(substr(x, i * {n} + 1, {n}), '^\\s+|\\s+$', '', 'g') AS p FROM m, unnest(range(0, greatest(ceil(length(x) / {n}.0::DOUBLE)::BIGINT, 1))) AS r(i))"""
ORACLE_SQL = {
    "heading_sections": f"WITH {_MD} SELECT doc_id, section_no, path AS headings, sha256(t) AS text_hash FROM md4",
    "section_packs": f"WITH RECURSIVE {_MD}, {_pack_sql(500)} SELECT doc_id, pack, count(*) AS sections, sum(length(t))::BIGINT AS chars FROM pk GROUP BY 1, 2",
    "heading_chunks": rf"""WITH RECURSIVE {_MD}, {_pack_sql(2000)}, w AS (SELECT doc_id, pack, string_agg(t, chr(10) || chr(10) ORDER BY section_no) AS t, first(path ORDER BY section_no) AS path FROM pk GROUP BY 1, 2),
c AS (SELECT doc_id, path, regexp_replace(substr(t, i * 3496 + 1, 4096), '^\s+|\s+$', '', 'g') AS x FROM w, unnest(range(0, CASE WHEN length(t) <= 4096 THEN 1 ELSE ceil((length(t) - 4096) / 3496.0::DOUBLE)::BIGINT + 1 END)) AS r(i))
SELECT doc_id, 'docs' AS category, coalesce(nullif(split_part(path, ' > ', 1), ''), 'p' || doc_id) AS section, count(*) AS chunks, sum(length(x))::BIGINT AS chars, sum(greatest(1, ceil(length(x) / 4.0::DOUBLE)::BIGINT))::BIGINT AS tokens FROM c WHERE x <> '' GROUP BY 1, 2, 3""",
    "recursive_pieces": f"WITH {_RC.format(n=300)} SELECT doc_id, count(*) AS pieces, sum(length(p))::BIGINT AS chars, max(length(p)) AS longest FROM c WHERE p <> '' GROUP BY 1",
    "example_chunk_drafts": f"""WITH {_RC.format(n=2000)}, e AS (SELECT doc_id, source, 'https://e.org/' || (doc_id // 3) AS url, doc_id % 3 AS x, lang, coalesce(text, '') AS body FROM documents),
n AS (SELECT e.*, CASE WHEN length(body) <= 2000 THEN 1 ELSE (SELECT count(*) FROM c WHERE c.doc_id = e.doc_id AND p <> '') END AS parts, source || ':' || left(translate(base64(unhex(sha256(url))), '+/', '-_'), 32) || ':ex:' || x AS id FROM e),
r AS (SELECT *, 'Page: ' || CASE WHEN doc_id % 5 <> 0 THEN 'Page' ELSE 'Untitled' END || ' | Section: ' || lang || ' | Kind: code' || CASE WHEN doc_id % 2 = 0 THEN ' | Language: js' ELSE '' END || ' | Topic: T' || doc_id || ' | Example:' || chr(10) || body AS t FROM n)
SELECT url, parts, sum(parts)::BIGINT AS chunks, min(id || CASE WHEN parts > 1 THEN ':p:0' ELSE '' END) AS first_id, max(CASE WHEN parts = 1 THEN sha256(t) END) AS text_hash FROM r WHERE parts > 0 GROUP BY 1, 2""",
    "merged_examples": r"""WITH r AS (SELECT source AS page, doc_id // 10 AS s, doc_id AS o, CASE WHEN doc_id % 4 = 0 THEN '  ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS body FROM documents),
f AS (SELECT page, first(s ORDER BY s, o) AS s, first(o ORDER BY s, o) AS o, first(body ORDER BY s, o) AS body FROM r WHERE trim(body) <> '' GROUP BY page, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))))
SELECT page, row_number() OVER (PARTITION BY page ORDER BY s, o) - 1 AS example_index, sha256(body) AS body_hash FROM f""",
    "catalog_prompt": """WITH r AS (SELECT source AS source_id, lang AS category, 'https://e.org/' || doc_id AS url, '- Page ' || doc_id || ' (https://e.org/' || doc_id || ')' AS line FROM documents),
w AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY source_id) AS total, count(*) OVER (PARTITION BY source_id, category) AS m, row_number() OVER (PARTITION BY source_id, category ORDER BY url) AS n FROM r),
e AS (SELECT source_id, 0 AS m, '' AS category, 1 AS n, url, line FROM w WHERE total <= 400 UNION ALL SELECT source_id, m, category, n, url, line FROM w WHERE total > 400 AND n <= 4 UNION ALL SELECT source_id, m, category, 0, '', '## ' || category FROM w WHERE total > 400 AND n = 1),
l AS (SELECT *, row_number() OVER o AS place, sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY m DESC, category, n, url ROWS UNBOUNDED PRECEDING) AS spent FROM e WINDOW o AS (PARTITION BY source_id ORDER BY m DESC, category, n, url))
SELECT source_id, place, line FROM l WHERE spent <= 400""",
    "page_sections": f"WITH {MARKDOWN_SQL} SELECT page_id, len(regexp_extract_all(c, '(?m)^#{{1,6}} ')) + (NOT regexp_matches(c, '^#{{1,6}} '))::INT AS sections FROM md WHERE c <> ''",
}
