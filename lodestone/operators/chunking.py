"""Chunk windows, hashes and near-duplicate collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import constants as C
from ..functions import text as X
from ..sources.tables import table
from .retrieval import every_term_sql


def window_count(length: Column, size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> Column:
    step = size - overlap
    return F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / F.lit(float(step))).cast("int") + 1)


def chunk_windows(docs: DataFrame, size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> DataFrame:
    """doc_id, text -> one row per window: chunk_index, text (trimmed; blank windows are dropped)."""
    step = size - overlap
    whole = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    cuts = F.transform(F.sequence(F.lit(0), window_count(F.length("_t"), size, overlap) - 1), lambda i: X.trim_all(F.substr(F.col("_t"), i * step + 1, F.lit(size))))
    rows = whole.select(*[c for c in docs.columns if c != "text"], F.posexplode(cuts).alias("chunk_index", "text"))
    return rows.filter(F.col("text") != "")


def doc_chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_windows(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("chars"), X.estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.sha2("text", 256).alias("chunk_hash"))


def chunk_count_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", window_count(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chunks"))


def doc_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def index_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and characters per source, and per page."""
    t = table(spark, d, "documents").select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return t.groupBy("source").agg(F.count("*").alias("pages"), F.sum(window_count(F.col("n"))).cast("long").alias("chunks"), F.sum("n").cast("long").alias("chars"), F.round(F.avg(window_count(F.col("n")).cast("double")), 6).alias("chunks_per_page"))


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each trimmed text, and how many share it."""
    t = table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def near_duplicate_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each source and tail fingerprint."""
    key = X.near_duplicate_key(F.col("source"), F.coalesce("text", F.lit("")))
    t = table(spark, d, "documents").select("doc_id", F.md5(key).alias("k"))
    return t.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("collapsed")).select("doc_id", "collapsed")


def query_terms_q(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the benchmark passages, in order."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


def repo_grep(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a phrase, in any case; line text is cut to 240 characters for display."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return lines.filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.substring("text", 1, 240).alias("text"))


def page_chunk_preview(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a document joined in order again: their number and length."""
    rows = chunk_windows(table(spark, d, "documents").select("doc_id", "text"))
    joined = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    return joined.select("doc_id", F.size("c").cast("long").alias("chunks"), F.length(whole).cast("long").alias("chars"))


def heading_stack(lines: Column) -> Column:
    """The headings that hold after the last line: a heading drops the deeper ones. For arrays of markdown lines."""
    level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6}) ", 1))
    zero = F.expr("cast(array() as array<struct<level:int,title:string>>)")
    step = lambda a, x: F.when(level(x) == 0, a).otherwise(F.concat(F.filter(a, lambda h: h["level"] < level(x)), F.array(F.struct(level(x).alias("level"), F.trim(F.regexp_replace(x, "^#+ ", "")).alias("title")))))
    return F.aggregate(lines, zero, step, lambda a: F.transform(a, lambda h: h["title"]))


QUERIES = {
    "doc_chunk_windows": doc_chunk_windows, "chunk_count_estimate": chunk_count_estimate, "doc_content_hash": doc_content_hash, "index_size_estimate": index_size_estimate,
    "exact_dedupe": exact_dedupe, "near_duplicate_collapse": near_duplicate_collapse, "query_terms": query_terms_q, "repo_grep": repo_grep, "page_chunk_preview": page_chunk_preview,
}

_N = "CASE WHEN length(t) <= 4096 THEN 1 ELSE ceil((length(t) - 4096) / 3496.0::DOUBLE)::BIGINT + 1 END"
_CHUNKS = rf"""d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, i AS chunk_index, regexp_replace(substr(t, i * 3496 + 1, 4096), '^\s+|\s+$', '', 'g') AS x FROM d, unnest(range(0, {_N})) AS r(i)), k AS (SELECT * FROM c WHERE x <> '')"""
_FILLER = ", ".join(f"'{w}'" for w in C.FILLER_WORDS)
ORACLE_SQL = {
    "doc_chunk_windows": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, length(x) AS chars, greatest(1, ceil(length(x) / 4.0)::BIGINT) AS tokens, sha256(x) AS chunk_hash FROM k",
    "chunk_count_estimate": f"SELECT doc_id, {_N} AS chunks FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "doc_content_hash": r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash FROM documents",
    "index_size_estimate": f"SELECT source, count(*) AS pages, sum({_N})::BIGINT AS chunks, sum(length(t))::BIGINT AS chars, round(avg(({_N})::DOUBLE), 6) AS chunks_per_page FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY 1",
    "exact_dedupe": r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(regexp_replace(text, '^\s+|\s+$', '', 'g'))",
    "near_duplicate_collapse": "SELECT min(doc_id) AS doc_id, count(*) AS collapsed FROM (SELECT doc_id, source, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') AS p FROM documents) GROUP BY source, right(p, 240)",
    "query_terms": f"""WITH i AS (SELECT item_id, t AS term, ord FROM (SELECT item_id, {every_term_sql('text')} AS l FROM benchmark), unnest(l) WITH ORDINALITY AS u(t, ord)),
f AS (SELECT item_id, term, min(ord) AS ord, row_number() OVER (PARTITION BY item_id ORDER BY min(ord)) AS n FROM i WHERE length(term) >= 2 AND term NOT IN ({_FILLER}) GROUP BY 1, 2)
SELECT b.item_id, coalesce(string_agg(term, ' ' ORDER BY ord) FILTER (n <= 24), '') AS terms FROM benchmark b LEFT JOIN f USING (item_id) GROUP BY 1""",
    "repo_grep": "SELECT doc_id, line, substr(x, 1, 240) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(l) WITH ORDINALITY AS u(x, line) WHERE contains(lower(x), 'license')",
    "page_chunk_preview": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks, (sum(length(x)) + 2 * (count(*) - 1))::BIGINT AS chars FROM k GROUP BY 1",
}
