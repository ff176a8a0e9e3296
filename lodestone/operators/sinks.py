"""Index writes as DataFrames: upserts, replacements, deletes, catalogues, refresh checks and their application.

A sink takes the table as it is and the changes, and returns the table as it shall be: write it over the partitions of the
sources that changed (``spark.sql.sources.partitionOverwriteMode=dynamic``) or to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.tables import snapshots, table
from .chunking import chunk_windows
from .refresh import KEY, header_change, snapshot_diff, snapshot_next, upsert


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError with some of the keys that occur twice."""
    twice = [r[0] for r in df.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"{key} is not unique: {twice}")
    return df


def replace_sources(base: DataFrame, rows: DataFrame, source: str = "source_id") -> DataFrame:
    """base with all rows of the sources in rows replaced by them."""
    return base.join(rows.select(source).distinct(), source, "left_anti").unionByName(rows)


def postings(chunks: DataFrame) -> DataFrame:
    """id, text -> id, term, tf."""
    return chunks.select("id", F.explode(X.index_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def lexical_upsert(base: DataFrame, chunks: DataFrame) -> DataFrame:
    """Postings with those of the given chunks in place of what these had."""
    return base.join(chunks.select("id").distinct(), "id", "left_anti").unionByName(postings(chunks))


def hash_sync(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Latest hash of every url, without marking unseen ones as gone: a tombstone is lifted where a row comes back."""
    both = base.select(*KEY, "hash", "tombstoned", F.lit(0).alias("n")).unionByName(rows.select(*KEY, "hash", F.lit(False).alias("tombstoned"), F.lit(1).alias("n")))
    last = both.groupBy(*KEY).agg(F.max(F.struct("n", "hash", "tombstoned")).alias("x"))
    return last.select(*KEY, "x.hash", "x.tombstoned")


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame, key: str = "source_id") -> dict[str, DataFrame]:
    """All tables without the rows of the sources that go: vectors, lexical rows, catalogues, runs, and the sources themselves."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def mark_indexed(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with the pages and chunks of their index; 0 where there is none."""
    stats = chunks.groupBy("source_id").agg(F.countDistinct("url").alias("page_count"), F.count("*").alias("chunk_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(stats, "source_id", "left").select(*sources.columns, zero("page_count"), zero("chunk_count"))


def catalog_documents(pages: DataFrame) -> DataFrame:
    """source_id, url, title -> source_id, document: the catalogue of a source as JSON, pages in the order of their urls.

    One catalogue is one value: a source's pages, without their texts, must fit a row.
    """
    listed = pages.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("url", "title"))).alias("pages"))
    return listed.select("source_id", F.to_json(F.struct(F.lit(1).alias("version"), "pages")).alias("document"))


def probe_check(indexed: DataFrame, probes: DataFrame, sitemap: DataFrame) -> DataFrame:
    """source_id, url, change of a header probe of all indexed pages.

    probes: status, stored_etag, stored_date, etag, date by (source_id, url). 404 and 410 are removed, other failures count as
    unchanged, headers decide the rest; urls of the sitemap that are not indexed are added.
    """
    ok = F.col("status").between(200, 299) | (F.col("status") == 304)
    by_header = header_change(F.col("stored_etag"), F.col("stored_date"), F.col("etag"), F.col("date"), F.col("status"))
    change = F.when(F.col("status").isin(404, 410), "removed").when(~F.coalesce(ok, F.lit(False)), "unchanged").when(by_header == "changed", "updated").otherwise(by_header)
    seen = indexed.select(*KEY).join(probes, KEY, "left").select(*KEY, change.alias("change"))
    return seen.unionByName(sitemap.select(*KEY).distinct().join(indexed, KEY, "left_anti").select(*KEY, F.lit("added").alias("change")))


def structural_changelog(indexed: DataFrame, incoming: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages of the index and of a crawl, told apart by canonical key without www: url_key, change.

    added and removed by anti joins; updated where ``changes`` (source_id, url, change) says so and there is no baseline to
    capture; unchanged rows are counted, not keys.
    """
    have, come = indexed.withColumn("url_key", X.url_key(F.col("url"))), incoming.withColumn("url_key", X.url_key(F.col("url")))
    added = come.join(have.select("source_id", "url_key"), ["source_id", "url_key"], "left_anti").select("source_id", "url", F.lit("added").alias("change"))
    removed = have.join(come.select("source_id", "url_key"), ["source_id", "url_key"], "left_anti").select("source_id", "url", F.lit("removed").alias("change"))
    both = come.join(have.select("source_id", "url_key").distinct(), ["source_id", "url_key"], "left_semi").join(changes.select(*KEY, F.col("change").alias("c")), KEY, "left")
    return added.unionByName(removed).unionByName(both.select("source_id", "url", F.when(F.col("c") == "updated", "updated").otherwise("unchanged").alias("change")))


def refresh_apply(chunks: DataFrame, prior: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and the snapshot after a refresh.

    chunks: source_id, url, chunk_index, text; incoming: source_id, url, hash, text. Chunks of updated and removed pages go,
    added and updated pages are chunked again; the snapshot is upserted with tombstones.
    """
    change = snapshot_diff(prior, incoming)
    gone = change.filter(F.col("change").isin("updated", "removed", "added"))
    fresh = incoming.join(change.filter(F.col("change").isin("updated", "added")).select(*KEY), KEY, "left_semi")
    made = chunk_windows(fresh.select(*KEY, "text")).select(*KEY, F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    kept = chunks.join(gone.select(*KEY), KEY, "left_anti").select(*KEY, F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    return kept.unionByName(made), snapshot_next(prior, incoming)


# --- queries over the tables ---------------------------------------------------------------------------------------


def _url(column: Column) -> Column:
    return F.concat(F.lit("https://docs.example.org/"), column.cast("string"))


def unique_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids are unique before they are written; the changed rows replace those with their ids."""
    docs = table(spark, d, "documents").select(X.chunk_id(F.col("source"), _url(F.col("doc_id")), F.lit(0)).alias("id"), "doc_id", F.lit(0).alias("version"))
    changed = assert_unique(docs.filter("doc_id % 7 = 0").withColumn("version", F.lit(1)), "id")
    return upsert(docs, changed, ["id"]).select("id", "doc_id", F.col("version").cast("long").alias("version"))


def replace_all(spark: SparkSession, d: str) -> DataFrame:
    """Sources with an even last digit are written anew with every second document."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), "doc_id")
    anew = docs.filter(F.col("source_id").rlike("[02468]$") & (F.col("doc_id") % 2 == 1))
    return replace_sources(docs, anew)


def lexical_upsert_q(spark: SparkSession, d: str) -> DataFrame:
    """The frequencies of terms after every seventh document was changed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    changed = docs.filter("id % 7 = 0").select("id", F.concat(F.lit("changed changed "), F.coalesce("text", F.lit(""))).alias("text"))
    return lexical_upsert(postings(docs), changed).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


def hash_only_sync(spark: SparkSession, d: str) -> DataFrame:
    return hash_sync(*snapshots(spark, d))


def source_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after a third of the sources was deleted with all that hangs on them."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), "doc_id")
    labels = table(spark, d, "labels").join(docs, "doc_id").select("source_id", "doc_id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).join(docs, "doc_id").select("source_id", "doc_id")
    sources = docs.select("source_id").distinct()
    left = delete_sources({"sources": sources, "chunks": docs, "runs": labels, "vectors": vectors}, sources.filter(F.col("source_id").rlike("[0369]$")))
    out = None
    for name, df in left.items():
        mine = df.groupBy("source_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "source_id", "rows")
        out = mine if out is None else out.unionByName(mine)
    return out


def _chunks(docs):
    return chunk_windows(docs).select(*KEY, "chunk_index", "text")


def mark_indexed_q(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), _url(F.col("doc_id")).alias("url"), "text")
    return mark_indexed(docs.select("source_id").distinct(), _chunks(docs))


def catalog_save(spark: SparkSession, d: str) -> DataFrame:
    """Catalogues as JSON and read back: pages, and the hash of their urls in order."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), _url(F.col("doc_id")).alias("url"), F.col("lang").alias("title"))
    read = catalog_documents(docs).select("source_id", F.from_json("document", "version int, pages array<struct<url:string,title:string>>").alias("c"))
    return read.select("source_id", F.size("c.pages").cast("long").alias("pages"), F.sha2(F.array_join(F.col("c.pages.url"), ","), 256).alias("urls_hash"), F.sha2(F.array_join(F.col("c.pages.title"), ","), 256).alias("titles_hash"))


def probe_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Probes made of the documents' numbers; the sitemap lists some pages that are not indexed."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), _url(i).alias("url"))
    status = F.when(i % 11 == 0, 404).when(i % 13 == 0, 500).when(i % 17 == 0, 304).when(i % 19 != 0, 200)
    probes = docs.select(*KEY, status.alias("status"), F.when(i % 3 != 0, "a").alias("stored_etag"), F.when(i % 2 == 0, "x").alias("stored_date"), F.when(i % 5 != 0, F.when(i % 4 == 0, "b").otherwise("a")).alias("etag"), F.when(i % 7 != 0, F.when(i % 8 == 0, "y").otherwise("x")).alias("date"))
    return probe_check(docs.filter("doc_id % 10 <> 3").select(*KEY), probes, docs.filter("doc_id % 2 = 1").select(*KEY))


def structural_changelog_q(spark: SparkSession, d: str) -> DataFrame:
    """A crawl that writes urls in another way: with www, a query, a version folder."""
    prior, incoming = snapshots(spark, d)
    live = prior.filter(~F.col("tombstoned")).select(*KEY)
    other = F.when(F.crc32(F.col("url").cast("binary")) % 3 == 0, F.replace("url", F.lit("https://docs."), F.lit("https://www.docs."))).otherwise(F.concat("url", F.lit("?ref=1")))
    other = F.regexp_replace(other, "example.org/([0-9]+)", "example.org/p$1/v2")
    mine = F.regexp_replace("url", "example.org/([0-9]+)", "example.org/p$1")
    renamed = lambda df, u: df.withColumn("url", u)
    changes = snapshot_diff(prior, incoming)
    return structural_changelog(renamed(live, mine), renamed(incoming, other), renamed(changes, other)).groupBy("source_id", "change").agg(F.count("*").alias("pages"))


def _refresh(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _url(F.col("doc_id")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    prior, incoming = snapshots(spark, d)
    old = prior.filter(~F.col("tombstoned")).join(docs, "url").select(*KEY, "text")
    new = incoming.join(docs, "url").select(*KEY, "hash", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return refresh_apply(_chunks(old), prior, new)


def refresh_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after a refresh, by source."""
    chunks, _ = _refresh(spark, d)
    return chunks.groupBy("source_id").agg(F.countDistinct("url").alias("pages"), F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"))


def owner_listing(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order of their last change, the newest first, with ties by name; as places."""
    last = table(spark, d, "events").groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name")).agg(F.max("ts").alias("updated"))
    return last.select("name", F.row_number().over(W.orderBy(F.desc("updated"), "name")).cast("long").alias("place"))  # one row per source


QUERIES = {
    "unique_upsert": unique_upsert, "replace_all": replace_all, "lexical_upsert": lexical_upsert_q, "hash_only_sync": hash_only_sync, "source_delete": source_delete,
    "mark_indexed": mark_indexed_q, "catalog_save": catalog_save, "probe_refresh": probe_refresh, "structural_changelog": structural_changelog_q, "refresh_index": refresh_index,
    "ordered_listing": owner_listing,
}

_U = "'https://docs.example.org/' || doc_id"
_N = "CASE WHEN length(t) <= 4096 THEN 1 ELSE ceil((length(t) - 4096) / 3496.0::DOUBLE)::BIGINT + 1 END"
_S = """b AS (SELECT doc_id, source AS source_id, 'https://docs.example.org/' || doc_id AS url, sha256(coalesce(text, '')) AS hash FROM documents),
p AS (SELECT doc_id, source_id, url, hash, doc_id % 11 = 0 AS tombstoned FROM b WHERE doc_id % 11 <> 0 OR doc_id % 2 = 0),
i AS (SELECT doc_id, source_id, url, CASE WHEN doc_id % 7 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM b WHERE doc_id % 10 <> 0)"""
ORACLE_SQL = {
    "unique_upsert": f"SELECT source || ':' || left(translate(base64(unhex(sha256({_U}))), '+/', '-_'), 32) || ':0' AS id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS version FROM documents",
    "replace_all": "SELECT source AS source_id, doc_id FROM documents d WHERE doc_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND regexp_matches(e.source, '[02468]$') AND e.doc_id % 2 = 1)",
    "lexical_upsert": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed changed ' || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS term FROM d)
SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS tf FROM w GROUP BY 1""",
    "hash_only_sync": f"WITH {_S} SELECT source_id, url, coalesce(i.hash, p.hash) AS hash, CASE WHEN i.hash IS NULL THEN tombstoned ELSE false END AS tombstoned FROM p FULL JOIN i USING (source_id, url)",
    "source_delete": """WITH s AS (SELECT * FROM documents WHERE NOT regexp_matches(source, '[0369]$'))
SELECT 'sources' AS name, source AS source_id, 1::BIGINT AS rows FROM s GROUP BY 2 UNION ALL SELECT 'chunks', source, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'runs', source, count(*) FROM s JOIN labels USING (doc_id) GROUP BY 2 UNION ALL SELECT 'vectors', source, count(*) FROM s JOIN embeddings ON vec_id = doc_id GROUP BY 2""",
    "mark_indexed": rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, source FROM d, unnest(range(0, {_N})) AS r(i) WHERE regexp_replace(substr(t, i * 3496 + 1, 4096), '^\s+|\s+$', '', 'g') <> '')
SELECT s.source AS source_id, count(DISTINCT c.doc_id) AS page_count, count(c.doc_id) AS chunk_count FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c ON c.source = s.source GROUP BY 1""",
    "catalog_save": f"SELECT source AS source_id, count(*) AS pages, sha256(string_agg({_U}, ',' ORDER BY {_U})) AS urls_hash, sha256(string_agg(lang, ',' ORDER BY {_U})) AS titles_hash FROM documents GROUP BY 1",
    "probe_refresh": f"""WITH d AS (SELECT doc_id AS i, source AS source_id, {_U} AS url FROM documents),
p AS (SELECT *, CASE WHEN i % 11 = 0 THEN 404 WHEN i % 13 = 0 THEN 500 WHEN i % 17 = 0 THEN 304 WHEN i % 19 <> 0 THEN 200 END AS status, CASE WHEN i % 3 <> 0 THEN 'a' END AS se, CASE WHEN i % 2 = 0 THEN 'x' END AS sd, CASE WHEN i % 5 <> 0 THEN CASE WHEN i % 4 = 0 THEN 'b' ELSE 'a' END END AS e, CASE WHEN i % 7 <> 0 THEN CASE WHEN i % 8 = 0 THEN 'y' ELSE 'x' END END AS dt FROM d WHERE i % 10 <> 3)
SELECT source_id, url, CASE WHEN status = 404 THEN 'removed' WHEN status IS NULL OR status = 500 THEN 'unchanged' WHEN status = 304 THEN 'unchanged' WHEN se IS NULL AND sd IS NULL THEN 'baseline' WHEN coalesce(se <> e, sd <> dt, false) THEN 'updated' ELSE 'unchanged' END AS change FROM p
UNION ALL SELECT source_id, url, 'added' FROM d WHERE i % 2 = 1 AND i % 10 = 3""",
    "structural_changelog": f"""WITH {_S}, l AS (SELECT * FROM p WHERE NOT tombstoned),
c AS (SELECT source_id, CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN CASE WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END ELSE 'added' END AS change FROM i UNION ALL SELECT source_id, 'removed' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM i))
SELECT source_id, change, count(*) AS pages FROM c GROUP BY 1, 2""",
    "refresh_index": rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' changed' ELSE '' END AS t FROM documents WHERE doc_id % 10 <> 0),
c AS (SELECT doc_id, source, regexp_replace(substr(t, i * 3496 + 1, 4096), '^\s+|\s+$', '', 'g') AS x FROM d, unnest(range(0, {_N})) AS r(i))
SELECT source AS source_id, count(DISTINCT doc_id) AS pages, count(*) AS chunks, sum(length(x))::BIGINT AS chars FROM c WHERE x <> '' GROUP BY 1""",
    "ordered_listing": "SELECT name, row_number() OVER (ORDER BY updated DESC, name) AS place FROM (SELECT 'user' || user_id AS name, max(ts) AS updated FROM events GROUP BY 1)",
}
