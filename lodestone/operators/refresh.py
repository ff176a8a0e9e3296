"""Incremental refresh: snapshot comparison, next snapshot, structural changes, header changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import snapshots, table

KEY = ["source_id", "url"]


def _compared(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    p = prior.select(*KEY, F.col("hash").alias("old"), "tombstoned", F.lit(True).alias("had"))
    n = incoming.select(*KEY, F.col("hash").alias("new"), F.lit(True).alias("has"))
    return p.join(n, KEY, "full_outer")


def snapshot_diff(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """source_id, url, change: added (new or back), updated, unchanged, removed; rows that were gone and stay gone drop out."""
    live = F.coalesce("had", F.lit(False)) & ~F.coalesce("tombstoned", F.lit(False))
    has = F.coalesce("has", F.lit(False))
    change = F.when(has & ~live, "added").when(has & (F.col("old") != F.col("new")), "updated").when(has, "unchanged").when(live, "removed")
    return _compared(prior, incoming).select(*KEY, change.alias("change")).filter(F.col("change").isNotNull())


def snapshot_next(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows live; others tombstoned and kept."""
    has = F.coalesce("has", F.lit(False))
    return _compared(prior, incoming).select(*KEY, F.coalesce("new", "old").alias("hash"), (~has).alias("tombstoned"))


def snapshot_diff_q(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(*snapshots(spark, d))


def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source, and whether a baseline was captured: no live prior row."""
    prior, incoming = snapshots(spark, d)
    counts = snapshot_diff(prior, incoming).groupBy("source_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")])
    live = prior.groupBy("source_id").agg(F.count_if(~F.col("tombstoned")).alias("live"))
    return counts.join(live, "source_id", "left").select("source_id", "added", "updated", "removed", "unchanged", (F.coalesce("live", F.lit(0)) == 0).alias("baseline"))


def snapshot_next_q(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_next(*snapshots(spark, d))


def delete_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the index without those of changed or removed pages."""
    prior, incoming = snapshots(spark, d)
    gone = snapshot_diff(prior, incoming).filter(F.col("change").isin("updated", "removed"))
    return prior.join(gone, KEY, "left_anti").select(*KEY, "hash")


def structural_changes(spark: SparkSession, d: str) -> DataFrame:
    """Anti joins both ways between the live catalogue and the crawl."""
    prior, incoming = snapshots(spark, d)
    live = prior.filter(~F.col("tombstoned"))
    added = incoming.join(live, KEY, "left_anti").select(*KEY, F.lit("added").alias("change"))
    return added.unionByName(live.join(incoming, KEY, "left_anti").select(*KEY, F.lit("removed").alias("change")))


def header_change(stored_etag, stored_date, etag, date, status):
    """304 unchanged; nothing stored is a baseline; else a difference in an etag, or a date, that both sides have."""
    known = stored_etag.isNotNull() | stored_date.isNotNull()
    by_etag = F.when(stored_etag.isNotNull() & etag.isNotNull(), stored_etag != etag)
    by_date = F.when(stored_date.isNotNull() & date.isNotNull(), stored_date != date)
    return F.when(status == 304, "unchanged").when(~known, "baseline").when(F.coalesce(by_etag, by_date, F.lit(False)), "changed").otherwise("unchanged")


def header_changes(spark: SparkSession, d: str) -> DataFrame:
    """Headers made from order rows: status, stored and seen etag and date."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey") % 7, F.col("o_custkey"), "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey")
    stored_etag = F.when(k % 3 != 0, F.col("o_orderpriority"))
    etag = F.when(k % 5 != 0, F.when(k % 4 == 0, F.concat("o_orderpriority", F.lit("x"))).otherwise(F.col("o_orderpriority")))
    stored_date, date = F.when(k % 2 == 0, F.col("o_orderstatus")), F.when(k % 11 != 0, F.lit("O"))
    status = F.when(k % 13 == 0, 304).otherwise(200)
    return o.select("o_orderkey", header_change(stored_etag, stored_date, etag, date, status).alias("change"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with their keys: an anti join and a union."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    prior, incoming = snapshots(spark, d)
    return upsert(prior.select(*KEY, "hash"), incoming.select(*KEY, "hash"), KEY)


QUERIES = {
    "snapshot_diff": snapshot_diff_q, "snapshot_summary": snapshot_summary, "snapshot_next": snapshot_next_q, "delete_by_url": delete_by_url,
    "structural_changes": structural_changes, "header_change": header_changes, "vector_upsert": vector_upsert,
}

_S = """b AS (SELECT doc_id, source AS source_id, 'https://docs.example.org/' || doc_id AS url, sha256(coalesce(text, '')) AS hash FROM documents),
p AS (SELECT source_id, url, hash, doc_id % 11 = 0 AS tombstoned FROM b WHERE doc_id % 11 <> 0 OR doc_id % 2 = 0),
i AS (SELECT source_id, url, CASE WHEN doc_id % 7 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM b WHERE doc_id % 10 <> 0),
j AS (SELECT source_id, url, p.hash AS old, i.hash AS new, p.url IS NOT NULL AND NOT coalesce(tombstoned, false) AS live, p.url IS NOT NULL AS had, i.url IS NOT NULL AS has
  FROM p FULL JOIN i USING (source_id, url)),
c AS (SELECT * FROM (SELECT source_id, url, CASE WHEN has AND NOT live THEN 'added' WHEN has AND old <> new THEN 'updated' WHEN has THEN 'unchanged' WHEN live THEN 'removed' END AS change FROM j) WHERE change IS NOT NULL)"""
_S = _S.replace("p.url IS NOT NULL", "p.hash IS NOT NULL").replace("i.url IS NOT NULL", "i.hash IS NOT NULL")
ORACLE_SQL = {
    "snapshot_diff": f"WITH {_S} SELECT * FROM c",
    "snapshot_summary": f"""WITH {_S} SELECT source_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged,
coalesce((SELECT count(*) FILTER (NOT tombstoned) FROM p WHERE p.source_id = c.source_id), 0) = 0 AS baseline FROM c GROUP BY source_id""",
    "snapshot_next": f"WITH {_S} SELECT source_id, url, coalesce(new, old) AS hash, NOT has AS tombstoned FROM j",
    "delete_by_url": f"WITH {_S} SELECT source_id, url, hash FROM p WHERE (source_id, url) NOT IN (SELECT (source_id, url) FROM c WHERE change IN ('updated', 'removed'))",
    "structural_changes": f"WITH {_S} SELECT source_id, url, 'added' AS change FROM j WHERE has AND NOT live UNION ALL SELECT source_id, url, 'removed' FROM j WHERE live AND NOT has",
    "header_change": """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 304 ELSE 200 END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS se,
CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || 'x' ELSE o_orderpriority END END AS e, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS sd, CASE WHEN o_orderkey % 11 <> 0 THEN 'O' END AS dt FROM orders)
SELECT o_orderkey, CASE WHEN status = 304 THEN 'unchanged' WHEN se IS NULL AND sd IS NULL THEN 'baseline' WHEN coalesce(se <> e, sd <> dt, false) THEN 'changed' ELSE 'unchanged' END AS change FROM h""",
    "vector_upsert": f"WITH {_S} SELECT source_id, url, coalesce(new, old) AS hash FROM j",
}
