"""Rate limits and usage over the event stream, as batch queries and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import route_matches, route_specificity
from ..sources.tables import checkpointed, table


def windowed_counts(events: DataFrame, minutes: int = 60, limit: int = 20) -> DataFrame:
    """Aligned windows per key: events, how many the limit allows and denies. Works on streams and tables."""
    counted = events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("denied"))


def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(table(spark, d, "events"))
    return out.withColumn("start", F.unix_timestamp("start")).withColumn("allowed", F.col("allowed").cast("long"))


def token_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Usage per day and type: sums, and the total worked out again from its parts."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.floor("value").cast("long").alias("inp"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("out"))
    return e.groupBy("day", "event_type").agg(F.sum("inp").alias("input_tokens"), F.sum("out").alias("output_tokens"), F.sum(F.col("inp") + F.col("out")).alias("total_tokens"))


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per user that end after 30 minutes without an event."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def anchored_windows(events: DataFrame, seconds: int = 3600, limit: int = 3, key: str = "user_id") -> DataFrame:
    """Fixed windows that open with a key's first event outside the last one: adds allowed to (key, event_id, t) rows.

    t is in seconds. Rows are sorted by key and time within their partition and read as a stream, so that the state is two
    numbers and the time linear, however many events a key has; the events of one key are read in order by one task.
    Nothing of a denied event is counted. Events without a time come first and are one window; null keys are one key.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, n = object(), None, 0
        for batch in batches:
            ok = []
            for k, t in zip(batch[key], batch["t"]):
                k = None if pd.isna(k) else k
                if k != last:
                    last, opened, n = k, None, 0
                if not pd.isna(t) and (opened is None or t - opened >= seconds):
                    opened, n = t, 0
                ok.append(n < limit)
                n += n < limit
            yield batch.assign(allowed=ok)

    ordered = events.repartition(key).sortWithinPartitions(key, "t", "event_id")
    return ordered.mapInPandas(fold, f"{kinds}, allowed boolean")


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")


#: Requests for each address and site a minute, for a site a day, for a site and origin a minute.
LAYERS = (("ip", ["ip"], 60, 20), ("site", ["site"], 60, 60), ("site_day", ["site", "day"], 86_400, 2_000), ("site_origin", ["site", "origin"], 60, 40))


def layered_limits(requests: DataFrame, layers=LAYERS) -> DataFrame:
    """event_id, t, day, ip, site, origin -> event_id, denied_by: the first limit that a request runs into, null if none.

    A request that is denied by one limit is not counted by those after it, so each limit sees what the ones before let
    through: one fold by its key after another, each run once and cut by checkpoint().
    """
    left, out = requests, None
    for name, keys, seconds, limit in layers:
        keyed = left.withColumn("_limit_key", F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys]))
        judged = checkpointed(anchored_windows(keyed, seconds, limit, "_limit_key").drop("_limit_key"))
        denied = judged.filter(~F.col("allowed")).select("event_id", F.lit(name).alias("denied_by"))
        out = denied if out is None else out.unionByName(denied)
        left = judged.filter("allowed").drop("allowed")
    return out.unionByName(left.select("event_id", F.lit(None).cast("string").alias("denied_by")))


def layered_limit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Requests of users as addresses on three sites; the limits are lower than the fixed ones, as the events are few."""
    e = _timed(spark, d).withColumnRenamed("user_id", "ip").withColumn("site", F.col("event_id") % 3).withColumn("origin", F.col("event_type"))
    layers = (("ip", ["ip"], 86_400, 3), ("site", ["site"], 7_200, 4), ("site_day", ["site", "day"], 86_400, 25), ("site_origin", ["site", "origin"], 86_400, 5))
    return layered_limits(e, layers).groupBy("denied_by").agg(F.count("*").alias("requests"), F.sum("event_id").alias("id_sum"))


def resolve_routes(requests: DataFrame, rules: DataFrame, read: int = 120, write: int = 60) -> DataFrame:
    """method, path; method, template, bucket, max_per_window -> requests with bucket, max_per_window and matched_by.

    The most specific fitting template wins (ten for each segment, one for each literal one), ties by template; else the
    fall-back for reads or writes. Rules are a catalogue and meet the distinct paths of their method and length only.
    """
    n = lambda c: F.size(F.filter(F.split(c, "/"), lambda s: s != ""))
    asked = requests.select("method", "path").distinct().withColumn("n", n(F.col("path")))
    known = rules.select(F.col("method").alias("rule_method"), "template", "bucket", "max_per_window").withColumn("rule_n", n(F.col("template")))
    met = asked.join(known, (F.upper("method") == F.col("rule_method")) & (F.col("n") == F.col("rule_n")) & route_matches(F.col("template"), F.col("path")))
    best = met.groupBy("method", "path").agg(F.min_by(F.struct("bucket", "max_per_window"), F.struct((-route_specificity(F.col("template"))).alias("s"), "template")).alias("b"))
    reads = F.upper("method").isin("GET", "HEAD", "OPTIONS")
    out = requests.join(best, ["method", "path"], "left")
    fallback = lambda a, b: F.when(reads, a).otherwise(b)
    return out.select(*requests.columns, F.coalesce("b.bucket", fallback("fallback_read", "fallback_write")).alias("bucket"), F.coalesce("b.max_per_window", fallback(read, write)).alias("max_per_window"), F.when(F.col("b").isNull(), "fallback").otherwise("route").alias("matched_by"))


def _requests(spark, d):
    i = F.col("event_id")
    method = F.when(i % 3 == 0, "POST").otherwise("get")
    path = F.element_at(F.array(F.lit("/api/sources"), F.concat(F.lit("/api/sources/"), F.col("user_id").cast("string")), F.concat(F.lit("/api/sources/"), F.col("user_id").cast("string"), F.lit("/ask")), F.lit("/api/sources/reorder"), F.lit("/other/a/b")), (i % 5 + 1).cast("int"))
    rules = [("GET", "/api/sources", "list", 5), ("GET", "/api/sources/:id", "one", 4), ("GET", "/api/sources/reorder", "order", 2), ("POST", "/api/sources/:id/ask", "ask", 1), ("POST", "/api/sources/:id", "write", 3)]
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"), method.alias("method"), path.alias("path"))
    return resolve_routes(e, spark.createDataFrame(rules, "method string, template string, bucket string, max_per_window int"))


def route_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).groupBy("bucket", F.col("max_per_window").cast("long").alias("max_per_window"), "matched_by").agg(F.count("*").alias("requests"))


def route_limits(spark: SparkSession, d: str) -> DataFrame:
    """Aligned windows of an hour for each user and bucket: what the bucket's limit allows."""
    n = _requests(spark, d).groupBy("user_id", "bucket", "max_per_window", F.floor(F.col("t") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return n.groupBy("bucket").agg(F.sum(F.least("n", F.col("max_per_window").cast("long"))).alias("allowed"), F.sum(F.greatest(F.col("n") - F.col("max_per_window"), F.lit(0))).cast("long").alias("denied"))


def stream_limits(events: DataFrame, seconds: int = 3600, limit: int = 3) -> DataFrame:
    """anchored_windows over a stream of (user_id, event_id, t): the open window and its count are the state of a user.

    Events of a micro-batch are taken in order of time; one that comes in a later batch than a newer one is judged as it comes.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])  # the new events of one user
        ok = []
        for t in rows["t"]:
            if opened is None or t - opened >= seconds:
                opened, n = int(t), 0
            ok.append(n < limit)
            n += n < limit
        state.update((opened, n))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": ok})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "opened long, n int", "append", GroupStateTimeout.NoTimeout)


def anchored_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    return anchored_windows(_timed(spark, d)).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def stream_counts(spark: SparkSession, path: str, schema, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """The same windows over a stream of Parquet files, with a watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events.withWatermark("ts", late), minutes)


QUERIES = {"rate_limit_windows": rate_limit_windows, "token_usage_rollup": token_usage_rollup, "session_gaps": session_gaps, "anchored_rate_windows": anchored_rate_windows, "layered_limits": layered_limit_counts, "route_resolution": route_resolution, "route_limits": route_limits}
ORACLE_SQL = {
    "rate_limit_windows": "SELECT user_id, epoch(time_bucket(INTERVAL 60 MINUTES, ts))::BIGINT AS start, count(*) AS n, least(count(*), 20) AS allowed, greatest(count(*) - 20, 0) AS denied FROM events GROUP BY 1, 2",
    "token_usage_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, sum(floor(value)::BIGINT)::BIGINT AS input_tokens, sum(coalesce(json_extract_string(props, '$.k')::BIGINT, 0))::BIGINT AS output_tokens, sum(floor(value)::BIGINT + coalesce(json_extract_string(props, '$.k')::BIGINT, 0))::BIGINT AS total_tokens FROM events GROUP BY 1, 2",
    "session_gaps": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "anchored_rate_windows": """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events),
f AS (SELECT user_id, k, t AS o, 1::BIGINT AS n, true AS ok FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t - f.o >= 3600 THEN e.t ELSE f.o END, CASE WHEN e.t - f.o >= 3600 THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE f.n END, e.t - f.o >= 3600 OR f.n < 3
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS denied FROM f GROUP BY 1""",
    "layered_limits": """WITH RECURSIVE r AS (SELECT event_id, user_id AS ip, floor(epoch(ts))::BIGINT AS t, strftime(ts, '%Y-%m-%d') AS day, event_id % 3 AS site, event_type AS origin FROM events),
ak AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t, event_id) AS k FROM r),
af AS (SELECT ip, k, event_id, t AS o, 1::BIGINT AS n, true AS ok FROM ak WHERE k = 1
  UNION ALL SELECT e.ip, e.k, e.event_id, CASE WHEN e.t - f.o >= 86400 THEN e.t ELSE f.o END, CASE WHEN e.t - f.o >= 86400 THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE f.n END, e.t - f.o >= 86400 OR f.n < 3 FROM af f JOIN ak e ON e.ip = f.ip AND e.k = f.k + 1),
a AS (SELECT p.* FROM r p JOIN af USING (event_id) WHERE ok),
bk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t, event_id) AS k FROM a),
bf AS (SELECT site, k, event_id, t AS o, 1::BIGINT AS n, true AS ok FROM bk WHERE k = 1
  UNION ALL SELECT e.site, e.k, e.event_id, CASE WHEN e.t - f.o >= 7200 THEN e.t ELSE f.o END, CASE WHEN e.t - f.o >= 7200 THEN 1 WHEN f.n < 4 THEN f.n + 1 ELSE f.n END, e.t - f.o >= 7200 OR f.n < 4 FROM bf f JOIN bk e ON e.site = f.site AND e.k = f.k + 1),
b AS (SELECT p.* FROM a p JOIN bf USING (event_id) WHERE ok),
ck AS (SELECT *, row_number() OVER (PARTITION BY site, day ORDER BY t, event_id) AS k FROM b),
cf AS (SELECT site, day, k, event_id, t AS o, 1::BIGINT AS n, true AS ok FROM ck WHERE k = 1
  UNION ALL SELECT e.site, e.day, e.k, e.event_id, CASE WHEN e.t - f.o >= 86400 THEN e.t ELSE f.o END, CASE WHEN e.t - f.o >= 86400 THEN 1 WHEN f.n < 25 THEN f.n + 1 ELSE f.n END, e.t - f.o >= 86400 OR f.n < 25 FROM cf f JOIN ck e ON e.site = f.site AND e.day = f.day AND e.k = f.k + 1),
c AS (SELECT p.* FROM b p JOIN cf USING (event_id) WHERE ok),
gk AS (SELECT *, row_number() OVER (PARTITION BY site, origin ORDER BY t, event_id) AS k FROM c),
gf AS (SELECT site, origin, k, event_id, t AS o, 1::BIGINT AS n, true AS ok FROM gk WHERE k = 1
  UNION ALL SELECT e.site, e.origin, e.k, e.event_id, CASE WHEN e.t - f.o >= 86400 THEN e.t ELSE f.o END, CASE WHEN e.t - f.o >= 86400 THEN 1 WHEN f.n < 5 THEN f.n + 1 ELSE f.n END, e.t - f.o >= 86400 OR f.n < 5 FROM gf f JOIN gk e ON e.site = f.site AND e.origin = f.origin AND e.k = f.k + 1),
g AS (SELECT p.* FROM c p JOIN gf USING (event_id) WHERE ok)
SELECT CASE WHEN g.event_id IS NOT NULL THEN NULL WHEN c.event_id IS NOT NULL THEN 'site_origin' WHEN b.event_id IS NOT NULL THEN 'site_day' WHEN a.event_id IS NOT NULL THEN 'site' ELSE 'ip' END AS denied_by, count(*) AS requests, sum(r.event_id)::BIGINT AS id_sum
FROM r LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN g USING (event_id) GROUP BY 1""",
    "route_resolution": """WITH r AS (SELECT event_id, user_id AS u, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS m, event_id % 5 AS p FROM events),
b AS (SELECT *, CASE WHEN p = 4 THEN NULL WHEN m = 'GET' THEN ['list', 'one', NULL, 'order'][p + 1] ELSE [NULL, 'write', 'ask', 'write'][p + 1] END AS k FROM r),
q AS (SELECT *, coalesce(k, CASE m WHEN 'GET' THEN 'fallback_read' ELSE 'fallback_write' END) AS bucket, CASE coalesce(k, m) WHEN 'list' THEN 5 WHEN 'one' THEN 4 WHEN 'order' THEN 2 WHEN 'ask' THEN 1 WHEN 'write' THEN 3 WHEN 'GET' THEN 120 ELSE 60 END AS max_per_window FROM b) SELECT bucket, max_per_window, CASE WHEN k IS NULL THEN 'fallback' ELSE 'route' END AS matched_by, count(*) AS requests FROM q GROUP BY 1, 2, 3""",
    "route_limits": """WITH r AS (SELECT event_id, user_id AS u, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS m, event_id % 5 AS p FROM events),
b AS (SELECT *, CASE WHEN p = 4 THEN NULL WHEN m = 'GET' THEN ['list', 'one', NULL, 'order'][p + 1] ELSE [NULL, 'write', 'ask', 'write'][p + 1] END AS k FROM r),
q AS (SELECT *, coalesce(k, CASE m WHEN 'GET' THEN 'fallback_read' ELSE 'fallback_write' END) AS bucket, CASE coalesce(k, m) WHEN 'list' THEN 5 WHEN 'one' THEN 4 WHEN 'order' THEN 2 WHEN 'ask' THEN 1 WHEN 'write' THEN 3 WHEN 'GET' THEN 120 ELSE 60 END AS max_per_window FROM b), n AS (SELECT u, bucket, max_per_window AS x, t // 3600 AS h, count(*) AS n FROM q GROUP BY 1, 2, 3, 4) SELECT bucket, sum(least(n, x))::BIGINT AS allowed, sum(greatest(n - x, 0))::BIGINT AS denied FROM n GROUP BY 1""",
}
