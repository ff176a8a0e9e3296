"""Layered rate limits over a stream, with state that expires.

Each micro-batch is judged by ``judge`` and committed whole to a store: verdicts, open windows and progress. A batch that runs again after a
failure is known by its number and changes nothing, so verdicts are exactly once. A window is kept while a request may still fall into
it: until the newest time seen is ``late`` seconds beyond its end. Times decide, not clocks, so a stream and a batch over the same requests
agree where no batch has requests older than those before it. An older request counts in the window that is open for its key, and one
whose window has expired opens its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Change, Store
from ..sources.tables import checkpointed, shared_dir
from .limits import LAYERS, ORACLE_SQL as _BATCH_SQL, _timed

WINDOWS = "layer string, key string, opened long, n int"


def _fold(rows: DataFrame, seconds: int, limit: int) -> DataFrame:
    """key, t, event_id, held -> these with allowed, and a row without event_id for the last window of each key.

    ``held`` is the count of a window that was open before and begins at t; such rows come first. Requests without a time are one window.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, n = None, None, 0

        def window() -> list:
            return [(last, opened, None, n, None)] if last is not None and opened is not None else []

        for batch in batches:
            out: list[tuple] = []
            for key, t, event, held in zip(batch["key"], batch["t"], batch["event_id"], batch["held"]):
                t = None if pd.isna(t) else int(t)
                if key != last:
                    out += window()
                    last, opened, n = key, None, 0
                if not pd.isna(held):
                    opened, n = t, int(held)
                    continue
                if t is not None and (opened is None or t - opened >= seconds):
                    opened, n = t, 0
                out.append((key, t, event, None, n < limit))
                n += n < limit
            yield _frame(out)
        yield _frame(window())

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "t", "event_id", "held", "allowed"], dtype=object)
        return out.astype({"t": "Int64", "held": "Int64"})

    kind = rows.schema["event_id"].dataType.simpleString()
    ordered = rows.select("key", "t", "event_id", "held").repartition("key").sortWithinPartitions("key", F.col("held").isNull(), "t", "event_id")
    return ordered.mapInPandas(fold, f"key string, t long, event_id {kind}, held long, allowed boolean")


def judge(store: Store, requests: DataFrame, batch: int, layers=LAYERS, late: int = 0) -> Store:
    """Judges a batch of requests (event_id, t and the layers' columns; ids unique) and commits it: tables verdicts, windows, progress."""
    progress = store.table("progress")
    done = None if progress is None else progress.first()
    if done and batch <= done["batch"]:
        return store
    held = store.table("windows")
    # Ids may be of any type; they go through the folds as texts.
    rows = checkpointed(requests.withColumn("_id", F.col("event_id").cast("string")))
    newest = rows.agg(F.max("t")).first()[0]
    newest = max((x for x in (newest, done and done["newest"]) if x is not None), default=None)
    left, denied, open_ = rows, None, None
    for name, keys, seconds, limit in layers:
        key = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys])
        asked = left.select(key.alias("key"), "t", F.col("_id").alias("event_id"), F.lit(None).cast("int").alias("held"))
        before = None if held is None else held.filter(F.col("layer") == name)
        if before is not None:
            asked = asked.unionByName(before.select("key", F.col("opened").alias("t"), F.lit(None).cast("string").alias("event_id"), F.col("n").alias("held")))
        judged = checkpointed(_fold(asked, seconds, limit))
        no = judged.filter("event_id is not null and not allowed").select(F.col("event_id").alias("_id"), F.lit(name).alias("denied_by"))
        denied = no if denied is None else denied.unionByName(no)
        left = left.join(no, "_id", "left_anti")
        still = judged.filter("event_id is null").filter(F.col("t") + seconds + late > F.lit(newest).cast("long"))
        mine = still.select(F.lit(name).alias("layer"), "key", F.col("t").alias("opened"), F.col("held").cast("int").alias("n"), F.lit(f"l{name}").alias("part"))
        open_ = mine if open_ is None else open_.unionByName(mine)
    verdicts = rows.join(denied, "_id", "left").select("event_id", "denied_by", F.lit(f"b{batch}").alias("part"))
    state = store.spark.createDataFrame([(batch, newest, "all")], "batch long, newest long, part string")
    old = list(store.parts.get("windows", {}))
    return store.commit({"verdicts": Change(verdicts), "windows": Change(open_, drop=old), "progress": Change(state, drop=["all"])})


def stream_layered_limits(requests: DataFrame, root: str, checkpoint: str, layers=LAYERS, late: int = 0, **trigger) -> StreamingQuery:
    """Starts the limits over a stream of requests. Verdicts are read from the store at ``root``."""

    def each(batch: DataFrame, number: int) -> None:
        judge(Store(batch.sparkSession, root), batch, number, layers, late)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def layered_limits_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The events of ``layered_limits`` in three batches by time, the second one given twice."""
    e = _timed(spark, d).withColumnRenamed("user_id", "ip").withColumn("site", F.col("event_id") % 3).withColumn("origin", F.col("event_type"))
    layers = (("ip", ["ip"], 86_400, 3), ("site", ["site"], 7_200, 4), ("site_day", ["site", "day"], 86_400, 25), ("site_origin", ["site", "origin"], 86_400, 5))
    first, last = e.agg(F.min("t"), F.max("t")).first()
    store = Store(spark, f"{shared_dir(spark)}/limits-{uuid.uuid4().hex}")
    if first is not None:
        step = (last - first) // 3 + 1
        for n in (0, 1, 1, 2):
            judge(store, e.filter(F.floor((F.col("t") - first) / step) == n), n, layers)
    verdicts = store.table("verdicts") if first is not None else e.select("event_id", F.lit(None).cast("string").alias("denied_by"))
    return verdicts.groupBy("denied_by").agg(F.count("*").alias("requests"), F.sum("event_id").alias("id_sum"))


QUERIES = {"layered_limits_resumed": layered_limits_resumed}
ORACLE_SQL = {"layered_limits_resumed": _BATCH_SQL["layered_limits"]}
