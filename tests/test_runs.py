"""Layered limits as a stream with expiring state, and runs that are cancelled."""

import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.plans.runs import Cancelled, Runs
from lodestone.sources.store import Store
from lodestone.streaming import layered, limits

SCHEMA = "event_id long, t long, day string, ip string, site string, origin string"
LAYERS = (("ip", ["ip"], 60, 2), ("site", ["site", "day"], 300, 5), ("origin", ["origin"], 40, 1))


def requests(seed, n, start, span):
    r = random.Random(seed)
    times = sorted(r.randrange(start, start + span) for _ in range(n))
    return [(start * 1000 + i, t, f"d{t // 500}", r.choice("abc") if r.random() < 0.9 else None, r.choice("xy"), r.choice("pqr")) for i, t in enumerate(times)]


@pytest.fixture
def home(spark):
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/run-{uuid.uuid4().hex}"


def test_stream_equals_batch_and_restarts(spark, home):
    batches = [requests(1, 40, 0, 200), requests(2, 30, 200, 300), requests(3, 1, 100_000, 5)]
    source, every = f"{home}/source", [x for b in batches for x in b]
    store = lambda: Store(spark, f"{home}/limits")

    def more(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        layered.stream_layered_limits(stream, f"{home}/limits", f"{home}/checkpoint", LAYERS, late=20, availableNow=True).awaitTermination()

    more(batches[0])
    held = store().table("windows").count()
    more(batches[1])  # a new query from the same checkpoint
    more(batches[2])
    got = {r["event_id"]: r["denied_by"] for r in store().table("verdicts").collect()}
    want = {r["event_id"]: r["denied_by"] for r in limits.layered_limits(spark.createDataFrame(every, SCHEMA), LAYERS).collect()}
    assert got == want and len({v for v in want.values()}) == 4 and store().table("verdicts").count() == len(every)
    left = store().table("windows")
    assert held > left.count() > 0 and left.filter("opened < 100000").count() == 0
    before = store().version
    layered.judge(store(), spark.createDataFrame(batches[1], SCHEMA), 1, LAYERS)  # a batch that runs again
    assert store().version == before


def test_late_and_timeless_requests(spark, home):
    store = Store(spark, home)
    row = lambda i, t: (i, t, "d", "a", "s", "o")
    layers = (("ip", ["ip"], 60, 2),)
    layered.judge(store, spark.createDataFrame([row(1, 100), row(2, None), row(3, None), row(4, None)], SCHEMA), 0, layers, late=1000)
    layered.judge(store, spark.createDataFrame([row(5, 90), row(6, 101), row(7, 160)], SCHEMA), 1, layers, late=1000)
    layered.judge(store, spark.createDataFrame([], SCHEMA), 2, layers, late=1000)
    denied = {r["event_id"]: r["denied_by"] for r in store.table("verdicts").collect()}
    assert denied == {1: None, 2: None, 3: None, 4: "ip", 5: None, 6: "ip", 7: None}


def test_cancel_one_run_while_another_goes_on(spark, home):
    runs, out = Runs(spark), {}
    slow = lambda n: spark.range(4).repartition(4).mapInPandas(_sleeper(n), "id long")

    def work(run, seconds):
        try:
            with runs.running(run):
                out[run] = slow(seconds).count()
        except Cancelled:
            out[run] = "cancelled"

    threads = [threading.Thread(target=work, args=("a", 60)), threading.Thread(target=work, args=("b", 2))]
    for t in threads:
        t.start()
    began = time.time()
    while runs.states.get("a") != "running" or not spark.sparkContext.statusTracker().getActiveStageIds():
        time.sleep(0.1)
    time.sleep(1)
    assert runs.cancel("a")
    for t in threads:
        t.join(50)
    assert out == {"a": "cancelled", "b": 4} and runs.states == {"a": "cancelled", "b": "done"} and time.time() - began < 50
    assert not runs.cancel("a") and not runs.cancel("b")


def _sleeper(seconds):
    def f(batches):
        import time

        for b in batches:
            for _ in range(seconds * 10):
                time.sleep(0.1)
            yield b

    return f


def test_states_of_runs(spark, home):
    runs = Runs(spark)
    with pytest.raises(ZeroDivisionError), runs.running("x"):
        1 / 0
    assert runs.states["x"] == "failed"
    with pytest.raises(ValueError), runs.running("x"):
        pass
    assert runs.cancel("later")
    with pytest.raises(Cancelled), runs.running("later"):
        raise AssertionError("must not begin")
    with pytest.raises(Cancelled), runs.running("steps"):
        runs.cancel("steps")
        runs.check("steps")
        raise AssertionError("must not go on")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{home}/in")
    with pytest.raises(Cancelled), runs.running("stream"):
        query = runs.stream("stream", layered.stream_layered_limits(spark.readStream.schema(SCHEMA).parquet(f"{home}/in"), f"{home}/limits", f"{home}/cp", LAYERS))
        assert query.isActive
        runs.cancel("stream")
    assert not query.isActive and runs.states["stream"] == "cancelled"
