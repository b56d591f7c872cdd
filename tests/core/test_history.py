import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators import history as H

DAY = datetime(2024, 1, 1)


def test_as_of_with_hot_and_empty_records(spark):
    rng = random.Random(3)
    when = lambda: DAY + timedelta(hours=rng.randrange(24 * 200))
    versions = {(k, when()): f"v{i}" for i, k in enumerate(rng.choices([1, 1, 1, 2, 3], k=120))}
    events = [(i, k, when()) for i, k in enumerate(rng.choices([1, 1, 1, 2, 9], k=600))] + [(600 + i, k, t) for i, (k, t) in enumerate(versions)]
    e = spark.createDataFrame(events, "id long, k long, t timestamp").repartition(3)
    v = spark.createDataFrame([(k, t, x) for (k, t), x in versions.items()], "k long, since timestamp, title string")

    def want(k, t):
        return max(((s, x) for (kk, s), x in versions.items() if kk == k and s <= t), default=(None, None))[1]

    for bucket in (3600, 30 * 86400, 10**9):
        got = H.as_of(e, v, ["k"], "t", "since", ["title"], bucket)
        assert sorted(map(tuple, got.select("id", "k", "title").collect())) == sorted((i, k, want(k, t)) for i, k, t in events)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert H.as_of(e.limit(0), v, ["k"], "t", "since", ["title"]).count() == 0
    assert {r.title for r in H.as_of(e, v.limit(0), ["k"], "t", "since", ["title"]).collect()} == {None}


def test_validity(spark):
    v = spark.createDataFrame([(1, DAY, "a"), (1, DAY + timedelta(1), "b"), (2, DAY, "c")], "k long, since timestamp, x string")
    assert {r.x: r.valid_to for r in H.validity(v, ["k"], "since").collect()} == {"a": DAY + timedelta(1), "b": None, "c": None}


def test_top_rows_are_cut_before_the_shuffle(ws):
    rows = H.top_rows(ws.notes, ["related_entity_type"], F.desc("id"), size=2)
    assert sorted((r.related_entity_type, r.id, r.place) for r in rows.collect() if r.related_entity_type == "document") == [("document", 2, 1)]
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2  # one before the exchange
    assert [r.id for r in H.newest_notes(ws.notes).orderBy("id").collect()] == [1, 2, 5]


def test_running_figures(spark):
    rows = spark.createDataFrame([(DAY + timedelta(d), s) for d, s in ((0, "open"), (0, "open"), (0, "x"), (3, None), (8, "open"), (20, "open"))] + [(None, "open")], "created_at timestamp, status string")
    got = [(r.day.day, r.n, r.total, r.recent) for r in H.open_over_time(rows, 9).orderBy("day").collect()]
    assert got == [(1, 2, 2, 2), (4, 0, 2, 2), (9, 1, 3, 3), (21, 1, 4, 1)]
