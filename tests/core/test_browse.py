import random

from pyspark.sql import functions as F

from quillspark.operators import browse


def test_places_in_an_order(spark):
    rng = random.Random(4)
    values = [(i, rng.choice([None, *range(8)])) for i in range(3000)]  # few values: many rows of one sort before the id decides
    rows = spark.createDataFrame(values, "id long, v int").repartition(5)
    want = {i: k for k, (i, v) in enumerate(sorted(values, key=lambda x: (x[1] is not None, -(x[1] or 0), x[0])), 1)}
    for n in (None, 1, 7, 40):
        got = browse.places(rows, F.col("v").desc_nulls_first(), F.col("id"), partitions=n)
        assert {r.id: r.place for r in got.collect()} == want and got.columns == ["id", "v", "place"]
        assert {r.id: r.place for r in got.collect()} == want  # the same again
    assert browse.places(rows.limit(0), F.col("id")).count() == 0


def test_places_are_not_found_in_one_task(spark):
    plan = browse.places(spark.range(100), F.col("id"), partitions=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # only the sizes of the ranges come together
    assert text.count("SinglePartition") == 1 and "BroadcastHashJoin" in text
