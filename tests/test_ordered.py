"""Global orders against sorting."""

import random

from pyspark.sql import functions as F

from textmill.operators import ordered


def test_ranked_by_two_columns(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0.24, 0.26, 0.5, 0.5, 0.5, r.random()]), r.choice([-1.0, -300000.0, -r.random() * 1e9])) for i in range(3000)]
    got = ordered.ranked(spark.createDataFrame(rows, "id int, s double, p double"), "s", ["p", "id"]).collect()
    want = {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[2], x[0])), 1)}
    assert {x.id: x.place for x in got} == want


def test_a_frequent_value_is_split(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias("s"), (F.col("id") * 7919 % 5000).cast("double").alias("p"))
    assert ordered.ranged(df, "s", 50, "p").select("_range").distinct().count() > 30
    assert ordered.ranked(df, "s", ["p"]).where("place <> p + 1").isEmpty()
    assert ordered.ranked(df.where("id < 0"), "s", ["p"]).collect() == []
