import numpy as np
from pyspark.sql import functions as F

from ticketloom.llm import id_filter


def test_both_tests_agree_and_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(id_filter, "LEAST_BITS", 1 << 15)
    keys = spark.range(0, 3_000, 7).withColumnRenamed("id", "k")
    made = id_filter.KeyFilter(keys, "k", keys.count())
    rows = spark.range(0, 3_000).select(F.col("id").alias("k"), F.lit("x").alias("v")).union(spark.sql("SELECT CAST(NULL AS LONG), 'n'"))
    likely, others = made.split(rows, "k")
    assert likely.columns == rows.columns
    hit = {r["k"] for r in likely.collect()}
    assert set(range(0, 3_000, 7)) <= hit and len(hit) < 600
    assert sorted((r["k"] for r in others.collect()), key=repr) == sorted([k for k in range(3_000) if k not in hit] + [None], key=repr)
    places = rows.where("k IS NOT NULL").orderBy("k").select(made.place("k").alias("p")).toPandas()["p"].to_numpy()
    assert set(id_filter.hits(made.sent().value, places).tolist()) == hit


def test_without(spark):
    keys = spark.createDataFrame([(1,), (5,)], "k long")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (5, "d")], "k long, v string")
    got = sorted(map(tuple, id_filter.without(rows, "k", keys).collect()), key=repr)
    assert got == sorted([(2, "b"), (2, "b"), (None, "c")], key=repr)
    assert id_filter.without(rows, "k", keys.where("k > 9")).count() == 5


def test_columns_of_any_names(spark):
    names = ["k", "_bucket", "_bits", "x.y", "_key", "_row", "bit"]
    rows = [(i, *(f"{n}{i}" for n in names[1:])) for i in range(20)] + [(None, *names[1:])]
    df = spark.createDataFrame(rows, ["k", *names[1:]]).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    keys = spark.createDataFrame([(3,), (4,)], "k long")
    out = id_filter.without(df, "k", keys)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    want = [r for r in rows if r[0] not in (3, 4)]
    assert sorted((tuple(r)[:-1] for r in out.collect()), key=repr) == sorted(want, key=repr)
    made = id_filter.KeyFilter(keys, "k", 2)
    likely, others = made.split(df, "k")
    assert likely.columns == others.columns == df.columns and likely.count() + others.count() == 21
