"""Skew-proof ordering operators against the plain window."""

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finlake.operators.ordered import exact_median, exact_quantiles, global_ntile, with_next
from finlake.operators.skew import attach


@pytest.fixture(scope="module")
def skewed(spark):
    """Account 0 holds a third of the rows, one value repeats often, some values are null."""
    n = 3000
    return spark.range(n, numPartitions=6).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("acct"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 4 == 0, 7.0).otherwise((F.col("id") * 37 % 1009).cast("double") / 10 - 20).alias("v"),
        (F.col("id") * 7919 % 200000).alias("sec"),
    )


@pytest.mark.parametrize("k", [1, 7, 20, 100])
def test_global_ntile_equals_ntile(skewed, k):
    w = Window.orderBy("v", "id")
    want = skewed.select("id", F.ntile(k).over(w).alias("want"))
    got = global_ntile(skewed, k, ("v", "id"), name="got")
    assert got.count() == 3000
    assert got.join(want, "id").where("got <> want").count() == 0


def test_ntile_by_group_and_small_groups(skewed):
    w = Window.partitionBy("acct").orderBy("v", "id")
    want = skewed.select("id", F.ntile(100).over(w).alias("want"))
    got = global_ntile(skewed, 100, ("v", "id"), by=("acct",), name="got")
    assert got.join(want, "id").where("got <> want").count() == 0


def test_ntile_fewer_rows_than_buckets(spark):
    df = spark.range(3).withColumn("v", F.col("id") * 1.0)
    assert sorted(r["b"] for r in global_ntile(df, 5, ("v",), name="b").collect()) == [1, 2, 3]


def test_ntile_is_not_one_task(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = global_ntile(skewed, 20, ("v", "id"))
        sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 1500


def test_median_and_quantiles(skewed):
    rows = skewed.where("v is not null").select("acct", "v").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["acct"], []).append(r["v"])
    got = {r["acct"]: (r["m"], r["n"]) for r in exact_median(skewed, ["acct"], "v", "m").collect()}
    assert got == {k: (pytest.approx(statistics.median(v)), len(v)) for k, v in groups.items()}
    quart = {(r["acct"], r["prob"]): r["quantile"] for r in exact_quantiles(skewed, ["acct"], "v", (0.0, 0.25, 1.0)).collect()}
    for k, v in groups.items():
        v = sorted(v)
        at = (len(v) - 1) * 0.25
        lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
        assert quart[(k, 0.25)] == pytest.approx(lo + (hi - lo) * (at - int(at)))
        assert (quart[(k, 0.0)], quart[(k, 1.0)]) == (v[0], v[-1])


def _next_by_window(df, horizon):
    w = Window.partitionBy("acct").orderBy("sec", "id")
    return df.select("id", F.lead("id").over(w).alias("n"), F.lead("sec").over(w).alias("ns"), "sec").where(
        F.col("ns") - F.col("sec") <= horizon)


@pytest.mark.parametrize("slice_seconds", [1, 60, 7200])
@pytest.mark.parametrize("modulus", [200000, 5000])
def test_with_next_equals_lead(skewed, slice_seconds, modulus):
    """A small modulus gives many ties."""
    df = skewed.withColumn("sec", F.col("sec") % modulus)
    got = with_next(df, "acct", "sec", "id", ("id", "sec"), horizon=10800, slice_seconds=slice_seconds)
    got = got.select("id", F.col("next.id").alias("got"), F.col("next.sec").alias("gs"), "sec")
    assert got.count() == 3000
    near = got.where(F.col("gs") - F.col("sec") <= 10800)
    want = _next_by_window(df, 10800)
    assert near.count() == want.count() > 1000
    assert near.join(want.select("id", "n"), "id").where("got <> n").count() == 0


def test_attach_equals_join(spark, skewed):
    totals = skewed.groupBy("acct").agg(F.sum("id").alias("t"))
    plain = skewed.join(totals, "acct").select("id", "t")
    got = attach(skewed, totals, ["acct"]).select("id", "t")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_attach_left_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    look = spark.createDataFrame([("a", 5), (None, 6)], "k string, x int")
    got = {r["id"]: r["x"] for r in attach(rows, look, ["k"], how="left").collect()}
    assert got == {1: 5, 2: None, 3: None}


def test_quantiles_of_a_narrow_range_are_spread(spark):
    """Epoch seconds differ little from each other in size; their slices stay even."""
    df = spark.range(60_000).selectExpr("'k' as k", "1700000000 + id as v")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["k"], "v", (0.25, 0.5)).collect()}
    assert got == {0.25: 1700000000 + 14999.75, 0.5: 1700000000 + 29999.5}
    slices = df.repartitionByRange(8, "k", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert slices < 60_000 / 4
