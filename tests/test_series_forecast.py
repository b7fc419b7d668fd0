"""Series, features, folds, segments."""

import datetime
from pathlib import Path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from finlake import session
from finlake.functions.bands import age_group, util_band, wealth_tier
from finlake.functions.numeric import portable_round
from finlake.operators import boosting
from finlake.operators import forecast as T
from finlake.operators import fraud
from finlake.operators import medallion as M
from finlake.operators import segments as S
from finlake.operators import series as P
from finlake.plans.tables import billing
from tests.oracle import SF_DIR

D = datetime.date


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (-2.5,), (0.125,), (None,), (2e17,), (-2e300,)], "x double")
    assert [r[0] for r in df.select(portable_round("x")).collect()] == [1.01, -2.5, 0.13, None, 2e17, -2e300]


def test_sums_keep_all_digits(spark):
    small = spark.range(1000).select(F.lit("T").alias("transaction_type"), F.lit(0.004).alias("amount"), F.lit(0).alias("is_fraud"))
    out = fraud.fraud_rate(small).collect()[0]
    assert out["avg_transaction_amount"] == 0.0
    prices = spark.range(1000).select(F.lit("Gold").alias("metal"), F.lit(D(2020, 1, 1)).alias("date"), F.lit(0.004).alias("price"))
    assert P.to_monthly(prices).first()["price"] == pytest.approx(0.004, rel=1e-12)
    lines = spark.range(1000).select(
        F.lit("c").alias("Customer Name"), F.lit(D(2020, 1, 1)).alias("Worked Date"), F.lit(2e17).alias("Extended Price"),
        F.lit(0.004).alias("Billable Hours"), F.lit(0.001).alias("Hourly Billing Rate"), F.lit("p").alias("Project"))
    row = T.monthly_features(lines).first()
    assert row["revenue_sum"] == pytest.approx(2e20) and row["hours_sum"] == pytest.approx(4.0)
    assert row["billingrate_mean"] == pytest.approx(0.001, rel=1e-12)


def test_bands_null_and_edges(spark):
    df = spark.createDataFrame([(500000.0, 30, 0.25), (499999.99, 29, 0.2499), (None, None, None)], "w double, a int, u double")
    rows = df.select(wealth_tier("w").alias("w"), age_group("a").alias("a"), util_band("u").alias("u")).collect()
    assert [tuple(r) for r in rows] == [
        ("Ultra High Net Worth", "30s", "25-49 %"), ("High Net Worth", "Under 30", "<25 %"), ("Low Wealth", "60+", "75 %+")]


def test_silver_edges(spark):
    base = dict.fromkeys(("EmergingMarketFund", "RealEstate", "PrivateEquity", "GovtBonds", "CorpBonds", "ETF Tech", "ETF Health", "ETF Med"), 1)
    rows = [{**base, "CustomerID": 1, "RowNumber": 1, "Age": 40, "EstimatedSalary": 10.0, "CreditScore": 700, "Debt": 0.0, "Net Assets": 10000.0},
            {**base, "CustomerID": 2, "RowNumber": 2, "Age": 40, "EstimatedSalary": 10.0, "CreditScore": 700, "Debt": 4.0, "Net Assets": 1.0, "ETF Med": None},
            {**base, "CustomerID": 3, "RowNumber": 3, "Age": None, "EstimatedSalary": 10.0, "CreditScore": 700, "Debt": 4.0, "Net Assets": 1.0}]
    schema = "CustomerID int, RowNumber int, Age int, EstimatedSalary double, CreditScore int, Debt double, `Net Assets` double, " + ", ".join(f"`{b}` int" for b in base)
    out = M.silver(spark.createDataFrame([tuple(r.get(c.strip("`"), None) for c in ("CustomerID", "RowNumber", "Age", "EstimatedSalary", "CreditScore", "Debt", "Net Assets", *base)) for r in rows], schema))
    got = {r["CustomerID"]: r for r in out.collect()}
    assert set(got) == {1, 2} and "RowNumber" not in out.columns
    assert got[1]["SalaryToDebtRatio"] is None and got[1]["InvestmentCount"] == 8 and got[1]["WealthTier"] == "Mass Market"
    assert got[2]["SalaryToDebtRatio"] == 2.5 and got[2]["InvestmentCount"] is None


def test_cards_zero_limit_and_segments(spark):
    rows = [(f"c{i:02d}", float(i), 0.0, 0.0, 0.0 if i == 0 else 100.0, 12, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "cust_id string, balance double, purchases double, cash_advance double, credit_limit double, tenure int, prc_full_payment double")
    cards = S.card_enriched(df)
    assert cards.where("cust_id = 'c00'").first()["util_ratio"] is None
    seg = {r["segment"]: (r["customers"], r["avg_profit"]) for r in S.extreme_segments(cards).collect()}
    assert seg == {"Bottom 5 %": (2, 0.4), "Top 5 %": (2, 30.8)}


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(D(2020, 1, 1), 10.0, "Gold"), (D(2020, 1, 31), 20.0, "Gold"), (D(2020, 3, 1), 30.0, "Gold"), (D(2021, 1, 1), 30.0, "Gold"),
            (D(2020, 1, 5), 5.0, "Silver"), (D(2020, 2, 5), 0.0, "Silver"), (D(2020, 3, 9), 10.0, "Silver")]
    return spark.createDataFrame(rows, "date date, price double, metal string")


def test_ratio_alignment(prices):
    got = {r["month"]: (r["gold"], r["silver"], r["ratio"]) for r in P.price_ratio(prices).collect()}
    assert got == {D(2020, 1, 1): (15.0, 5.0, 3.0), D(2020, 2, 1): (None, 0.0, None), D(2020, 3, 1): (30.0, 10.0, 3.0), D(2021, 1, 1): (30.0, None, None)}
    assert [r["month"] for r in P.extreme_ratios(prices, 1).collect()] == [D(2020, 1, 1)]


def test_topn_ties(spark):
    df = spark.createDataFrame([("G", 1, 5.0), ("G", 2, 5.0), ("G", 3, 1.0)], "metal string, year int, avg_price double")
    assert P.topn_periods(df, 1).where("side = 'best'").count() == 2
    assert P.topn_periods(df, 1, ties=False).where("side = 'best'").count() == 1


def test_feed_priority_and_coverage(spark, prices):
    late = spark.createDataFrame([(D(2020, 1, 1), 99.0), (D(2020, 4, 1), 7.0)], "date date, price double")
    merged = P.merge_feeds([(prices.where("metal = 'Gold'"), "Gold", 1), (late, "Gold", 2)])
    got = {r["month"]: r["price"] for r in merged.collect()}
    assert got[D(2020, 1, 1)] == 99.0 and got[D(2020, 3, 1)] == 30.0 and got[D(2020, 4, 1)] == 7.0
    cover = {r["metal"]: (r["months_present"], r["months_missing"]) for r in P.series_coverage(prices).collect()}
    assert cover == {"Gold": (3, 10), "Silver": (3, 10)}
    assert P.missing_months(prices).where("metal = 'Gold'").count() == 10


LINES = "`Worked Date` string, ` Customer Name` string, Project string, `Extended Price ` double, `Billable Hours` double, `Hourly Billing Rate` double"


def _bills(spark, months, customer="A"):
    return [(f"15/{m:02d}/2020", customer, None, 100.0 * m, 1.0, 50.0) for m in months]


def test_features_and_lags(spark):
    rows = _bills(spark, [1, 2, 3, 5, 6]) + [("16/01/2020", "A", "P", 50.0, None, None), ("bad", "A", "P", 1.0, 1.0, 1.0), ("01/01/2020", None, "P", 1.0, 1.0, 1.0)]
    f = T.monthly_features(T.billing_clean(spark.createDataFrame(rows, LINES)))
    jan = f.where("month = 1").first()
    assert (jan["revenue_sum"], jan["revenue_mean"], jan["hours_sum"], jan["project_count"], jan["quarter"]) == (150.0, 75.0, 1.0, 2, 1)
    assert jan["revenue_std"] == pytest.approx(35.35533905932738) and f.where("month = 2").first()["revenue_std"] == 0.0
    lags = {r["month"]: (r["revenue_lag_1"], r["revenue_lag_2"], r["revenue_lag_3"]) for r in T.add_lags(f).collect()}
    assert lags == {5: (300.0, 200.0, 150.0), 6: (500.0, 300.0, 200.0)}
    assert T.add_lags(f, calendar=True).count() == 0
    nxt = T.next_month_features(T.add_lags(f)).first()
    assert (nxt["year_month"], nxt["revenue_lag_1"], nxt["revenue_lag_2"], nxt["revenue_lag_3"], nxt["month"]) == (D(2020, 7, 1), 600.0, 500.0, 300.0, 7)


def test_split_and_folds(spark):
    rows = [r for c in "AB" for r in _bills(spark, range(1, 13), c)]
    f = T.monthly_features(T.billing_clean(spark.createDataFrame(rows, LINES))).cache()
    train, test = T.chrono_split(f)
    assert sorted({r["month"] for r in test.collect()}) == [11, 12] and train.count() == 20
    folds = T.expanding_folds(f, 3)
    spans = [(a.agg(F.max("month")).first()[0], b.agg(F.min("month"), F.max("month")).first()) for a, b in folds]
    assert [(hi, lo, last) for hi, (lo, last) in spans] == [(3, 4, 6), (6, 7, 9), (9, 10, 12)]
    with pytest.raises(ValueError, match="folds"):
        T.expanding_folds(f.where("month < 3"), 3)


def test_model_learns_and_forecasts(spark):
    rows = [r for c in "ABCDEF" for r in _bills(spark, range(1, 13), c)]
    f = T.add_lags(T.monthly_features(T.billing_clean(spark.createDataFrame(rows, LINES)))).cache()
    model = T.fit_revenue(f, n_estimators=5)
    s = T.score_forecast(T.predict(model, f)).first()
    assert s["r2"] > 0.9 and s["n"] == f.count()
    one = T.forecast_next(f, model, "A").collect()
    assert len(one) == 1 and one[0]["label"] == "January 2021"
    assert T.forecast_next(f, model, "nobody").count() == 0


def test_score_formula(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "revenue_sum double, prediction double")
    s = T.score_forecast(df).first()
    assert (s["rmse"], s["r2"]) == (pytest.approx(0.5**0.5), 0.5)


def test_best_grid_point_is_refitted(spark):
    months = [(f"15/{m:02d}/{y}", c, "P", 100.0 * m + i, 1.0, 50.0) for y in (2019, 2020) for m in range(1, 13)
              for i, c in enumerate("ABC")]
    f = T.add_lags(T.monthly_features(T.billing_clean(spark.createDataFrame(months, LINES)))).cache()
    model, scores = T.fit_best(f, {"n_estimators": (2, 4), "max_depth": (2,), "learning_rate": (0.1,)}, folds=2)
    best = scores.first()
    assert scores.count() == 2 and model.getNumTrees == best["n_estimators"] and best["rmse"] > 0


def test_models_grown_side_by_side(spark, monkeypatch):
    rows = spark.range(600).select(
        F.pmod(F.xxhash64("id"), F.lit(20)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).cast("double").alias("b"),
        (F.col("id") % 3).cast("int").alias("part"))
    rows = rows.withColumn("y", F.col("a") * F.col("a") - 7 * F.col("b")).cache()
    shapes = [(0, 2, 0.1), (1, 3, 0.05), (1, 1, 0.1)]
    waves = []
    splits = boosting._splits
    monkeypatch.setattr(boosting, "_splits", lambda *a: waves.append(1) or splits(*a))
    models = boosting.fit(rows, ["a", "b"], "y", 7, shapes, F.col("part"))
    # One job for a level of all models: seven trees of three levels.
    assert len(waves) == 21 and [m.getNumTrees for m in models] == [7, 7, 7]
    got = {(r["model"], r["size"]): r["mse"]
           for r in boosting.losses(models, [2, 7], rows, ["a", "b"], "y", F.col("part")).collect()}
    for i, (limit, depth, step) in enumerate(shapes):
        alone = GBTRegressor(featuresCol="f", labelCol="y", maxIter=7, maxDepth=depth, stepSize=step).fit(
            VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows.where(F.col("part") <= limit)))
        theirs = alone.evaluateEachIteration(
            VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows.where(F.col("part") == limit + 1)), "squared")
        assert [got[i, 2], got[i, 7]] == [pytest.approx(theirs[n - 1], rel=1e-6) for n in (2, 7)]


def test_dates_are_read_once(spark):
    rows = [("15/01/2020", "A", "P", 100.0, 1.0, 50.0), ("31/02/2020", "A", "P", 100.0, 1.0, 50.0), (None, "A", "P", 1.0, 1.0, 1.0)]
    out = T.billing_clean(spark.createDataFrame(rows, LINES))
    assert [r["Worked Date"] for r in out.collect()] == [D(2020, 1, 15)]
    plan = T.monthly_features(out)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]


def test_rows_of_equal_bins_are_stored_once(spark):
    rows = spark.range(3000).select(
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("double").alias(f"f{i}") for i in range(14)],
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("part"), (F.col("id") % 97).cast("double").alias("y"))
    rows = rows.localCheckpoint()
    copies = rows.crossJoin(spark.range(20)).drop("id")
    names = [f"f{i}" for i in range(14)]
    cuts = boosting._cuts(rows, names)

    def stored(df):
        blocks = boosting._blocks(df, names, "y", F.col("part"), cuts, 2)
        return blocks.agg(F.sum(F.length("part"))).first()[0]

    # More features than a long holds are all told apart.
    assert stored(rows) == stored(copies) == 3000
    fitted = [boosting.fit(df, names, "y", 6, [(0, 3, 0.1), (1, 2, 0.1)], F.col("part")) for df in (rows, copies)]
    for one, many in zip(*fitted):
        for a, b in zip(one.trees, many.trees):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)


def test_forecast_keeps_its_features(spark):
    rows = [r for c in "AB" for r in _bills(spark, range(1, 13), c)]
    f = T.add_lags(T.monthly_features(T.billing_clean(spark.createDataFrame(rows, LINES)))).cache()
    out = T.forecast_next(f, T.fit_revenue(f, n_estimators=1), keep=["revenue_lag_1"])
    assert out.columns == ["customer", "year_month", "label", "revenue_lag_1", "prediction"]
    assert [r["revenue_lag_1"] for r in out.collect()] == [1200.0, 1200.0]


def _files(spark):
    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    return {p for p in folder.rglob("*") if p.is_file()}


def test_a_level_is_one_job_and_leaves_no_files(spark, monkeypatch):
    rows = spark.range(2000).select(
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("double").alias(f"f{i}") for i in range(13)], (F.col("id") % 97).cast("double").alias("y"))
    rows = rows.localCheckpoint()
    names, sc, before = [f"f{i}" for i in range(13)], spark.sparkContext, _files(spark)
    # Lineage is cut by checkpoints on the way, which go as well.
    fitted = []
    for rounds in (2, 100):
        monkeypatch.setattr(boosting, "ROUNDS", rounds)
        sc.setJobGroup(f"fit-{rounds}", "")
        fitted.append(boosting.fit(rows, names, "y", 12, [(0, 2, 0.1)])[0])
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"fit-{rounds}"))
        # 24 levels; quantiles, blocks and checkpoints come besides.
        assert 24 <= jobs <= 24 + 8 + 12 // rounds
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert _files(spark) == before
    for a, b in zip(*(m.trees for m in fitted)):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)


def test_lines_are_shuffled_once(spark):
    features = T.add_lags(T.monthly_features(T.billing_clean(spark.createDataFrame(_bills(spark, [1, 2]), LINES))))
    # By customer and month, and by customer for the lags.
    assert features._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_lines_without_price_go_before_the_joins(spark):
    plan = T.billing_clean(billing(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    unpriced = [i for i, line in enumerate(plan) if "Filter" in line and "atleastnnonnulls" in line and "l_discount" in line]
    assert len(joins) == 3 and unpriced and unpriced[0] > joins[1]


def test_lines_without_price_customer_or_date_are_dropped(spark):
    rows = [("15/01/2020", "A", "P", p, 1.0, 50.0) for p in (1.0, None, float("nan"))]
    rows += [("15/01/2020", None, "P", 1.0, 1.0, 50.0), ("bad", "A", "P", 1.0, 1.0, 50.0), (None, "A", None, 1.0, 1.0, 50.0), ("16/01/2020", "B", None, 2.0, None, None)]
    out = T.billing_clean(spark.createDataFrame(rows, LINES))
    assert sorted((r["Customer Name"], r["Project"], r["Extended Price"]) for r in out.collect()) == [("A", "P", 1.0), ("B", "Unknown", 2.0)]
