"""Billing and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round, rounded
from finlake.functions.parsing import parse_date
from finlake.operators import forecast as T
from finlake.plans.oracle_views import near, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import billing
from finlake.session import stage_table


# Compared with the last digits of sums and means cut.
_MONTHLY = "revenue_sum revenue_mean revenue_std hours_sum billingrate_mean"
_LAGGED = _MONTHLY + " revenue_lag_1 revenue_lag_2 revenue_lag_3"


def _monthly(spark, d):
    return T.monthly_features(T.billing_clean(billing(spark, d)))


@query("ts1_fil2_fil3_prj3_billing_clean", with_views(
    'SELECT day, customer, project, price, hours FROM billing_clean', "billing_clean"))
def _(spark, d):
    return T.billing_clean(billing(spark, d)).select(
        F.col("Worked Date").alias("day"), F.col("Customer Name").alias("customer"), F.col("Project").alias("project"),
        F.col("Extended Price").alias("price"), F.col("Billable Hours").alias("hours"))


@query("fn7_fn9_fn10_dates", with_views(
    """SELECT customer, price, hours, day, month(day)::INTEGER AS month, quarter(day)::INTEGER AS quarter,
    date_trunc('month', day)::DATE AS year_month, (date_trunc('month', day)+INTERVAL 1 MONTH)::DATE AS next_month
    FROM (SELECT *, try_strptime(worked,'%d/%m/%Y')::DATE AS day FROM billing)""", "billing"))
def _(spark, d):
    day = parse_date("Worked Date")
    return T.strip_names(billing(spark, d)).select(
        F.col("Customer Name").alias("customer"), F.col("Extended Price").alias("price"), F.col("Billable Hours").alias("hours"),
        day.alias("day"), F.month(day).alias("month"), F.quarter(day).alias("quarter"),
        F.trunc(day, "MM").alias("year_month"), F.add_months(F.trunc(day, "MM"), 1).alias("next_month"))


@query("agg20_monthly_features", with_views(near("SELECT * FROM monthly", _MONTHLY), "monthly"))
def _(spark, d):
    return rounded(_monthly(spark, d), _MONTHLY.split())


@query("win6_udf3_lags", with_views(near("SELECT * FROM lagged", _LAGGED), "lagged"))
def _(spark, d):
    return rounded(T.add_lags(_monthly(spark, d)), _LAGGED.split())


@query("win7_latest_per_customer", with_views(
    near("SELECT * FROM lagged WHERE (customer, year_month) IN (SELECT (customer, max(year_month)) FROM lagged GROUP BY customer)", _LAGGED),
    "lagged"))
def _(spark, d):
    return rounded(T.latest_per(T.add_lags(_monthly(spark, d))), _LAGGED.split())


@query("ts2_chrono_split", with_views(
    """SELECT customer, year_month, CASE WHEN year_month<(SELECT min(m) FROM (SELECT DISTINCT year_month AS m FROM lagged ORDER BY m DESC LIMIT 2))
    THEN 'train' ELSE 'test' END AS part FROM lagged""", "lagged"))
def _(spark, d):
    train, test = T.chrono_split(stage_table(T.add_lags(_monthly(spark, d)), "features"))
    cols = ("customer", "year_month")
    return train.select(*cols, F.lit("train").alias("part")).unionByName(test.select(*cols, F.lit("test").alias("part")))


@query("ts5_score_forecast", with_views(
    f"""SELECT count(*) AS n, {pr('sqrt(avg(power(revenue_sum-revenue_lag_1,2)))', 2)} AS rmse,
    {pr('(1e0-avg(power(revenue_sum-revenue_lag_1,2))/var_pop(revenue_sum))', 4)} AS r2 FROM lagged""", "lagged"))
def _(spark, d):
    # The naive forecast: last month again.
    out = T.score_forecast(T.add_lags(_monthly(spark, d)).withColumn("prediction", F.col("revenue_lag_1")))
    return out.withColumns({"rmse": portable_round("rmse"), "r2": portable_round("r2", 4)})


def _trained(spark, d):
    lagged = stage_table(T.add_lags(_monthly(spark, d)), "features")
    train, test = T.chrono_split(lagged)
    return lagged, test, T.fit_revenue(train)


_TEST = "year_month>=(SELECT min(m) FROM (SELECT DISTINCT year_month AS m FROM lagged ORDER BY m DESC LIMIT 2))"


@query("ts3_fit_revenue", with_views(f"SELECT count(*) AS n, true AS beats_mean FROM lagged WHERE {_TEST}", "lagged"))
def _(spark, d):
    """The model explains held-out months better than their own mean would."""
    _, test, model = _trained(spark, d)
    return T.score_forecast(T.predict(model, test)).select("n", (F.col("r2") > 0).alias("beats_mean"))


@query("ts4_time_series_cv", " UNION ALL ".join(
    f"SELECT {n}::INTEGER AS n_estimators, {m}::INTEGER AS max_depth, {s}::DOUBLE AS learning_rate, true AS scored"
    for n in T.GRID["n_estimators"] for m in T.GRID["max_depth"] for s in T.GRID["learning_rate"]))
def _(spark, d):
    lagged = stage_table(T.add_lags(_monthly(spark, d)), "features")
    return T.time_series_cv(lagged).withColumn("scored", F.col("rmse") > 0).drop("rmse")


@query("ts6_forecast_next", with_views(near(
    """SELECT customer, (year_month+INTERVAL 1 MONTH)::DATE AS year_month,
    strftime(year_month+INTERVAL 1 MONTH,'%B %Y') AS label, revenue_sum AS revenue_lag_1, revenue_lag_1 AS revenue_lag_2,
    revenue_lag_2 AS revenue_lag_3, true AS predicted FROM lagged
    WHERE (customer, year_month) IN (SELECT (customer, max(year_month)) FROM lagged GROUP BY customer)""",
    "revenue_lag_1 revenue_lag_2 revenue_lag_3"), "lagged"))
def _(spark, d):
    """Next month of every customer: the features it is forecast from, and that there is a forecast."""
    lagged, _, model = _trained(spark, d)
    lags = ["revenue_lag_1", "revenue_lag_2", "revenue_lag_3"]
    made = T.forecast_next(lagged, model, keep=lags)
    return rounded(made.withColumn("predicted", F.col("prediction").isNotNull()).drop("prediction"), lags)
