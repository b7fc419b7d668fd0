"""Price series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round
from finlake.operators import series as P
from finlake.plans.oracle_views import pct, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import prices

_MONTH = "date_trunc('month', date)::DATE"


@query("agg21_to_monthly", with_views(
    f"SELECT metal, {_MONTH} AS month, {pr('avg(price)')} AS price FROM prices GROUP BY metal, {_MONTH}", "prices"))
def _(spark, d):
    return P.to_monthly(prices(spark, d)).withColumn("price", portable_round("price"))


@query("agg22_yearly_avg", with_views("SELECT * FROM yearly", "yearly"))
def _(spark, d):
    return P.yearly_avg(prices(spark, d))


@query("fil5_date_slice", with_views(
    "SELECT * FROM prices WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'", "prices"))
def _(spark, d):
    return P.date_slice(prices(spark, d), "1998-01-01", "2000-12-31")


@query("joi3_price_ratio", with_views("SELECT * FROM price_ratio", "price_ratio"))
def _(spark, d):
    return P.price_ratio(prices(spark, d))


@query("srt3_extreme_ratios", with_views(
    "SELECT * FROM price_ratio WHERE ratio IS NOT NULL ORDER BY ratio DESC, month LIMIT 10", "price_ratio"))
def _(spark, d):
    return P.extreme_ratios(prices(spark, d), 10)


@query("srt2_topn_periods", with_views(
    """SELECT * FROM (SELECT metal, year, avg_price, (rank() OVER (PARTITION BY metal ORDER BY avg_price DESC))::INTEGER AS place, 'best' AS side FROM yearly
    UNION ALL SELECT metal, year, avg_price, (rank() OVER (PARTITION BY metal ORDER BY avg_price))::INTEGER, 'worst' FROM yearly) WHERE place<=2""", "yearly"))
def _(spark, d):
    return P.topn_periods(P.yearly_avg(prices(spark, d)), 2)


@query("win9_yearly_change", with_views(
    f"""SELECT metal, year, avg_price, prev_price, {pct('avg_price-prev_price', 'prev_price')} AS change_pct
    FROM (SELECT *, lag(avg_price) OVER (PARTITION BY metal ORDER BY year) AS prev_price FROM yearly)""", "yearly"))
def _(spark, d):
    return P.yearly_change(prices(spark, d))


@query("win9_monthly_change", with_views(
    f"""SELECT metal, month, price, prev_price, {pct('price-prev_price', 'prev_price')} AS change_pct
    FROM (SELECT *, lag(price) OVER (PARTITION BY metal ORDER BY month) AS prev_price FROM
      (SELECT metal, {_MONTH} AS month, {pr('avg(price)')} AS price FROM prices GROUP BY metal, {_MONTH}))""", "prices"))
def _(spark, d):
    return P.monthly_change(prices(spark, d))


@query("set2_merge_feeds", with_views(
    f"""SELECT metal, month, {pr('arg_max(price, priority)')} AS price, max(priority)::INTEGER AS priority FROM (
      SELECT metal, {_MONTH} AS month, priority, avg(price) AS price FROM (
        SELECT metal, date, price, 1 AS priority FROM prices WHERE date<DATE '1999-06-01'
        UNION ALL SELECT metal, {_MONTH}, price*1.01e0, 2 FROM prices WHERE date>=DATE '1999-01-01') GROUP BY metal, {_MONTH}, priority)
    GROUP BY metal, month""", "prices"))
def _(spark, d):
    both = prices(spark, d)
    feeds = []
    for metal in ("Gold", "Silver", "Platinum"):
        one = both.where(F.col("metal") == metal)
        feeds.append((P.date_slice(one, "1990-01-01", "1999-05-31"), metal, 1))
        late = P.date_slice(one, "1999-01-01", "2100-01-01")
        feeds.append((late.select(F.trunc("date", "MM").alias("date"), (F.col("price") * 1.01).alias("price")), metal, 2))
    return P.merge_feeds(feeds).withColumn("price", portable_round("price"))


@query("ts7_series_coverage", with_views(
    f"""SELECT metal, min(m) AS first_month, max(m) AS last_month, count(DISTINCT m) AS months_present,
    ((SELECT date_diff('month', date_trunc('month', min(date)), date_trunc('month', max(date)))+1 FROM prices)-count(DISTINCT m))::BIGINT AS months_missing
    FROM (SELECT metal, {_MONTH} AS m FROM prices) GROUP BY metal""", "prices"))
def _(spark, d):
    return P.series_coverage(prices(spark, d))


@query("ts7_missing_months", with_views(
    f"""SELECT metal, month FROM (SELECT DISTINCT metal FROM prices) CROSS JOIN
      (SELECT unnest(generate_series((SELECT date_trunc('month', min(date)) FROM prices), (SELECT date_trunc('month', max(date)) FROM prices), INTERVAL 1 MONTH))::DATE AS month)
    EXCEPT SELECT metal, {_MONTH} FROM prices""", "prices"))
def _(spark, d):
    return P.missing_months(prices(spark, d))
