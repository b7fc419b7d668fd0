"""Marketing and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.bands import dormancy, marketing_age_band, util_band
from finlake.operators import segments as S
from finlake.plans.oracle_views import pct, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import bank_marketing, credit_cards
from finlake.sources.profile import describe_all, row_counts

_CARD_AGE = "CASE WHEN age<30 THEN '<30' WHEN age<45 THEN '30-44' WHEN age<60 THEN '45-59' ELSE '60+' END"
_CARD_UTIL = ("CASE WHEN util_ratio<0.25e0 THEN '<25 %' WHEN util_ratio<0.5e0 THEN '25-49 %' "
              "WHEN util_ratio<0.75e0 THEN '50-74 %' ELSE '75 %+' END")
_Y = "count(*) FILTER (y='yes')"


@query("prf1_row_counts", with_views(
    "SELECT 'bank' AS \"table\", count(*) AS rows FROM bank_marketing UNION ALL SELECT 'cards', count(*) FROM credit_cards",
    "bank_marketing", "credit_cards"))
def _(spark, d):
    return row_counts({"bank": bank_marketing(spark, d), "cards": credit_cards(spark, d)})


def _num(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
      {pr(f'avg({c}::DOUBLE)', 4)} AS mean, {pr(f'stddev_samp({c}::DOUBLE)', 4)} AS std, min({c})::DOUBLE AS min,
      {pr(f'quantile_cont({c}::DOUBLE,0.25)', 4)} AS p25, {pr(f'quantile_cont({c}::DOUBLE,0.5)', 4)} AS p50,
      {pr(f'quantile_cont({c}::DOUBLE,0.75)', 4)} AS p75, max({c})::DOUBLE AS max FROM bank_marketing"""


def _txt(c: str) -> str:
    return f"""SELECT '{c}', sum(n)::BIGINT, count(*), max_by({c}, (n, {c})), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (SELECT {c}, count(*) AS n FROM bank_marketing GROUP BY {c})"""


@query("prf2_describe_all", with_views(
    " UNION ALL ".join([_num("custkey"), _num("age"), _num("pdays"), _txt("job"), _txt("y")]), "bank_marketing"))
def _(spark, d):
    out = describe_all(bank_marketing(spark, d))
    return out.withColumns({p: S.portable_round(p, 4) for p in ("mean", "std", "p25", "p50", "p75")})


@query("agg1_response_rate", with_views(
    f"SELECT count(*) AS total_customers, {_Y} AS responders, {pct(_Y, 'count(*)')} AS response_pct FROM bank_marketing",
    "bank_marketing"))
def _(spark, d):
    return S.rate(bank_marketing(spark, d), total="total_customers")


@query("agg2_response_by_job", with_views(
    f"""SELECT lower(job) AS job, count(*) AS total, {_Y} AS responders, {pct(_Y, 'count(*)')} AS response_pct
    FROM bank_marketing GROUP BY lower(job) ORDER BY response_pct DESC, job LIMIT 10""", "bank_marketing"))
def _(spark, d):
    return S.response_by_job(bank_marketing(spark, d))


@query("agg3_dormancy_summary", with_views(
    f"""SELECT count(*) FILTER (pdays=999) AS dormant_customers, count(*) FILTER (pdays<>999) AS active_customers,
    {pct('count(*) FILTER (pdays=999)', 'count(*)')} AS dormant_pct FROM bank_marketing""", "bank_marketing"))
def _(spark, d):
    return S.dormancy_summary(bank_marketing(spark, d))


@query("agg4_response_by_dormancy", with_views(
    f"""SELECT CASE WHEN pdays=999 THEN 'Dormant' ELSE 'Active' END AS segment, count(*) AS customers, {_Y} AS responders,
    {pct(_Y, 'count(*)')} AS response_pct FROM bank_marketing GROUP BY 1""", "bank_marketing"))
def _(spark, d):
    return S.response_by_dormancy(bank_marketing(spark, d))


@query("agg5_profit_by_tenure", with_views(
    f"""SELECT tenure, count(*) AS customers, {pr('avg(annual_profit)')} AS avg_profit,
    {pr('(avg(util_ratio)*100)')} AS avg_util_pct FROM cards GROUP BY tenure""", "cards"))
def _(spark, d):
    return S.profit_by_tenure(S.card_enriched(credit_cards(spark, d)))


@query("agg6_response_by_age_band", with_views(
    f"""SELECT {_CARD_AGE} AS age_band, count(*) AS customers, {pct(_Y, 'count(*)')} AS response_rate
    FROM bank_marketing GROUP BY 1""", "bank_marketing"))
def _(spark, d):
    return S.response_by_age(bank_marketing(spark, d))


@query("agg7_profit_by_util_band", with_views(
    f"SELECT {_CARD_UTIL} AS util_band, count(*) AS customers, {pr('avg(annual_profit)')} AS avg_profit FROM cards GROUP BY 1", "cards"))
def _(spark, d):
    return S.profit_by_util(S.card_enriched(credit_cards(spark, d)))


@query("bnd4_marketing_age_band", with_views(f"SELECT custkey, {_CARD_AGE} AS age_band FROM bank_marketing", "bank_marketing"))
def _(spark, d):
    return bank_marketing(spark, d).select("custkey", marketing_age_band().alias("age_band"))


@query("bnd5_util_band", with_views(f"SELECT cust_id, util_ratio, {_CARD_UTIL} AS util_band FROM cards", "cards"))
def _(spark, d):
    return S.card_enriched(credit_cards(spark, d)).select("cust_id", "util_ratio", util_band().alias("util_band"))


@query("bnd6_dormancy", with_views(
    "SELECT custkey, CASE WHEN pdays=999 THEN 'Dormant' ELSE 'Active' END AS segment FROM bank_marketing", "bank_marketing"))
def _(spark, d):
    return bank_marketing(spark, d).select("custkey", dormancy().alias("segment"))


@query("prj5_card_enriched", with_views("SELECT * FROM cards", "cards"))
def _(spark, d):
    return S.card_enriched(credit_cards(spark, d))


@query("prj6_spend_vs_payment", with_views(
    """SELECT purchases AS total_spend, payments AS total_payments, (payments>purchases)::INTEGER AS overpay_flag
    FROM credit_cards ORDER BY cust_id LIMIT 200""", "credit_cards"))
def _(spark, d):
    return S.spend_vs_payment(credit_cards(spark, d))


@query("win1_profit_vintiles", with_views(
    f"""SELECT CASE WHEN v=20 THEN 'Top 5 %' ELSE 'Bottom 5 %' END AS segment, count(*) AS customers,
    {pr('avg(annual_profit)')} AS avg_profit, {pr('(avg(util_ratio)*100)')} AS avg_util_pct
    FROM (SELECT *, ntile(20) OVER (ORDER BY annual_profit NULLS FIRST, cust_id) AS v FROM cards) WHERE v IN (1,20) GROUP BY 1""", "cards"))
def _(spark, d):
    return S.extreme_segments(S.card_enriched(credit_cards(spark, d)))


@query("fn1_rounding", "SELECT o_orderkey, " + ", ".join(
    f"{pr('(o_totalprice/7)', i)} AS r{i}" for i in range(4)) + " FROM orders")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", *[S.portable_round(F.col("o_totalprice") / 7, i).alias(f"r{i}") for i in range(4)])


@query("fn2_safe_division", with_views(
    "SELECT cust_id, balance/nullif(credit_limit,0e0) AS util FROM credit_cards", "credit_cards"))
def _(spark, d):
    return credit_cards(spark, d).select("cust_id", S.ratio("balance", "credit_limit").alias("util"))
