"""Lakehouse queries: bronze, silver, gold, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.bands import age_group, credit_band, wealth_tier
from finlake.functions.numeric import rounded
from finlake.operators import medallion as M
from finlake.plans.oracle_views import near, pct, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import bank_customers
from finlake.session import new_path, stage_table
from finlake.sources.sinks import write_table

_CHURN = 'sum("Churn")::BIGINT'


def _silver(spark, d):
    return M.silver(bank_customers(spark, d))


@query("prj1_prj2_silver_names", with_views(
    """SELECT "CustomerID", "ETF Tech" AS "ETF_Tech", "Net Assets" AS "Net_Assets", "Portfolio Return" AS "Portfolio_Return" FROM bank_customers""",
    "bank_customers"))
def _(spark, d):
    return M.to_silver_names(bank_customers(spark, d)).drop(*M.UNUSED).select(
        "CustomerID", "ETF_Tech", "Net_Assets", "Portfolio_Return")


@query("fil1_valid_customers", with_views(
    'SELECT "CustomerID" FROM bank_customers WHERE "Age">0 AND "EstimatedSalary">0 AND "CreditScore">0', "bank_customers"))
def _(spark, d):
    return M.valid_customers(bank_customers(spark, d)).select("CustomerID")


@query("bnd1_bnd2_bnd3_bands", with_views('SELECT "CustomerID", "WealthTier", "AgeGroup", "CreditBand" FROM silver', "silver"))
def _(spark, d):
    named = M.to_silver_names(bank_customers(spark, d))
    return named.select("CustomerID", wealth_tier().alias("WealthTier"), age_group().alias("AgeGroup"),
                        credit_band().alias("CreditBand"))


@query("drv1_drv2_derived", with_views('SELECT "CustomerID", "InvestmentCount", "SalaryToDebtRatio" FROM silver', "silver"))
def _(spark, d):
    named = M.to_silver_names(bank_customers(spark, d))
    return named.select("CustomerID", M.investment_count().alias("InvestmentCount"), M.salary_to_debt().alias("SalaryToDebtRatio"))


@query("drv3_silver", with_views("SELECT * FROM silver", "silver"))
def _(spark, d):
    return _silver(spark, d)


_TIERS = "avg_net_assets avg_portfolio_return avg_credit_score avg_investments_held avg_salary avg_diversification"


@query("agg11_gold_wealth_tiers", with_views(near("SELECT * FROM gold_tiers", _TIERS), "gold_tiers"))
def _(spark, d):
    return rounded(M.gold_wealth_tiers(_silver(spark, d)), _TIERS.split())


_AGES = "avg_net_assets avg_return avg_investments avg_risk_profile avg_foreign_assets"


@query("agg12_gold_age_groups", with_views(near("SELECT * FROM gold_ages", _AGES), "gold_ages"))
def _(spark, d):
    return rounded(M.gold_age_groups(_silver(spark, d)), _AGES.split())


_COUNTRIES = "avg_net_assets avg_return avg_credit_score avg_products_held avg_salary"


@query("agg13_gold_countries", with_views(near("SELECT * FROM gold_countries", _COUNTRIES), "gold_countries"))
def _(spark, d):
    return rounded(M.gold_countries(_silver(spark, d)), _COUNTRIES.split())


@query("agg11_agg12_agg13_gold_tables", with_views(
    f"""SELECT * FROM (SELECT 'tiers' AS gold, "WealthTier", NULL::VARCHAR AS "AgeGroup", NULL::VARCHAR AS "Country", total_customers,
      avg_net_assets, avg_portfolio_return AS avg_return, total_churned FROM ({near('SELECT * FROM gold_tiers', _TIERS)})
    UNION ALL SELECT 'ages', NULL, "AgeGroup", NULL, total_customers, avg_net_assets, avg_return, total_churned
      FROM ({near('SELECT * FROM gold_ages', _AGES)})
    UNION ALL SELECT 'countries', "WealthTier", NULL, "Country", total_customers, avg_net_assets, avg_return, total_churned
      FROM ({near('SELECT * FROM gold_countries', _COUNTRIES)}))""", "gold_tiers", "gold_ages", "gold_countries"))
def _(spark, d):
    """The three gold tables of one pass over silver."""
    tables = M.gold_split(stage_table(M.gold_groups(_silver(spark, d)), "gold"))
    text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    parts = []
    for name, df, means in zip(("tiers", "ages", "countries"), tables, (_TIERS, _AGES, _COUNTRIES)):
        back = "avg_portfolio_return" if name == "tiers" else "avg_return"
        parts.append(rounded(df, means.split()).select(
            F.lit(name).alias("gold"), *(text(df, c).alias(c) for c in ("WealthTier", "AgeGroup", "Country")), "total_customers",
            "avg_net_assets", F.col(back).alias("avg_return"), "total_churned"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg14_tier_report", with_views(
    f"""SELECT "WealthTier", total_customers, {pr('avg_net_assets', 0)} AS avg_net_assets, {pr('(avg_portfolio_return*100)')} AS avg_return_pct,
    {pr('avg_investments_held', 1)} AS avg_investments, {pr('(avg_diversification*100)', 1)} AS avg_diversification_pct, total_churned,
    {pct('total_churned', 'total_customers', 1)} AS churn_rate_pct FROM gold_tiers""", "gold_tiers"))
def _(spark, d):
    return M.tier_report(M.gold_wealth_tiers(_silver(spark, d)))


@query("agg15_age_report", with_views(
    f"""SELECT "AgeGroup", total_customers, {pr('avg_net_assets', 0)} AS avg_net_assets, {pr('(avg_return*100)')} AS avg_return_pct,
    {pr('avg_investments', 1)} AS avg_investments_held, {pr('avg_risk_profile')} AS avg_risk_profile, total_churned FROM gold_ages""", "gold_ages"))
def _(spark, d):
    return M.age_report(M.gold_age_groups(_silver(spark, d)))


@query("agg16_country_report", with_views(
    f"""SELECT "Country", "WealthTier", total_customers, {pr('avg_net_assets', 0)} AS avg_net_assets, {pr('(avg_return*100)')} AS avg_return_pct,
    {pr('avg_credit_score', 0)} AS avg_credit_score, {pr('avg_products_held', 1)} AS avg_products_held, total_churned,
    {pct('total_churned', 'total_customers', 1)} AS churn_rate_pct FROM gold_countries""", "gold_countries"))
def _(spark, d):
    return M.country_report(M.gold_countries(_silver(spark, d)))


@query("agg17_credit_band_report", with_views(
    f"""SELECT "CreditBand", count(*) AS total_customers, {pr('avg("Net_Assets")', 0)} AS avg_net_assets,
    {pr('(avg("Portfolio_Return")*100)')} AS avg_return_pct, {pr('avg("CreditScore")', 0)} AS avg_credit_score,
    {pr('avg("InvestmentCount")', 1)} AS avg_investments, {_CHURN} AS total_churned FROM silver GROUP BY "CreditBand" """, "silver"))
def _(spark, d):
    return M.credit_band_report(_silver(spark, d))


@query("agg18_churn_profiles", with_views(
    f"""SELECT "WealthTier", "AgeGroup", "CreditBand", "Country", count(*) AS total_customers, {_CHURN} AS churned,
    {pct(_CHURN, 'count(*)', 1)} AS churn_rate_pct, {pr('avg("Net_Assets")', 0)} AS avg_net_assets FROM silver
    GROUP BY 1, 2, 3, 4 HAVING count(*)>2 ORDER BY churn_rate_pct DESC, "WealthTier", "AgeGroup", "CreditBand", "Country" LIMIT 15""", "silver"))
def _(spark, d):
    return M.churn_profiles(_silver(spark, d), min_n=2)


@query("agg19_product_mix", with_views(
    'SELECT "WealthTier", ' + ", ".join(
        f"""{pr(f'(avg("{p}")*100)', 1)} AS {n}""" for p, n in zip(M.PRODUCTS, (
            "pct_emerging_market", "pct_real_estate", "pct_private_equity", "pct_govt_bonds", "pct_corp_bonds",
            "pct_etf_tech", "pct_etf_health", "pct_etf_med"), strict=True)) + ' FROM silver GROUP BY "WealthTier"', "silver"))
def _(spark, d):
    return M.product_mix(_silver(spark, d))


@query("srt1_top_customers", with_views(
    f"""SELECT "CustomerID", "Country", "Age", "AgeGroup", "WealthTier", "CreditBand", {pr('"Net_Assets"', 0)} AS net_assets,
    {pr('("Portfolio_Return"*100)')} AS return_pct, "InvestmentCount", "NumProducts", "Churn" FROM silver
    ORDER BY "Net_Assets" DESC, "CustomerID" LIMIT 10""", "silver"))
def _(spark, d):
    return M.top_customers(_silver(spark, d))


@query("snk1_write_table", with_views('SELECT "CustomerID", "WealthTier", "Net_Assets" FROM silver', "silver"))
def _(spark, d):
    path = new_path(spark, "silver")
    out = _silver(spark, d).select("CustomerID", "WealthTier", "Net_Assets")
    for _ in range(2):
        out_table = write_table(out, "finlake_silver", path)
    return out_table.select(*[F.col(c) for c in out.columns])
