"""Bronze to silver to gold customer tables and the reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.bands import age_group, credit_band, wealth_tier
from finlake.functions.numeric import pct, portable_round

# Source names with spaces, unused columns, product indicators.
SILVER_NAMES = {
    "ETF Tech": "ETF_Tech", "ETF Health": "ETF_Health", "ETF Med": "ETF_Med", "Risk Profile": "Risk_Profile",
    "Net Assets": "Net_Assets", "Portfolio Return": "Portfolio_Return",
}
UNUSED = ("RowNumber", "Surname")
PRODUCTS = ("EmergingMarketFund", "RealEstate", "PrivateEquity", "GovtBonds", "CorpBonds", "ETF_Tech", "ETF_Health", "ETF_Med")


def to_silver_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SILVER_NAMES)


def valid_customers(df: DataFrame) -> DataFrame:
    """Positive age, salary and score; nulls fail the test."""
    return df.where((F.col("Age") > 0) & (F.col("EstimatedSalary") > 0) & (F.col("CreditScore") > 0))


def investment_count(products: Sequence[str] = PRODUCTS) -> Column:
    """Number of products held; null when any indicator is null."""
    total = F.col(products[0])
    for name in products[1:]:
        total = total + F.col(name)
    return total


def salary_to_debt() -> Column:
    return F.when(F.col("Debt") > 0, F.try_divide("EstimatedSalary", "Debt"))


def silver(df: DataFrame) -> DataFrame:
    """Cleaned customers with bands and derived columns; one projection over one scan."""
    named = to_silver_names(df).drop(*UNUSED)
    return valid_customers(named).withColumns({
        "WealthTier": wealth_tier(),
        "AgeGroup": age_group(),
        "CreditBand": credit_band(),
        "InvestmentCount": investment_count(),
        "SalaryToDebtRatio": salary_to_debt(),
    })


def _n() -> Column:
    return F.count(F.lit(1)).alias("total_customers")


def _churned(name: str = "total_churned") -> Column:
    return F.sum(F.col("Churn").cast("bigint")).alias(name)


def gold_wealth_tiers(df: DataFrame) -> DataFrame:
    return df.groupBy("WealthTier").agg(
        _n(),
        F.avg("Net_Assets").alias("avg_net_assets"),
        F.avg("Portfolio_Return").alias("avg_portfolio_return"),
        F.avg("CreditScore").alias("avg_credit_score"),
        F.avg("InvestmentCount").alias("avg_investments_held"),
        F.avg("EstimatedSalary").alias("avg_salary"),
        _churned(),
        F.avg("Diversification").alias("avg_diversification"),
    ).orderBy(F.desc("avg_net_assets"))


def gold_age_groups(df: DataFrame) -> DataFrame:
    return df.groupBy("AgeGroup").agg(
        _n(),
        F.avg("Net_Assets").alias("avg_net_assets"),
        F.avg("Portfolio_Return").alias("avg_return"),
        F.avg("InvestmentCount").alias("avg_investments"),
        F.avg("Risk_Profile").alias("avg_risk_profile"),
        F.avg("ForeignAssets").alias("avg_foreign_assets"),
        _churned(),
    ).orderBy("AgeGroup")


def gold_countries(df: DataFrame) -> DataFrame:
    return df.groupBy("Country", "WealthTier").agg(
        _n(),
        F.avg("Net_Assets").alias("avg_net_assets"),
        F.avg("Portfolio_Return").alias("avg_return"),
        F.avg("CreditScore").alias("avg_credit_score"),
        F.avg("NumProducts").alias("avg_products_held"),
        _churned(),
        F.avg("EstimatedSalary").alias("avg_salary"),
    ).orderBy("Country", F.desc("avg_net_assets"))


# Grouping ids over (WealthTier, AgeGroup, Country): a set bit is a column left out.
_TIER_ROWS, _AGE_ROWS, _COUNTRY_ROWS = 0b011, 0b101, 0b010
_MEASURES = ("Net_Assets", "Portfolio_Return", "CreditScore", "InvestmentCount", "EstimatedSalary", "Diversification",
             "Risk_Profile", "ForeignAssets", "NumProducts")


def gold_groups(df: DataFrame) -> DataFrame:
    """All groups of the three gold tables from one scan and one shuffle; ``level`` tells the table of a row.

    A few rows per key, whatever the silver table holds: write it once and
    split it with :func:`gold_split`.
    """
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return df.groupingSets(
        [["WealthTier"], ["AgeGroup"], ["Country", "WealthTier"]], "WealthTier", "AgeGroup", "Country",
    ).agg(F.grouping_id().cast("int").alias("level"), _n(), _churned(), *map(mean, _MEASURES))


def gold_split(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables by wealth tier, age group, and country with tier, as the functions above build each by itself."""
    def table(level: int, *columns: str | Column) -> DataFrame:
        return groups.where(F.col("level") == level).select(*columns)

    mean = lambda c, name: F.col(f"mean_{c}").alias(name)
    tiers = table(
        _TIER_ROWS, "WealthTier", "total_customers", mean("Net_Assets", "avg_net_assets"),
        mean("Portfolio_Return", "avg_portfolio_return"), mean("CreditScore", "avg_credit_score"),
        mean("InvestmentCount", "avg_investments_held"), mean("EstimatedSalary", "avg_salary"), "total_churned",
        mean("Diversification", "avg_diversification"))
    ages = table(
        _AGE_ROWS, "AgeGroup", "total_customers", mean("Net_Assets", "avg_net_assets"), mean("Portfolio_Return", "avg_return"),
        mean("InvestmentCount", "avg_investments"), mean("Risk_Profile", "avg_risk_profile"),
        mean("ForeignAssets", "avg_foreign_assets"), "total_churned")
    countries = table(
        _COUNTRY_ROWS, "Country", "WealthTier", "total_customers", mean("Net_Assets", "avg_net_assets"),
        mean("Portfolio_Return", "avg_return"), mean("CreditScore", "avg_credit_score"),
        mean("NumProducts", "avg_products_held"), "total_churned", mean("EstimatedSalary", "avg_salary"))
    return (tiers.orderBy(F.desc("avg_net_assets")), ages.orderBy("AgeGroup"),
            countries.orderBy("Country", F.desc("avg_net_assets")))


def tier_report(gold: DataFrame) -> DataFrame:
    return gold.select(
        "WealthTier", "total_customers",
        portable_round("avg_net_assets", 0).alias("avg_net_assets"),
        portable_round(F.col("avg_portfolio_return") * 100).alias("avg_return_pct"),
        portable_round("avg_investments_held", 1).alias("avg_investments"),
        portable_round(F.col("avg_diversification") * 100, 1).alias("avg_diversification_pct"),
        "total_churned",
        pct("total_churned", "total_customers", 1).alias("churn_rate_pct"),
    ).orderBy(F.desc("avg_net_assets"))


def age_report(gold: DataFrame) -> DataFrame:
    return gold.select(
        "AgeGroup", "total_customers",
        portable_round("avg_net_assets", 0).alias("avg_net_assets"),
        portable_round(F.col("avg_return") * 100).alias("avg_return_pct"),
        portable_round("avg_investments", 1).alias("avg_investments_held"),
        portable_round("avg_risk_profile").alias("avg_risk_profile"),
        "total_churned",
    ).orderBy(F.desc("avg_return_pct"))


def country_report(gold: DataFrame) -> DataFrame:
    return gold.select(
        "Country", "WealthTier", "total_customers",
        portable_round("avg_net_assets", 0).alias("avg_net_assets"),
        portable_round(F.col("avg_return") * 100).alias("avg_return_pct"),
        portable_round("avg_credit_score", 0).alias("avg_credit_score"),
        portable_round("avg_products_held", 1).alias("avg_products_held"),
        "total_churned",
        pct("total_churned", "total_customers", 1).alias("churn_rate_pct"),
    ).orderBy("Country", F.desc("avg_net_assets"))


def credit_band_report(df: DataFrame) -> DataFrame:
    return df.groupBy("CreditBand").agg(
        _n(),
        portable_round(F.avg("Net_Assets"), 0).alias("avg_net_assets"),
        portable_round(F.avg("Portfolio_Return") * 100).alias("avg_return_pct"),
        portable_round(F.avg("CreditScore"), 0).alias("avg_credit_score"),
        portable_round(F.avg("InvestmentCount"), 1).alias("avg_investments"),
        _churned(),
    ).orderBy(F.desc("avg_credit_score"))


def top_customers(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest customers by assets, ties by id."""
    return df.orderBy(F.desc("Net_Assets"), "CustomerID").limit(k).select(
        "CustomerID", "Country", "Age", "AgeGroup", "WealthTier", "CreditBand",
        portable_round("Net_Assets", 0).alias("net_assets"),
        portable_round(F.col("Portfolio_Return") * 100).alias("return_pct"),
        "InvestmentCount", "NumProducts", "Churn",
    )


def churn_profiles(df: DataFrame, min_n: int = 10, k: int = 15) -> DataFrame:
    """Customer profiles with the highest churn among those above ``min_n`` customers."""
    keys = ("WealthTier", "AgeGroup", "CreditBand", "Country")
    return (
        df.groupBy(*keys)
        .agg(_n(), _churned("churned"), portable_round(F.avg("Net_Assets"), 0).alias("avg_net_assets"))
        .where(F.col("total_customers") > min_n)
        .withColumn("churn_rate_pct", pct("churned", "total_customers", 1))
        .orderBy(F.desc("churn_rate_pct"), *keys)
        .limit(k)
    )


def product_mix(df: DataFrame, products: Sequence[str] = PRODUCTS) -> DataFrame:
    """Share of customers holding each product per wealth tier."""
    # Report column names.
    names = ("pct_emerging_market", "pct_real_estate", "pct_private_equity", "pct_govt_bonds", "pct_corp_bonds",
             "pct_etf_tech", "pct_etf_health", "pct_etf_med")
    shares = [portable_round(F.avg(p) * 100, 1).alias(n) for p, n in zip(products, names, strict=True)]
    return df.groupBy("WealthTier").agg(*shares).orderBy("WealthTier")
