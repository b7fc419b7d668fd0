"""Test tables presented under the schemas of the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(c: Column, mapping: dict, default=None) -> Column:
    out = None
    for value, label in mapping.items():
        out = F.when(c == value, F.lit(label)) if out is None else out.when(c == value, F.lit(label))
    return out.otherwise(F.lit(default))


def paysim_from(orders: DataFrame) -> DataFrame:
    """Mobile-money transactions from orders, batch or stream."""
    key, amount = F.col("o_orderkey"), F.col("o_totalprice")
    kinds = {"1": "TRANSFER", "2": "CASH_OUT", "3": "PAYMENT", "4": "DEBIT", "5": "CASH_IN"}
    return orders.select(
        key.cast("string").alias("transaction_id"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) * 24).alias("step_hour"),
        _pick(F.substring("o_orderpriority", 1, 1), kinds).alias("transaction_type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_origin"),
        F.when(key % 7 == 0, amount).otherwise(portable_round(amount * 3)).alias("balance_orig_before"),
        F.when(key % 7 == 0, F.lit(0.0))
        .when(key % 11 == 0, portable_round(amount * 3 - amount - 150))
        .otherwise(portable_round(amount * 3 - amount)).alias("balance_orig_after"),
        F.concat(F.lit("M"), (key % 1000).cast("string")).alias("account_dest"),
        F.lit(0.0).alias("balance_dest_before"),
        amount.alias("balance_dest_after"),
        ((key % 7 == 0) | (key % 11 == 0) | (key % 101 == 0)).cast("int").alias("is_fraud"),
        (key % 77 == 0).cast("int").alias("is_flagged_by_system"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit(None).cast("string").alias("fraud_rule_triggered"),
    )


def paysim(spark: SparkSession, d: str) -> DataFrame:
    return paysim_from(table(spark, d, "orders"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


AML_TYPES = {"signup": "cash_deposit", "error": "wire", "purchase": "transfer", "click": "card", "view": "ach"}


def aml_tx(spark: SparkSession, d: str) -> DataFrame:
    """Clean account transactions from events."""
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("TXN"), e.cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC"), F.col("user_id").cast("string")).alias("account_id"),
        F.concat(F.lit("CUST"), F.col("user_id").cast("string")).alias("customer_id"),
        F.date_trunc("second", F.col("ts")).alias("ts"),
        portable_round(F.col("value") * 100).alias("amount"),
        F.lit("USD").alias("currency"),
        _pick(F.col("event_type"), AML_TYPES).alias("transaction_type"),
        F.when(e % 97 == 0, "XA").otherwise("US").alias("origin_country"),
        F.when(e % 89 == 0, "XB").otherwise("CA").alias("destination_country"),
        F.when(_k() < 50, "online").otherwise("branch").alias("channel"),
        F.concat(F.lit("memo "), _k().cast("string")).alias("memo"),
        F.lit(0).alias("missing_customer_flag"),
        F.lit(0).alias("amount_outlier_flag"),
    )


def aml_raw(spark: SparkSession, d: str) -> DataFrame:
    """The same transactions as a messy all-text export, some of them delivered twice."""
    e = F.col("event_id")
    kind = _pick(F.col("event_type"), AML_TYPES)
    copies = table(spark, d, "events").withColumn("k", _k()).withColumn(
        "copy", F.explode(F.when(F.col("k") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    amount = portable_round(F.col("value") * 100) + F.col("copy")
    stamp = [F.date_format("ts", f) for f in
             ("yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    pad = F.when(e % 25 == 0, F.lit("  ")).otherwise(F.lit(""))
    return copies.select(
        F.concat(F.lit("TXN"), e.cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC"), F.col("user_id").cast("string")).alias("account_id"),
        F.when(e % 33 == 0, F.lit("")).otherwise(F.concat(F.lit("CUST"), F.col("user_id").cast("string"))).alias("customer_id"),
        F.when(F.col("k") == 99, F.lit("not a date")).when(e % 4 == 0, stamp[0]).when(e % 4 == 1, stamp[1])
        .when(e % 4 == 2, stamp[2]).otherwise(stamp[3]).alias("timestamp"),
        F.when(e % 17 == 0, F.concat(F.lit("$"), F.format_number(amount, 2)))
        .when(e % 211 == 0, F.lit("abc")).otherwise(F.format_string("%.2f", amount)).alias("amount"),
        _pick(e % 20, {0: "usd", 1: "Usd", 2: "USD "}, "USD").alias("currency"),
        kind.alias("transaction_type"),
        F.concat(pad, F.when(e % 97 == 0, "XA").otherwise("US")).alias("origin_country"),
        F.when(e % 89 == 0, "XB").otherwise("CA").alias("destination_country"),
        F.when(F.col("k") < 50, "online").otherwise("branch").alias("channel"),
        F.concat(pad, F.lit("memo "), F.col("k").cast("string"), pad).alias("memo"),
        (e * 2 + F.col("copy")).alias("ingest_no"),
    )


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    fraud = (F.col("event_id") % 13 == 0).cast("int")
    return table(spark, d, "events").select(
        F.concat(F.lit("TXN"), F.col("event_id").cast("string")).alias("transaction_id"),
        fraud.alias("is_fraud"), F.when(fraud == 1, "planted").otherwise("none").alias("pattern"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Transactions already reviewed: those with a high score in the event properties."""
    outcome = _pick(_k() % 3, {0: "cleared", 1: "escalated"}, "confirmed_sar")
    return table(spark, d, "events").where(_k() >= 80).select(
        F.concat(F.lit("TXN"), F.col("event_id").cast("string")).alias("transaction_id"), outcome.alias("decision"),
        F.lit("analyst").alias("reviewer"), F.lit("").alias("notes"))


def bank_marketing(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("custkey"),
        (key % 60 + 18).cast("int").alias("age"),
        F.col("c_mktsegment").alias("job"),
        F.when(key % 4 != 0, F.lit(999)).otherwise((key % 30).cast("int")).alias("pdays"),
        F.when(F.col("c_acctbal") > 7000, "yes").otherwise("no").alias("y"),
    )


def _spend(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(portable_round(F.sum("o_totalprice")).alias("spend"))


def credit_cards(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    spend = F.coalesce("spend", F.lit(0.0))
    return table(spark, d, "customer").join(_spend(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("C"), key.cast("string")).alias("cust_id"),
        F.col("c_acctbal").alias("balance"),
        spend.alias("purchases"),
        (key % 5 * 10.0).alias("cash_advance"),
        F.when(key % 50 == 0, F.lit(0.0)).otherwise(F.lit(1000.0) + F.lit(500.0) * (key % 30)).alias("credit_limit"),
        portable_round(spend * (key % 3) * 0.75).alias("payments"),
        ((key % 10) / 10).alias("prc_full_payment"),
        (key % 7 + 6).cast("int").alias("tenure"),
    )


def bank_customers(spark: SparkSession, d: str) -> DataFrame:
    """Bronze customers, with the column names of the raw file."""
    key = F.col("c_custkey")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    spend = F.coalesce("spend", F.lit(0.0))

    def bit(i: int) -> Column:
        return F.shiftright(key, i).bitwiseAND(F.lit(1)).cast("int")

    names = ("EmergingMarketFund", "RealEstate", "PrivateEquity", "GovtBonds", "CorpBonds", "ETF Tech", "ETF Health", "ETF Med")
    return (
        table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(_spend(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            key.alias("RowNumber"), key.alias("CustomerID"), F.col("c_name").alias("Surname"), F.col("r_name").alias("Country"),
            (key % 60 + 18).cast("int").alias("Age"),
            (key * 37 % 500 + 350).cast("int").alias("CreditScore"),
            (key * 13 % 90000 + 20000).cast("double").alias("EstimatedSalary"),
            F.greatest(F.lit(0.0), F.lit(2000.0) - F.col("c_acctbal")).alias("Debt"),
            portable_round(spend / _pick(key % 4, {0: 8.0, 1: 20.0, 2: 60.0}, 400.0)).alias("Net Assets"),
            (F.lit(-0.05) + (key % 41) * 0.01).alias("Portfolio Return"),
            ((key % 5) * 0.25).alias("Risk Profile"),
            (key % 13 * 1000).cast("double").alias("ForeignAssets"),
            ((key % 11) * 0.1).alias("Diversification"),
            (key % 4 + 1).cast("int").alias("NumProducts"),
            (key % 5 == 0).cast("int").alias("Churn"),
            *[bit(i).alias(n) for i, n in enumerate(names)],
        )
    )


def billing(spark: SparkSession, d: str) -> DataFrame:
    """Billing lines as exported: padded names, day-first text dates, missing projects."""
    # Orders get their customers first, so that the far more lines are not shuffled for them.
    named = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, d, "lineitem")
        .join(named, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.when(F.col("l_quantity") == 50, F.lit("31/02/2000")).otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("Worked Date "),
            F.col("c_name").alias(" Customer Name"),
            F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("Project"),
            F.when(F.col("l_discount") < 0.1, F.col("l_extendedprice")).alias("Extended Price"),
            F.col("l_quantity").alias("Billable Hours"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("Hourly Billing Rate"),
        )
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Three metal series over all lines; the silver feed ends three months early, what follows is platinum."""
    day = F.to_date("l_shipdate")
    flag = F.col("l_returnflag")
    metal = F.when(flag == "A", "Gold").when((flag == "R") & (day < F.lit("2001-09-01").cast("date")), "Silver").otherwise("Platinum")
    return table(spark, d, "lineitem").select(day.alias("date"), F.col("l_extendedprice").alias("price"), metal.alias("metal"))


def crimes(spark: SparkSession, d: str) -> DataFrame:
    """Reported crimes in UTM metres, placed by two embedding components; some without position or with an impossible date."""
    v = F.col("vec_id")
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return table(spark, d, "embeddings").select(
        v.alias("crime_id"), F.col("label"),
        F.concat(F.lit("TYPE_"), F.col("label").cast("string")).alias("TYPE"),
        (v % 3 + 2022).cast("int").alias("YEAR"), (v % 12 + 1).cast("int").alias("MONTH"), (v % 31 + 1).cast("int").alias("DAY"),
        (v % 24).cast("int").alias("HOUR"), (v % 60).cast("int").alias("MINUTE"),
        F.concat(F.lit("DISTRICT_"), (v % 5).cast("string")).alias("NEIGHBOURHOOD"),
        F.when(v % 29 != 0, F.lit(491000.0) + portable_round(x.cast("double") * 50000)).alias("X"),
        (F.lit(5455000.0) + portable_round(y.cast("double") * 50000)).alias("Y"),
    )


def road_edges(spark: SparkSession, d: str) -> DataFrame:
    """One street per order, from its customer to a computed junction; parallel streets and dead ends occur."""
    junctions = table(spark, d, "customer").count() * 4 // 3
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("src"),
        ((F.col("o_orderkey") * 7 + 3) % junctions).alias("dst"),
        (F.col("o_totalprice") / 1000).alias("length"),
    )


def road_nodes(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.select(
        "id", (F.lit(49.2) + (F.col("id") % 100) * 0.001).alias("lat"),
        (F.lit(-123.13) + F.floor(F.col("id") / 100) * 0.001).alias("lon"))
