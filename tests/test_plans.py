"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from finlake.operators import casework as C
from finlake.operators import fraud as B
from finlake.operators import medallion as M
from finlake.operators import quality as Q
from finlake.operators import rules as R
from finlake.operators import screening as S
from finlake.operators import series as P
from finlake.operators import text
from finlake.operators.ordered import exact_median
from finlake.plans.catalogue import QUERIES
from finlake.plans.tables import aml_raw, aml_tx, bank_customers, decisions, paysim, prices, table
from finlake.session import stage_table
from tests.oracle import SF_DIR

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def tx(spark):
    return stage_table(aml_tx(spark, SF_DIR), "tx")


def _exchanges(text_plan, kind="hashpartitioning"):
    return len(re.findall(rf"Arguments: {kind}", text_plan))


def test_gold_tables_are_one_scan_and_one_shuffle(spark):
    groups = M.gold_groups(M.silver(stage_table(bank_customers(spark, SF_DIR), "customers")))
    p = plan(groups)
    assert len(re.findall(r"^\(\d+\) Scan", p, re.M)) == 1 and _exchanges(p) == 1
    # Null keys of a table are rows of their own, not taken for columns left out.
    silver = stage_table(M.silver(bank_customers(spark, SF_DIR)).withColumn(
        "Country", F.when(F.col("CreditScore") % 3 > 0, F.col("Country"))), "silver")
    alone = M.gold_wealth_tiers(silver), M.gold_age_groups(silver), M.gold_countries(silver)
    for got, want in zip(M.gold_split(stage_table(M.gold_groups(silver), "gold")), alone):
        assert got.columns == want.columns
        cut = lambda df: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
        assert cut(got) == cut(want)


def test_scorecard_is_one_narrow_scan(spark):
    p = plan(B.rule_scorecard(paysim(spark, SF_DIR)))
    assert p.count("Scan parquet") == 2  # the tree and its details: one scan
    assert "o_orderstatus" not in p and "HashAggregate" in p


def test_all_rules_share_one_scan(spark):
    p = plan(R.score_transactions(R.screened(paysim(spark, SF_DIR))))
    assert p.count("Scan parquet") == 2 and "Exchange" not in p


def test_rules_have_no_python_and_no_single_task(tx):
    for df in (S.rule_structuring(tx), S.rule_velocity(tx), S.rule_layering(tx), exact_median(tx, ["account_id"], "amount"),
               Q.flag_outliers(tx)):
        p = plan(df)
        assert not any(n in p for n in PYTHON_NODES)
        # A single-partition exchange may only carry one total per task.
        body = p.split("===== Subqueries =====")[0]
        assert "SinglePartition" not in body and "CartesianProduct" not in p and "NestedLoop" not in p


def test_structuring_aggregates_before_the_shuffle(tx):
    p = plan(S.rule_velocity(tx))
    assert "Window" not in plan(S.rule_structuring(tx))
    assert "cash_deposit" in plan(S.rule_structuring(tx)) and "PushedFilters" in p


def test_layering_shuffles_rows_once(tx):
    p = plan(S.rule_layering(tx))
    # Heads by (account, slice) twice, reused when run; heads by (account, span) and rows by (account, slice) once.
    assert _exchanges(p) <= 5


def test_undecided_is_an_anti_join(spark, tx):
    p = plan(C.undecided(S.rule_high_risk_geo(tx), decisions(spark, SF_DIR)))
    assert "LeftAnti" in p


def test_history_limits_ranks_before_the_shuffle(tx):
    p = plan(C.account_history(tx, tx.select("account_id")))
    # From the bottom: limit, exchange, limit and window, and only then the selection.
    below = p[p.index("Join"):]
    assert "WindowGroupLimit" in below and below.count("WindowGroupLimit") >= 2


def test_chat_limits_ranks_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(text.chat_context(table(spark, SF_DIR, "conversations")))


def test_dedup_combines_before_the_shuffle(spark):
    p = plan(Q.dedup_first(aml_raw(spark, SF_DIR), "transaction_id", "ingest_no"))
    assert "partial_min_by" in p and "Window" not in p


def test_top_k_and_ratio(spark):
    silver = M.silver(bank_customers(spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(M.top_customers(silver))
    p = plan(P.price_ratio(prices(spark, SF_DIR)))
    assert "Join" not in p and _exchanges(p) == 1


def test_filters_reach_the_scan(spark):
    p = plan(P.date_slice(prices(spark, SF_DIR), "1998-01-01", "2000-12-31"))
    assert re.search(r"PushedFilters: \[.*l_shipdate", p)
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in p


def test_python_only_where_it_is_needed(spark):
    """Chunking, vector search and the tour are the only operators with Python in their tasks."""
    docs = table(spark, SF_DIR, "documents")
    assert "MapInPandas" in plan(text.chunk_recursive(docs))
    assert not any(n in plan(text.chunk_fixed(docs)) for n in PYTHON_NODES)
    for name in ("agg20_monthly_features", "drv3_silver", "agg10_rule_scorecard", "dq4_udf2_parse_ts", "win6_udf3_lags"):
        assert not any(n in plan(QUERIES[name](spark, SF_DIR)) for n in PYTHON_NODES)


def test_outliers_keep_null_accounts_out_of_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("IF(id % 2 = 0, NULL, string(id % 7)) AS account_id", "double(id) AS amount", "string(id) AS transaction_id")
    p = plan(Q.flag_outliers(rows))
    assert "Union" in p and "isnotnull(account_id" in p


def test_message_is_parsed_once(spark):
    from finlake.streaming.events import read_events
    raw = spark.createDataFrame([("{}",)], "value string").repartition(1)
    p = plan(R.score_transactions(read_events(raw)).select(F.col("transaction_id")))
    assert len(re.findall(r"from_json\(", p)) == 1
