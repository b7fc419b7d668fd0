"""DuckDB definitions of the views in ``tables``."""

from __future__ import annotations


def pr(x: str, digits: int = 2) -> str:
    """SQL of ``portable_round``."""
    scaled = f"(abs({x})*1e{digits})"
    return (f"(CASE WHEN {scaled}<4503599627370496e0 THEN sign({x})*floor({scaled}+0.5e0+1e-9+{scaled}*1e-12)/1e{digits}+0e0 "
            f"ELSE ({x})::DOUBLE END)")


def near(sql: str, columns: str, digits: int = 4) -> str:
    """``sql`` with the last digits of computed columns cut, as ``numeric.rounded`` does."""
    return f"SELECT * REPLACE ({', '.join(f'{pr(c, digits)} AS {c}' for c in columns.split())}) FROM ({sql})"


def pct(a: str, b: str, digits: int = 2) -> str:
    return pr(f"(({a})::DOUBLE*100e0/nullif(({b})::DOUBLE,0))", digits)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["paysim"] = ((), f"""
SELECT o_orderkey::VARCHAR AS transaction_id,
  (date_diff('day', DATE '1995-01-01', o_orderdate::DATE)*24)::INTEGER AS step_hour,
  CASE left(o_orderpriority,1) WHEN '1' THEN 'TRANSFER' WHEN '2' THEN 'CASH_OUT' WHEN '3' THEN 'PAYMENT'
    WHEN '4' THEN 'DEBIT' WHEN '5' THEN 'CASH_IN' END AS transaction_type,
  o_totalprice AS amount, 'C'||o_custkey::VARCHAR AS account_origin,
  CASE WHEN o_orderkey%7=0 THEN o_totalprice ELSE {pr('(o_totalprice*3)')} END AS balance_orig_before,
  CASE WHEN o_orderkey%7=0 THEN 0e0 WHEN o_orderkey%11=0 THEN {pr('(o_totalprice*3-o_totalprice-150)')}
    ELSE {pr('(o_totalprice*3-o_totalprice)')} END AS balance_orig_after,
  'M'||(o_orderkey%1000)::VARCHAR AS account_dest, 0e0 AS balance_dest_before, o_totalprice AS balance_dest_after,
  (o_orderkey%7=0 OR o_orderkey%11=0 OR o_orderkey%101=0)::INTEGER AS is_fraud,
  (o_orderkey%77=0)::INTEGER AS is_flagged_by_system,
  strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS "timestamp", NULL::VARCHAR AS fraud_rule_triggered
FROM orders""")

_TYPE = """CASE event_type WHEN 'signup' THEN 'cash_deposit' WHEN 'error' THEN 'wire' WHEN 'purchase' THEN 'transfer'
  WHEN 'click' THEN 'card' WHEN 'view' THEN 'ach' END"""
_K = "CAST(json_extract_string(props,'$.k') AS INTEGER)"

VIEWS["aml_tx"] = ((), f"""
SELECT 'TXN'||event_id::VARCHAR AS transaction_id, 'ACC'||user_id::VARCHAR AS account_id,
  'CUST'||user_id::VARCHAR AS customer_id, date_trunc('second', ts) AS ts, {pr('(value*100)')} AS amount,
  'USD' AS currency, {_TYPE} AS transaction_type,
  CASE WHEN event_id%97=0 THEN 'XA' ELSE 'US' END AS origin_country,
  CASE WHEN event_id%89=0 THEN 'XB' ELSE 'CA' END AS destination_country,
  CASE WHEN {_K}<50 THEN 'online' ELSE 'branch' END AS channel, 'memo '||{_K}::VARCHAR AS memo,
  0::INTEGER AS missing_customer_flag, 0::INTEGER AS amount_outlier_flag
FROM events""")

VIEWS["aml_raw"] = ((), f"""
SELECT 'TXN'||event_id::VARCHAR AS transaction_id, 'ACC'||user_id::VARCHAR AS account_id,
  CASE WHEN event_id%33=0 THEN '' ELSE 'CUST'||user_id::VARCHAR END AS customer_id,
  CASE WHEN k=99 THEN 'not a date' WHEN event_id%4=0 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S')
    WHEN event_id%4=1 THEN strftime(ts,'%m/%d/%Y %H:%M') WHEN event_id%4=2 THEN strftime(ts,'%d-%m-%Y %H:%M:%S')
    ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS "timestamp",
  CASE WHEN event_id%17=0 THEN '$'||format('{{:,.2f}}', amt) WHEN event_id%211=0 THEN 'abc'
    ELSE format('{{:.2f}}', amt) END AS amount,
  CASE event_id%20 WHEN 0 THEN 'usd' WHEN 1 THEN 'Usd' WHEN 2 THEN 'USD ' ELSE 'USD' END AS currency,
  {_TYPE} AS transaction_type,
  CASE WHEN event_id%25=0 THEN '  ' ELSE '' END||CASE WHEN event_id%97=0 THEN 'XA' ELSE 'US' END AS origin_country,
  CASE WHEN event_id%89=0 THEN 'XB' ELSE 'CA' END AS destination_country,
  CASE WHEN k<50 THEN 'online' ELSE 'branch' END AS channel,
  CASE WHEN event_id%25=0 THEN '  memo '||k::VARCHAR||'  ' ELSE 'memo '||k::VARCHAR END AS memo,
  event_id*2+c AS ingest_no
FROM (SELECT *, {pr('(value*100)')}+c AS amt FROM (
  SELECT *, {_K} AS k, unnest(CASE WHEN {_K}<2 THEN [0,1] ELSE [0] END) AS c FROM events))""")

# Cleaning of aml_raw: first copy, parsed values, account median, markers.
VIEWS["aml_tagged"] = (("aml_raw",), r"""
SELECT p.*, coalesce(med>0 AND amt>med*8 AND amt>5000, false) AS outlier,
  upper(trim(currency)) AS cur, (customer_id IS NULL OR trim(customer_id)='') AS no_cust,
  (trim(origin_country)<>origin_country)::INT+(trim(destination_country)<>destination_country)::INT
  +(trim(memo)<>memo)::INT+(trim(channel)<>channel)::INT+(trim(transaction_type)<>transaction_type)::INT AS cells
FROM (
  SELECT *, TRY_CAST(nullif(regexp_replace(amount,'[^0-9.\-]','','g'),'') AS DOUBLE) AS amt,
    CASE WHEN "timestamp" LIKE '____-__-__T%' THEN try_strptime("timestamp",'%Y-%m-%dT%H:%M:%S')
      WHEN "timestamp" LIKE '__/%' THEN try_strptime("timestamp",'%m/%d/%Y %H:%M')
      WHEN "timestamp" LIKE '__-%' THEN coalesce(try_strptime("timestamp",'%m-%d-%Y %H:%M:%S'), try_strptime("timestamp",'%d-%m-%Y %H:%M:%S'))
      ELSE try_strptime("timestamp",'%Y-%m-%d %H:%M:%S') END AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_no) AS rn,
    count(*) OVER (PARTITION BY transaction_id) AS copies FROM aml_raw) WHERE rn=1) p
LEFT JOIN (SELECT account_id, median(TRY_CAST(nullif(regexp_replace(amount,'[^0-9.\-]','','g'),'') AS DOUBLE)) AS med
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_no) AS rn FROM aml_raw) WHERE rn=1
  GROUP BY account_id) m USING (account_id)""")

VIEWS["ground_truth"] = ((), """
SELECT 'TXN'||event_id::VARCHAR AS transaction_id, (event_id%13=0)::INTEGER AS is_fraud,
  CASE WHEN event_id%13=0 THEN 'planted' ELSE 'none' END AS pattern FROM events""")

VIEWS["decisions"] = ((), f"""
SELECT 'TXN'||event_id::VARCHAR AS transaction_id,
  CASE {_K}%3 WHEN 0 THEN 'cleared' WHEN 1 THEN 'escalated' ELSE 'confirmed_sar' END AS decision
FROM events WHERE {_K}>=80""")

# Rule hits on aml_tx with the parameters of the registered queries.
VIEWS["f_structuring"] = (("aml_tx",), """
SELECT transaction_id, 'structuring' AS rule_name,
  n::VARCHAR||' cash deposits on '||strftime(day,'%Y-%m-%d')||' for account '||account_id||' totalling $'||format('{:,.2f}', total)
    ||', each under the $10,000 reporting limit' AS rule_detail, 3::INTEGER AS risk_score
FROM (SELECT transaction_id, account_id, ts::DATE AS day,
    (sum(CAST(amount AS DECIMAL(18,2))) OVER (PARTITION BY account_id, ts::DATE))::DOUBLE AS total,
    count(*) OVER (PARTITION BY account_id, ts::DATE) AS n
  FROM aml_tx WHERE transaction_type='cash_deposit' AND amount<10000) WHERE total>=10000 AND n>=2""")
VIEWS["f_velocity"] = (("aml_tx",), """
SELECT transaction_id, 'velocity' AS rule_name,
  n::VARCHAR||' transactions of account '||account_id||' within 86400 seconds' AS rule_detail, 2::INTEGER AS risk_score
FROM (SELECT transaction_id, account_id, count(*) OVER (PARTITION BY account_id ORDER BY ts
    RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n FROM aml_tx) WHERE n>=6""")
VIEWS["f_round"] = (("aml_tx",), """
SELECT transaction_id, 'round_dollar' AS rule_name,
  'Round '||transaction_type||' of $'||format('{:,.2f}', amount) AS rule_detail, 1::INTEGER AS risk_score
FROM aml_tx WHERE transaction_type IN ('wire','transfer') AND amount>=5000 AND amount%100=0""")
VIEWS["f_geo"] = (("aml_tx",), """
SELECT transaction_id, 'high_risk_geo' AS rule_name,
  'High-risk corridor '||origin_country||' to '||destination_country AS rule_detail, 3::INTEGER AS risk_score
FROM aml_tx WHERE origin_country IN ('XA','XB','XC') OR destination_country IN ('XA','XB','XC')""")
VIEWS["f_layering"] = (("aml_tx",), f"""
SELECT unnest([transaction_id, next_id]) AS transaction_id, 'layering' AS rule_name,
  '$'||format('{{:,.2f}}', amount)||' in, $'||format('{{:,.2f}}', next_amount)||' out after '
    ||{pr('(gap/3600e0)', 1)}::VARCHAR||'h (account '||account_id||')' AS rule_detail, 3::INTEGER AS risk_score
FROM (SELECT *, date_diff('second', ts, next_ts) AS gap FROM (
  SELECT *, lead(transaction_id) OVER w AS next_id, lead(transaction_type) OVER w AS next_type,
    lead(amount) OVER w AS next_amount, lead(ts) OVER w AS next_ts
  FROM aml_tx WHERE transaction_type IN ('wire','cash_deposit','transfer','ach','cash_withdrawal')
  WINDOW w AS (PARTITION BY account_id ORDER BY ts, transaction_id)))
WHERE transaction_type IN ('wire','cash_deposit') AND next_type IN ('transfer','wire','cash_withdrawal')
  AND gap BETWEEN 0 AND 10800 AND amount>0 AND amount>=3000 AND abs(next_amount-amount)/amount<0.08""")
VIEWS["flags"] = (("f_structuring", "f_velocity", "f_round", "f_geo", "f_layering"), """
SELECT * FROM f_structuring UNION ALL SELECT * FROM f_velocity UNION ALL SELECT * FROM f_round
UNION ALL SELECT * FROM f_geo UNION ALL SELECT * FROM f_layering""")

VIEWS["bank_marketing"] = ((), """
SELECT c_custkey AS custkey, (18+c_custkey%60)::INTEGER AS age, c_mktsegment AS job,
  (CASE WHEN c_custkey%4<>0 THEN 999 ELSE c_custkey%30 END)::INTEGER AS pdays,
  CASE WHEN c_acctbal>7000 THEN 'yes' ELSE 'no' END AS y FROM customer""")
VIEWS["spend"] = ((), f"SELECT o_custkey, {pr('sum(o_totalprice)')} AS spend FROM orders GROUP BY o_custkey")
VIEWS["credit_cards"] = (("spend",), f"""
SELECT 'C'||c_custkey::VARCHAR AS cust_id, c_acctbal AS balance, coalesce(spend,0e0) AS purchases,
  (c_custkey%5)*10e0 AS cash_advance,
  CASE WHEN c_custkey%50=0 THEN 0e0 ELSE 1000e0+500e0*(c_custkey%30) END AS credit_limit,
  {pr('(coalesce(spend,0e0)*(c_custkey%3)*0.75e0)')} AS payments, (c_custkey%10)/10e0 AS prc_full_payment,
  (6+c_custkey%7)::INTEGER AS tenure
FROM customer LEFT JOIN spend ON c_custkey=o_custkey""")
VIEWS["cards"] = (("credit_cards",), f"""
SELECT cust_id, balance, purchases, cash_advance, credit_limit, tenure,
  {pr('(balance/nullif(credit_limit,0e0))', 3)} AS util_ratio,
  {pr('(balance*0.8e0+purchases*0.015e0)')} AS annual_profit, prc_full_payment FROM credit_cards""")

_BITS = ", ".join(f'((c_custkey>>{i})&1)::INTEGER AS "{n}"' for i, n in enumerate(
    ("EmergingMarketFund", "RealEstate", "PrivateEquity", "GovtBonds", "CorpBonds", "ETF Tech", "ETF Health", "ETF Med")))
VIEWS["bank_customers"] = (("spend",), f"""
SELECT c_custkey AS "RowNumber", c_custkey AS "CustomerID", c_name AS "Surname", r_name AS "Country",
  (18+c_custkey%60)::INTEGER AS "Age", (350+(c_custkey*37)%500)::INTEGER AS "CreditScore",
  (20000+c_custkey*13%90000)::DOUBLE AS "EstimatedSalary", greatest(0e0, 2000e0-c_acctbal) AS "Debt",
  {pr('(coalesce(spend,0e0)/CASE c_custkey%4 WHEN 0 THEN 8e0 WHEN 1 THEN 20e0 WHEN 2 THEN 60e0 ELSE 400e0 END)')} AS "Net Assets",
  -0.05e0+(c_custkey%41)*0.01e0 AS "Portfolio Return", (c_custkey%5)*0.25e0 AS "Risk Profile",
  (c_custkey%13*1000)::DOUBLE AS "ForeignAssets", (c_custkey%11)*0.1e0 AS "Diversification",
  (c_custkey%4+1)::INTEGER AS "NumProducts", (c_custkey%5=0)::INTEGER AS "Churn", {_BITS}
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
LEFT JOIN spend ON c_custkey=o_custkey""")
VIEWS["silver"] = (("bank_customers",), """
SELECT * EXCLUDE ("RowNumber","Surname","ETF Tech","ETF Health","ETF Med","Risk Profile","Net Assets","Portfolio Return"),
  "ETF Tech" AS "ETF_Tech", "ETF Health" AS "ETF_Health", "ETF Med" AS "ETF_Med", "Risk Profile" AS "Risk_Profile",
  "Net Assets" AS "Net_Assets", "Portfolio Return" AS "Portfolio_Return",
  CASE WHEN "Net Assets">=500000 THEN 'Ultra High Net Worth' WHEN "Net Assets">=100000 THEN 'High Net Worth'
    WHEN "Net Assets">=50000 THEN 'Affluent' WHEN "Net Assets">=10000 THEN 'Mass Market' ELSE 'Low Wealth' END AS "WealthTier",
  CASE WHEN "Age"<30 THEN 'Under 30' WHEN "Age"<40 THEN '30s' WHEN "Age"<50 THEN '40s' WHEN "Age"<60 THEN '50s' ELSE '60+' END AS "AgeGroup",
  CASE WHEN "CreditScore">=800 THEN 'Excellent' WHEN "CreditScore">=700 THEN 'Good' WHEN "CreditScore">=600 THEN 'Fair' ELSE 'Poor' END AS "CreditBand",
  "EmergingMarketFund"+"RealEstate"+"PrivateEquity"+"GovtBonds"+"CorpBonds"+"ETF Tech"+"ETF Health"+"ETF Med" AS "InvestmentCount",
  CASE WHEN "Debt">0 THEN "EstimatedSalary"/"Debt" END AS "SalaryToDebtRatio"
FROM bank_customers WHERE "Age">0 AND "EstimatedSalary">0 AND "CreditScore">0""")

VIEWS["gold_tiers"] = (("silver",), f"""
SELECT "WealthTier", count(*) AS total_customers, avg("Net_Assets") AS avg_net_assets,
  avg("Portfolio_Return") AS avg_portfolio_return, avg("CreditScore") AS avg_credit_score,
  avg("InvestmentCount") AS avg_investments_held, avg("EstimatedSalary") AS avg_salary,
  sum("Churn")::BIGINT AS total_churned, avg("Diversification") AS avg_diversification
FROM silver GROUP BY "WealthTier" """)
VIEWS["gold_ages"] = (("silver",), f"""
SELECT "AgeGroup", count(*) AS total_customers, avg("Net_Assets") AS avg_net_assets,
  avg("Portfolio_Return") AS avg_return, avg("InvestmentCount") AS avg_investments,
  avg("Risk_Profile") AS avg_risk_profile, avg("ForeignAssets") AS avg_foreign_assets,
  sum("Churn")::BIGINT AS total_churned
FROM silver GROUP BY "AgeGroup" """)
VIEWS["gold_countries"] = (("silver",), f"""
SELECT "Country", "WealthTier", count(*) AS total_customers, avg("Net_Assets") AS avg_net_assets,
  avg("Portfolio_Return") AS avg_return, avg("CreditScore") AS avg_credit_score,
  avg("NumProducts") AS avg_products_held, sum("Churn")::BIGINT AS total_churned,
  avg("EstimatedSalary") AS avg_salary
FROM silver GROUP BY "Country", "WealthTier" """)

VIEWS["billing"] = ((), """
SELECT CASE WHEN l_quantity=50 THEN '31/02/2000' ELSE strftime(l_shipdate,'%d/%m/%Y') END AS worked, c_name AS customer,
  CASE WHEN p_size<=45 THEN p_brand END AS project, CASE WHEN l_discount<0.1e0 THEN l_extendedprice END AS price,
  l_quantity AS hours, l_extendedprice/l_quantity AS rate
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey""")
VIEWS["billing_clean"] = (("billing",), """
SELECT try_strptime(worked,'%d/%m/%Y')::DATE AS day, customer, coalesce(project,'Unknown') AS project, price, hours, rate
FROM billing WHERE try_strptime(worked,'%d/%m/%Y') IS NOT NULL AND customer IS NOT NULL AND price IS NOT NULL""")
VIEWS["monthly"] = (("billing_clean",), f"""
SELECT customer, date_trunc('month', day)::DATE AS year_month, coalesce(sum(price),0e0) AS revenue_sum,
  avg(price) AS revenue_mean, coalesce(stddev_samp(price),0e0) AS revenue_std,
  coalesce(sum(hours),0e0) AS hours_sum, avg(rate) AS billingrate_mean,
  count(DISTINCT project) AS project_count, month(date_trunc('month', day))::INTEGER AS month,
  quarter(date_trunc('month', day))::INTEGER AS quarter
FROM billing_clean GROUP BY customer, date_trunc('month', day)""")
VIEWS["lagged"] = (("monthly",), """
SELECT * FROM (SELECT *, lag(revenue_sum,1) OVER w AS revenue_lag_1, lag(revenue_sum,2) OVER w AS revenue_lag_2,
  lag(revenue_sum,3) OVER w AS revenue_lag_3 FROM monthly WINDOW w AS (PARTITION BY customer ORDER BY year_month))
WHERE revenue_lag_3 IS NOT NULL AND billingrate_mean IS NOT NULL""")

VIEWS["prices"] = ((), """
SELECT l_shipdate::DATE AS date, l_extendedprice AS price, CASE WHEN l_returnflag='A' THEN 'Gold'
  WHEN l_returnflag='R' AND l_shipdate::DATE<DATE '2001-09-01' THEN 'Silver' ELSE 'Platinum' END AS metal
FROM lineitem""")
VIEWS["yearly"] = (("prices",), f"""
SELECT metal, year(date)::INTEGER AS year, {pr('avg(price)')} AS avg_price FROM prices GROUP BY metal, year(date)""")
VIEWS["price_months"] = (("prices",), f"""
SELECT date_trunc('month', date)::DATE AS month, avg(CASE WHEN metal='Gold' THEN price END) AS g,
  avg(CASE WHEN metal='Silver' THEN price END) AS s FROM prices GROUP BY 1""")
VIEWS["price_ratio"] = (("price_months",), f"""
SELECT month, {pr('g')} AS gold, {pr('s')} AS silver, {pr('(g/nullif(s,0e0))', 4)} AS ratio FROM price_months""")

VIEWS["crimes"] = ((), f"""
SELECT vec_id AS crime_id, label, 'TYPE_'||label::VARCHAR AS type, (vec_id%3+2022)::INTEGER AS y, (vec_id%12+1)::INTEGER AS m,
  (vec_id%31+1)::INTEGER AS d, (vec_id%24)::INTEGER AS h, (vec_id%60)::INTEGER AS mi,
  'DISTRICT_'||(vec_id%5)::VARCHAR AS district,
  CASE WHEN vec_id%29<>0 THEN 491000e0+{pr('(embedding[1]::DOUBLE*50000)')} END AS gx,
  5455000e0+{pr('(embedding[2]::DOUBLE*50000)')} AS gy FROM embeddings""")
VIEWS["edges"] = ((), """
SELECT o_custkey AS src, (o_orderkey*7+3)%((SELECT count(*) FROM customer)*4//3) AS dst, o_totalprice/1000 AS length FROM orders""")
VIEWS["roads"] = (("edges",), "SELECT src, dst, min(length) AS length FROM edges WHERE src<>dst GROUP BY src, dst")
VIEWS["nodes"] = (("edges",), """
SELECT id, 49.2e0+(id%100)*0.001e0 AS lat, -123.13e0+(id//100)*0.001e0 AS lon
FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""")


#: The clean rows of the messy export, in place of the transactions that are clean from the start.
CLEANED = {"aml_tx": (("aml_tagged",), """
SELECT transaction_id, account_id, ts, amt AS amount, trim(transaction_type) AS transaction_type,
  trim(origin_country) AS origin_country, trim(destination_country) AS destination_country
FROM aml_tagged WHERE amt IS NOT NULL AND ts IS NOT NULL""")}


def with_views(body: str, *names: str, recursive: str = "", instead: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``body`` preceded by the definitions of the named views and what they need; ``instead`` replaces some of them."""
    ordered: list[str] = []
    views = VIEWS | (instead or {})

    def need(name: str) -> None:
        for dep in views[name][0]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    ctes = [f"{n} AS ({views[n][1].strip()})" for n in ordered]
    if recursive:
        ctes.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body.strip()}"
