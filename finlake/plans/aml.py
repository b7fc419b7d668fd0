"""Cleaning, screening and case-work queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.functions.numeric import portable_round
from finlake.functions.parsing import normalise_code, parse_amount, parse_ts
from finlake.operators import casework as C
from finlake.operators import quality as Q
from finlake.operators import screening as S
from finlake.operators.ordered import exact_median
from finlake.plans.oracle_views import CLEANED, pr, with_views
from finlake.plans.registry import query
from finlake.plans.tables import aml_raw, aml_tx, decisions, ground_truth
from finlake.schemas import RAW_AML, RAW_AML_COLUMNS, assert_schema
from finlake.session import new_path, stage_table
from finlake.sources import sinks
from finlake.sources.readers import read_csv_strings

# The test events are sparser than bank accounts; see FIXTURES.md for the looser parameters.
RULES = {"velocity": {"seconds": 86400, "min_n": 6}, "round_dollar": {"modulus": 100}}


def _stamp(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_TS = "strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts"
_RAW_COLS = ", ".join(f'"{c}"' for c in RAW_AML_COLUMNS)


@query("dq1_dedup_first", with_views(
    f"SELECT {_RAW_COLS}, ingest_no FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_no) AS rn FROM aml_raw) WHERE rn=1",
    "aml_raw"))
def _(spark, d):
    return Q.dedup_first(aml_raw(spark, d), "transaction_id", "ingest_no")


@query("dq2_udf1_parse_amount", with_views(
    r"SELECT ingest_no, TRY_CAST(nullif(regexp_replace(amount,'[^0-9.\-]','','g'),'') AS DOUBLE) AS amount FROM aml_raw", "aml_raw"))
def _(spark, d):
    return aml_raw(spark, d).select("ingest_no", parse_amount("amount").alias("amount"))


@query("dq3_udf4_outliers", with_views(
    """SELECT transaction_id, amount, coalesce(med>0 AND amount>med*8 AND amount>5000, false) AS amount_outlier_flag
    FROM aml_tx JOIN (SELECT account_id, median(amount) AS med FROM aml_tx GROUP BY account_id) USING (account_id)""", "aml_tx"))
def _(spark, d):
    return Q.flag_outliers(aml_tx(spark, d)).select("transaction_id", "amount", "amount_outlier_flag")


@query("dq3_account_median", with_views(
    f"SELECT account_id, {pr('median(amount)', 4)} AS median, count(*) AS n FROM aml_tx GROUP BY account_id", "aml_tx"))
def _(spark, d):
    out = exact_median(aml_tx(spark, d), ["account_id"], "amount")
    return out.withColumn("median", portable_round("median", 4))


def _month_first(col):
    return f"coalesce(try_strptime({col},'%m-%d-%Y %H:%M:%S'), try_strptime({col},'%d-%m-%Y %H:%M:%S'))"


@query("dq4_udf2_parse_ts", with_views(
    f"""SELECT ingest_no, strftime(CASE WHEN "timestamp" LIKE '____-__-__T%' THEN try_strptime("timestamp",'%Y-%m-%dT%H:%M:%S')
      WHEN "timestamp" LIKE '__/%' THEN try_strptime("timestamp",'%m/%d/%Y %H:%M')
      WHEN "timestamp" LIKE '__-%' THEN {_month_first('"timestamp"')}
      ELSE try_strptime("timestamp",'%Y-%m-%d %H:%M:%S') END,'%Y-%m-%d %H:%M:%S') AS ts FROM aml_raw""", "aml_raw"))
def _(spark, d):
    return aml_raw(spark, d).select("ingest_no", parse_ts("timestamp").alias("ts")).withColumn("ts", _stamp())


@query("dq5_normalise_code", with_views("SELECT ingest_no, upper(trim(currency)) AS currency FROM aml_raw", "aml_raw"))
def _(spark, d):
    return aml_raw(spark, d).select("ingest_no", normalise_code("currency").alias("currency"))


@query("dq6_trim_text", with_views(
    """SELECT ingest_no, trim(origin_country) AS origin_country, trim(memo) AS memo,
    (trim(origin_country)<>origin_country)::INTEGER+(trim(memo)<>memo)::INTEGER AS cells FROM aml_raw""", "aml_raw"))
def _(spark, d):
    return Q.trim_text(aml_raw(spark, d), ("origin_country", "memo"), changed="cells").select(
        "ingest_no", "origin_country", "memo", "cells")


@query("dq7_flag_missing", with_views(
    """SELECT ingest_no, CASE WHEN trim(customer_id)='' THEN NULL ELSE customer_id END AS customer_id,
    (customer_id IS NULL OR trim(customer_id)='') AS missing_customer_flag FROM aml_raw""", "aml_raw"))
def _(spark, d):
    return Q.flag_missing(aml_raw(spark, d)).select("ingest_no", "customer_id", "missing_customer_flag")


_REPORT = """SELECT issue_type, n::BIGINT AS count FROM (
  SELECT 'duplicate_transaction_id' AS issue_type, sum(copies-1) AS n FROM aml_tagged
  UNION ALL SELECT 'amount_unparseable', count(*) FILTER (amt IS NULL) FROM aml_tagged
  UNION ALL SELECT 'amount_outlier_flagged', count(*) FILTER (outlier) FROM aml_tagged
  UNION ALL SELECT 'timestamp_unparseable', count(*) FILTER (amt IS NOT NULL AND ts IS NULL) FROM aml_tagged
  UNION ALL SELECT 'currency_normalized', count(*) FILTER (amt IS NOT NULL AND ts IS NOT NULL AND cur<>currency) FROM aml_tagged
  UNION ALL SELECT 'whitespace_trimmed', sum(cells) FILTER (amt IS NOT NULL AND ts IS NOT NULL) FROM aml_tagged
  UNION ALL SELECT 'missing_customer_id', count(*) FILTER (amt IS NOT NULL AND ts IS NOT NULL AND no_cust) FROM aml_tagged
  {summary}) WHERE n>0 OR issue_type LIKE '\\_summary%' ESCAPE '\\'"""
_SUMMARY = """UNION ALL SELECT '_summary.rows_in', sum(copies) FROM aml_tagged
  UNION ALL SELECT '_summary.rows_out', count(*) FILTER (amt IS NOT NULL AND ts IS NOT NULL) FROM aml_tagged
  UNION ALL SELECT '_summary.rows_dropped', sum(copies)-count(*) FILTER (amt IS NOT NULL AND ts IS NOT NULL) FROM aml_tagged"""
_CLEAN = """SELECT transaction_id, account_id, CASE WHEN no_cust THEN NULL ELSE customer_id END AS customer_id,
  strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts, amt AS amount, cur AS currency, trim(transaction_type) AS transaction_type,
  trim(origin_country) AS origin_country, trim(destination_country) AS destination_country, trim(channel) AS channel,
  trim(memo) AS memo, {flags} FROM aml_tagged WHERE amt IS NOT NULL AND ts IS NOT NULL"""


@query("dq8_report", with_views(_REPORT.format(summary=_SUMMARY), "aml_tagged"))
def _(spark, d):
    return Q.dq_report(Q.tag_transactions(aml_raw(spark, d))).drop("detail")


@query("dq9_clean_transactions", with_views(
    _CLEAN.format(flags="no_cust AS missing_customer_flag, outlier AS amount_outlier_flag"), "aml_tagged"))
def _(spark, d):
    clean, _ = Q.clean_transactions(aml_raw(spark, d))
    return clean.withColumn("ts", _stamp())


@query("snk5_dq_log", with_views(
    "SELECT 'batch-1' AS batch_id, issue_type, count FROM (" + _REPORT.format(summary="") + ")", "aml_tagged"))
def _(spark, d):
    report = Q.dq_report(Q.tag_transactions(aml_raw(spark, d)))
    path = new_path(spark, "dq-log")
    for _ in range(2):
        sinks.append_dq_log(report, "batch-1", path)
    return spark.read.parquet(path).select("batch_id", "issue_type", "count")


@query("src2_snk8_csv_strings", with_views(
    "SELECT " + ", ".join(f"CASE WHEN \"{c}\"='' THEN NULL ELSE \"{c}\" END AS \"{c}\"" for c in RAW_AML_COLUMNS) + " FROM aml_raw", "aml_raw"))
def _(spark, d):
    path = new_path(spark, "raw-csv")
    sinks.export_csv(aml_raw(spark, d).select(*RAW_AML_COLUMNS), path)
    return read_csv_strings(spark, path, RAW_AML_COLUMNS)


@query("src8_schema_check", with_views(f"SELECT {_RAW_COLS} FROM aml_raw", "aml_raw"))
def _(spark, d):
    return assert_schema(aml_raw(spark, d), RAW_AML).select(*RAW_AML_COLUMNS)


@query("snk4_upsert", with_views(
    """SELECT transaction_id, amount, ingest_no FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY src DESC, ingest_no DESC) AS rn FROM (
      SELECT transaction_id, amount::VARCHAR AS amount, 0 AS ingest_no, 0 AS src FROM (SELECT transaction_id, format('{:.2f}', amount) AS amount FROM aml_tx)
      UNION ALL SELECT transaction_id, amount, ingest_no, 1 FROM aml_raw WHERE channel='branch')) WHERE rn=1""", "aml_tx", "aml_raw"))
def _(spark, d):
    existing = aml_tx(spark, d).select("transaction_id", F.format_string("%.2f", "amount").alias("amount"),
                                       F.lit(0).cast("bigint").alias("ingest_no"))
    incoming = aml_raw(spark, d).where(F.col("channel") == "branch").select("transaction_id", "amount", "ingest_no")
    return sinks.upsert(existing, incoming, ["transaction_id"], "ingest_no")


@query("win3_structuring", with_views("SELECT * FROM f_structuring", "f_structuring"))
def _(spark, d):
    return S.rule_structuring(aml_tx(spark, d))


@query("win4_velocity", with_views("SELECT * FROM f_velocity", "f_velocity"))
def _(spark, d):
    return S.rule_velocity(aml_tx(spark, d), **RULES["velocity"])


@query("win5_layering", with_views("SELECT * FROM f_layering", "f_layering"))
def _(spark, d):
    return S.rule_layering(aml_tx(spark, d))


@query("rul6_round_dollar", with_views("SELECT * FROM f_round", "f_round"))
def _(spark, d):
    return S.rule_round_dollar(aml_tx(spark, d), **RULES["round_dollar"])


@query("rul7_high_risk_geo", with_views("SELECT * FROM f_geo", "f_geo"))
def _(spark, d):
    return S.rule_high_risk_geo(aml_tx(spark, d))


def _flags(spark, d):
    """Transactions and flags, staged once for the queries that read the flags repeatedly."""
    tx = stage_table(aml_tx(spark, d), "tx")
    return tx, stage_table(S.run_rules(tx, **RULES), "flags")


@query("set3_rul8_rul9_run_rules", with_views("SELECT * FROM flags", "flags"))
def _(spark, d):
    return S.run_rules(stage_table(aml_tx(spark, d), "tx"), **RULES)


@query("set4_flagged_ids", with_views("SELECT DISTINCT transaction_id FROM flags", "flags"))
def _(spark, d):
    return _flags(spark, d)[1].select("transaction_id").distinct()


@query("que1_agg27_review_queue", with_views(
    f"""SELECT t.transaction_id, account_id, customer_id, {_TS}, amount, transaction_type, origin_country, destination_country, channel,
      missing_customer_flag, amount_outlier_flag, string_agg(DISTINCT rule_name, ',' ORDER BY rule_name) AS rules_triggered,
      max(risk_score)::INTEGER AS max_risk_score, count(DISTINCT rule_name) AS n_rules
    FROM aml_tx t JOIN flags f ON t.transaction_id=f.transaction_id
    LEFT JOIN decisions x ON x.transaction_id=t.transaction_id WHERE x.transaction_id IS NULL GROUP BY ALL""",
    "aml_tx", "flags", "decisions"))
def _(spark, d):
    tx, flags = _flags(spark, d)
    return C.review_queue(tx, flags, decisions(spark, d)).withColumn("ts", _stamp())


@query("que2_queue_size", with_views(
    """SELECT count(DISTINCT transaction_id) AS awaiting_review FROM flags
    WHERE transaction_id NOT IN (SELECT transaction_id FROM decisions)""", "flags", "decisions"))
def _(spark, d):
    return C.queue_size(_flags(spark, d)[1], decisions(spark, d))


@query("que3_snk6_record_decisions", with_views("SELECT transaction_id, decision FROM decisions", "decisions"))
def _(spark, d):
    path = new_path(spark, "decisions")
    sinks.record_decisions(decisions(spark, d), path)
    return spark.read.parquet(path).select("transaction_id", "decision")


@query("snk6_refresh_flags", with_views("SELECT * FROM flags", "flags"))
def _(spark, d):
    path = new_path(spark, "flag-table")
    flags = _flags(spark, d)[1]
    for _ in range(2):
        sinks.refresh_flags(flags, path)
    return spark.read.parquet(path).drop("created_at")


@query("joi1_flag_evidence", with_views(
    "SELECT f.transaction_id, rule_name, risk_score, account_id, amount FROM flags f JOIN aml_tx t ON f.transaction_id=t.transaction_id",
    "flags", "aml_tx"))
def _(spark, d):
    tx, flags = _flags(spark, d)
    return C.flag_evidence(tx, flags).select("transaction_id", "rule_name", "risk_score", "account_id", "amount")


@query("joi2_undecided", with_views(
    "SELECT transaction_id, rule_name FROM flags f WHERE NOT EXISTS (SELECT 1 FROM decisions x WHERE x.transaction_id=f.transaction_id)",
    "flags", "decisions"))
def _(spark, d):
    return C.undecided(_flags(spark, d)[1], decisions(spark, d)).select("transaction_id", "rule_name")


@query("joi7_account_history", with_views(
    f"""SELECT account_id, rn::INTEGER AS rn, transaction_id, {_TS}, amount, transaction_type, origin_country, destination_country FROM (
      SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS rn FROM aml_tx
      WHERE account_id IN (SELECT account_id FROM aml_tx t JOIN f_geo f ON t.transaction_id=f.transaction_id)) WHERE rn<=15""",
    "aml_tx", "f_geo"))
def _(spark, d):
    tx = aml_tx(spark, d)
    flagged = tx.join(S.rule_high_risk_geo(tx), "transaction_id", "left_semi")
    return C.account_history(tx, flagged).withColumn("ts", _stamp())


@query("joi8_case_file", with_views(
    f"""SELECT t.transaction_id, account_id, {_TS}, amount, rule_name, rule_detail, risk_score
    FROM aml_tx t LEFT JOIN flags f ON t.transaction_id=f.transaction_id WHERE t.transaction_id IN (SELECT transaction_id FROM decisions)""",
    "aml_tx", "flags", "decisions"))
def _(spark, d):
    tx, flags = _flags(spark, d)
    return C.case_file(tx, flags, decisions(spark, d)).select(
        "transaction_id", "account_id", _stamp(), "amount", "rule_name", "rule_detail", "risk_score")


@query("joi9_orphans", with_views(
    "SELECT transaction_id, rule_name FROM flags WHERE transaction_id NOT IN (SELECT transaction_id FROM decisions)", "flags", "decisions"))
def _(spark, d):
    return C.orphans(_flags(spark, d)[1], decisions(spark, d)).select("transaction_id", "rule_name")


@query("agg23_flags_per_rule", with_views(
    "SELECT rule_name, count(DISTINCT transaction_id) AS n_flagged FROM flags GROUP BY rule_name", "flags"))
def _(spark, d):
    return C.flags_per_rule(_flags(spark, d)[1])


@query("agg25_flag_volume", with_views(
    "SELECT ts::DATE AS day, count(DISTINCT f.transaction_id) AS flagged FROM flags f JOIN aml_tx t ON f.transaction_id=t.transaction_id GROUP BY 1",
    "flags", "aml_tx"))
def _(spark, d):
    tx, flags = _flags(spark, d)
    return C.flag_volume(flags, tx)


@query("agg26_decision_counts", with_views("SELECT decision, count(*) AS n FROM decisions GROUP BY decision", "decisions"))
def _(spark, d):
    return C.decision_counts(decisions(spark, d))


_EVAL = """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, {p} AS precision, {r} AS recall, {f} AS f1 FROM (
  SELECT count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn FROM (
    SELECT coalesce(h, false) AS hit, coalesce(is_fraud=1, false) AS bad
    FROM (SELECT DISTINCT transaction_id, true AS h FROM flags) FULL JOIN ground_truth USING (transaction_id)))"""
_P, _R = "coalesce(tp::DOUBLE/nullif(tp+fp,0),0e0)", "coalesce(tp::DOUBLE/nullif(tp+fn,0),0e0)"


_METRICS = _EVAL.format(p=pr(_P, 6), r=pr(_R, 6), f=pr(f"coalesce(2*{_P}*{_R}/nullif({_P}+{_R},0),0e0)", 6))


@query("evl1_joi4_evaluate", with_views(_METRICS, "flags", "ground_truth"))
def _(spark, d):
    out = C.evaluate(_flags(spark, d)[1], ground_truth(spark, d))
    return out.withColumns({c: portable_round(c, 6) for c in ("precision", "recall", "f1")})


@query("dq4_lenient_layouts", with_views(
    "SELECT transaction_id, date_trunc('minute', ts) AS ts FROM aml_tx", "aml_tx"))
def _(spark, d):
    """Times written with single digits, year-first slashes, month names and AM or PM."""
    layouts = ("M/d/yyyy H:mm", "yyyy/MM/dd HH:mm", "MMM d yyyy HH:mm", "MM/dd/yyyy h:mm a", "MMMM d, yyyy HH:mm", "d MMM yyyy h:mm a")
    tx = aml_tx(spark, d)
    which = F.pmod(F.substring("transaction_id", 4, 20).cast("bigint"), F.lit(len(layouts)))
    written = F.element_at(F.array(*[F.date_format("ts", x) for x in layouts]), which.cast("int") + 1)
    return tx.select("transaction_id", parse_ts(written).alias("ts"))


@query("pip1_screen", with_views(_METRICS, "flags", "ground_truth", instead=CLEANED))
def _(spark, d):
    out = C.screen(aml_raw(spark, d), ground_truth(spark, d), RULES)["metrics"]
    return out.withColumns({c: portable_round(c, 6) for c in ("precision", "recall", "f1")})


@query("fn5_fn6_fn11_dates", with_views(
    """SELECT transaction_id, ts::DATE AS day, date_diff('second', TIMESTAMP '2024-01-01', ts) AS elapsed,
    strftime(ts,'%B %Y') AS label FROM aml_tx""", "aml_tx"))
def _(spark, d):
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return aml_tx(spark, d).select(
        "transaction_id", F.to_date("ts").alias("day"), (F.unix_timestamp("ts") - start).alias("elapsed"),
        F.date_format("ts", "MMMM yyyy").alias("label"))


@query("fn12_fn14_strings", with_views(
    """SELECT ingest_no, upper(trim(currency))||'-'||lower(transaction_type)||'-'||replace(trim(memo),' ','_') AS code,
    TRY_CAST(amount AS DOUBLE) AS amount FROM aml_raw""", "aml_raw"))
def _(spark, d):
    code = F.concat_ws("-", F.upper(F.trim("currency")), F.lower("transaction_type"), F.regexp_replace(F.trim("memo"), " ", "_"))
    return aml_raw(spark, d).select("ingest_no", code.alias("code"), F.col("amount").try_cast("double").alias("amount"))
