"""Cleaning of raw transaction exports with a data-quality report.

Order matters: duplicates, amount, outlier, timestamp, currency, text,
customer. Every step only adds a marker to the row, so the report is a single
aggregate over the marked rows instead of one pass per issue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.parsing import normalise_code, parse_amount, parse_ts, squash
from finlake.operators.ordered import exact_median
from finlake.operators.skew import attach
from finlake.schemas import RAW_AML, RAW_AML_COLUMNS, assert_schema
from finlake.session import stage_table

TEXT_COLUMNS = ("origin_country", "destination_country", "memo", "channel", "transaction_type")

# Issue names of the report, with our descriptions.
ISSUES = (
    ("duplicate_transaction_id", "Repeated transaction_id; the first row in file order was kept."),
    ("amount_unparseable", "Amount is not a number; row dropped."),
    ("amount_outlier_flagged", "Amount far above the median of its account; row kept and flagged."),
    ("timestamp_unparseable", "Timestamp has no known layout; row dropped."),
    ("currency_normalized", "Currency code re-cased or trimmed."),
    ("whitespace_trimmed", "Text cells with surrounding white space."),
    ("missing_customer_id", "Customer unknown; row kept and flagged."),
)
SUMMARY = ("rows_in", "rows_out", "rows_dropped")


def dedup_first(df: DataFrame, key: str, order: str, count: str | None = None) -> DataFrame:
    """First row per ``key`` by the ingest ordinal ``order``; null keys are one group.

    Written as an aggregate and not as a window: copies of one key combine
    map-side, so a key repeated a billion times never reaches one task.
    ``count`` names an optional column with the number of copies.
    """
    rest = [c for c in df.columns if c != key]
    aggs = [F.min_by(F.struct(*rest), F.col(order)).alias("_first")]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    picked = df.groupBy(key).agg(*aggs)
    return picked.select(
        *[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns], *([count] if count else [])
    )


def flag_outliers(df: DataFrame, mult: float = 8.0, floor: float = 5000.0, account: str = "account_id",
                  amount: str = "amount") -> DataFrame:
    """Add ``amount_outlier_flag``: above ``mult`` medians of the account and above ``floor``.

    The median is exact and interpolated over all rows with an amount.
    """
    medians = exact_median(df, [account], amount, "_median")
    joined = attach(df, medians.drop("n"), [account], how="left")
    test = (F.col("_median") > 0) & (F.col(amount) > F.col("_median") * mult) & (F.col(amount) > floor)
    return joined.withColumn("amount_outlier_flag", F.coalesce(test, F.lit(False))).drop("_median")


def trim_text(df: DataFrame, cols: Sequence[str] = TEXT_COLUMNS, changed: str | None = None) -> DataFrame:
    """Strip white space from ``cols``; ``changed`` counts the altered cells of a row."""
    trimmed = {c: squash(c) for c in cols}
    if changed:
        cells = [F.coalesce((trimmed[c] != F.col(c)).cast("int"), F.lit(0)) for c in cols]
        df = df.withColumn(changed, sum(cells[1:], cells[0]))
    return df.withColumns(trimmed)


def flag_missing(df: DataFrame, col: str = "customer_id", flag: str = "missing_customer_flag") -> DataFrame:
    """Blank becomes null and is flagged."""
    missing = F.col(col).isNull() | (squash(col) == "")
    return df.withColumn(flag, missing).withColumn(col, F.when(~F.col(flag), F.col(col)))


def tag_transactions(raw: DataFrame, order: str = "ingest_no", mult: float = 8.0, floor: float = 5000.0,
                     day_first: bool = False, stage: bool = True) -> DataFrame:
    """One row per transaction_id with cleaned columns and issue markers.

    Markers: ``_copies``, ``_bad_amount``, ``_bad_ts``, ``_currency_fixed``,
    ``_cells_trimmed``. With ``stage`` the deduplicated rows are written once
    to the shared folder, because the medians and the rows both read them.
    """
    assert_schema(raw, RAW_AML)
    firsts = dedup_first(raw.select(*RAW_AML_COLUMNS, order), "transaction_id", order, count="_copies").drop(order)
    parsed = firsts.withColumns({"amount": parse_amount("amount"), "ts": parse_ts("timestamp", day_first)}).drop("timestamp")
    if stage:
        parsed = stage_table(parsed, "transactions")
    code = normalise_code("currency")
    flagged = flag_outliers(parsed, mult, floor)
    marked = flagged.withColumns({
        "_bad_amount": F.col("amount").isNull(),
        "_bad_ts": F.col("amount").isNotNull() & F.col("ts").isNull(),
        "_currency_fixed": F.coalesce(code != F.col("currency"), F.lit(False)),
        "currency": code,
    })
    return flag_missing(trim_text(marked, changed="_cells_trimmed"))


def _alive() -> Column:
    return F.col("amount").isNotNull() & F.col("ts").isNotNull()


def clean_rows(tagged: DataFrame) -> DataFrame:
    """The rows that survive, in the layout of the transactions table."""
    return tagged.where(_alive()).select(
        "transaction_id", "account_id", "customer_id", "ts", "amount", "currency", "transaction_type",
        "origin_country", "destination_country", "channel", "memo", "missing_customer_flag", "amount_outlier_flag",
    )


def dq_report(tagged: DataFrame) -> DataFrame:
    """Long report (issue_type, count, detail): non-zero issues and the summary rows.

    Each issue counts the rows alive when its step runs.
    """
    alive = _alive()
    counts = tagged.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_transaction_id"),
        F.count_if("_bad_amount").alias("amount_unparseable"),
        F.count_if(F.col("amount_outlier_flag")).alias("amount_outlier_flagged"),
        F.count_if("_bad_ts").alias("timestamp_unparseable"),
        F.count_if(alive & F.col("_currency_fixed")).alias("currency_normalized"),
        F.coalesce(F.sum(F.when(alive, F.col("_cells_trimmed")).otherwise(0)), F.lit(0)).alias("whitespace_trimmed"),
        F.count_if(alive & F.col("missing_customer_flag")).alias("missing_customer_id"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_in"),
        F.count_if(alive).alias("rows_out"),
    ).withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))
    entries = [
        F.struct(F.lit(name).alias("issue_type"), F.col(name).cast("bigint").alias("count"), F.lit(text).alias("detail"))
        for name, text in ISSUES
    ] + [
        F.struct(F.lit(f"_summary.{name}").alias("issue_type"), F.col(name).cast("bigint").alias("count"),
                 F.lit("").alias("detail"))
        for name in SUMMARY
    ]
    return (
        counts.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where((F.col("count") > 0) | F.col("issue_type").startswith("_summary"))
    )


def clean_transactions(raw: DataFrame, order: str = "ingest_no", **options) -> tuple[DataFrame, DataFrame]:
    """Clean rows and report from one marked input."""
    tagged = tag_transactions(raw, order, **options)
    return clean_rows(tagged), dq_report(tagged)
