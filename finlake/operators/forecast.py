"""Monthly revenue features, chronological split, boosted trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.functions.parsing import parse_date
from finlake.operators import boosting

# Model features and search grid.
FEATURES = (
    "revenue_lag_1", "revenue_lag_2", "revenue_lag_3", "revenue_mean", "revenue_std", "hours_sum",
    "billingrate_mean", "project_count", "month", "quarter",
)
GRID = {"n_estimators": (50, 100), "max_depth": (3, 5), "learning_rate": (0.05, 0.1)}
LABEL = "revenue_sum"


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding white space."""
    return df.toDF(*[c.strip() for c in df.columns])


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def billing_clean(df: DataFrame) -> DataFrame:
    """Stripped names, default project, parsed dates, rows without date, customer or price dropped."""
    # Each column by itself: a filter on one column can go below the joins that bring the others.
    named = strip_names(df)
    for c in ("Extended Price", "Customer Name"):
        named = require(named, [c])
    if dict(named.dtypes)["Worked Date"] == "string":
        # Behind explode a text is read once a line; a filter on the date itself would read it a second time.
        named = named.withColumn("Worked Date", F.explode(F.array(parse_date("Worked Date"))))
    else:
        named = named.withColumn("Worked Date", F.to_date("Worked Date"))
    return require(named.fillna({"Project": "Unknown"}), ["Worked Date"])


def monthly_features(df: DataFrame) -> DataFrame:
    """One row per customer and month. A single line has deviation zero; missing values do not enter means.

    Lines are shuffled once, as they are, by (customer, month): what is known of
    a group's sums takes more room than its few lines, and distinct projects
    would be shuffled twice. A customer is spread over its months, and a group
    passes in a stream.
    """
    lines = df.select(
        F.col("Customer Name").alias("customer"),
        F.trunc("Worked Date", "MM").alias("year_month"),
        F.col("Extended Price").alias("price"),
        F.col("Billable Hours").alias("hours"),
        F.col("Hourly Billing Rate").alias("rate"),
        F.col("Project").alias("project"),
    ).repartition("customer", "year_month")
    return (
        lines.groupBy("customer", "year_month")
        .agg(
            F.coalesce(F.sum("price"), F.lit(0.0)).alias("revenue_sum"),
            F.avg("price").alias("revenue_mean"),
            F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("revenue_std"),
            F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours_sum"),
            F.avg("rate").alias("billingrate_mean"),
            F.countDistinct("project").alias("project_count"),
        )
        .withColumns({"month": F.month("year_month"), "quarter": F.quarter("year_month")})
    )


def add_lags(df: DataFrame, n: int = 3, calendar: bool = False) -> DataFrame:
    """Revenue of the ``n`` previous months of the customer; incomplete rows are dropped.

    By default the previous months are the ones on record. With ``calendar``
    they are calendar months and a gap makes the row incomplete. A customer
    has one row per month, so the window group is bounded by the calendar.
    """
    w = Window.partitionBy("customer").orderBy("year_month")
    out = df
    for i in range(1, n + 1):
        value = F.lag("revenue_sum", i).over(w)
        if calendar:
            value = F.when(F.lag("year_month", i).over(w) == F.add_months("year_month", -i), value)
        out = out.withColumn(f"revenue_lag_{i}", value)
    return out.dropna()


def latest_per(df: DataFrame, key: str = "customer", order: str = "year_month") -> DataFrame:
    """The last row of each key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(key, "_last.*")


def chrono_split(df: DataFrame, holdout: int = 2, col: str = "year_month") -> tuple[DataFrame, DataFrame]:
    """Train before, test from the ``holdout``-th last month present on."""
    cut = df.select(col).distinct().orderBy(F.desc(col)).limit(holdout).agg(F.min(col)).scalar()
    return df.where(F.col(col) < cut), df.where(F.col(col) >= cut)


def fit_revenue(train: DataFrame, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1) -> boosting.Model:
    """Gradient-boosted trees on the ten features."""
    return boosting.fit(train, FEATURES, LABEL, n_estimators, [(0, max_depth, learning_rate)])[0]


def predict(model: boosting.Model, df: DataFrame) -> DataFrame:
    return boosting.predict(model, df, FEATURES)


def _fold_bounds(df: DataFrame, folds: int, col: str) -> list[tuple]:
    """First and last month that each fold validates on."""
    months = [r[0] for r in df.select(col).distinct().orderBy(col).collect()]
    block = len(months) // (folds + 1)
    if block == 0:
        raise ValueError(f"{len(months)} months cannot be cut into {folds} expanding folds")
    first = len(months) - folds * block
    return [(months[first + i * block], months[first + (i + 1) * block - 1]) for i in range(folds)]


def expanding_folds(df: DataFrame, folds: int = 3, col: str = "year_month") -> list[tuple[DataFrame, DataFrame]]:
    """Folds over months: fold i trains on the first i blocks and validates on the next one.

    Cutting by month keeps a customer's future out of the training part. The
    month list is bounded by the calendar, so it may live on the driver.
    """
    return [(df.where(F.col(col) < lo), df.where(F.col(col).between(lo, hi))) for lo, hi in _fold_bounds(df, folds, col)]


def time_series_cv(df: DataFrame, grid: dict[str, Sequence] | None = None, folds: int = 3, col: str = "year_month") -> DataFrame:
    """Mean validation RMSE per grid point, best first.

    A boosted model contains all its shorter prefixes, so only the largest
    ``n_estimators`` is fitted and the others are read off it. The models of
    all folds and grid points grow side by side over one table.
    """
    grid = grid or GRID
    sizes = sorted(grid["n_estimators"])
    # Fold i trains on the parts up to i and validates on the next one.
    part = F.lit(0)
    for i, (lo, _) in enumerate(_fold_bounds(df, folds, col), 1):
        part = F.when(F.col(col) >= lo, F.lit(i)).otherwise(part)
    shapes = [(fold, depth, step) for fold in range(folds) for depth, step in product(grid["max_depth"], grid["learning_rate"])]
    models = boosting.fit(df, FEATURES, LABEL, sizes[-1], shapes, part)
    scores: dict[tuple, list[float]] = {}
    for r in boosting.losses(models, sizes, df, FEATURES, LABEL, part).orderBy("model", "size").collect():
        scores.setdefault((r["size"], *shapes[r["model"]][1:]), []).append(math.sqrt(r["mse"]))
    rows = [(int(n), int(d), float(s), sum(v) / len(v)) for (n, d, s), v in scores.items()]
    schema = "n_estimators int, max_depth int, learning_rate double, rmse double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy("rmse", "n_estimators", "max_depth", "learning_rate")


def fit_best(df: DataFrame, grid: dict[str, Sequence] | None = None, folds: int = 3) -> tuple[boosting.Model, DataFrame]:
    """Search the grid by expanding folds, then fit all of ``df`` with the best point; the model and the scores."""
    scores = time_series_cv(df, grid, folds)
    best = scores.first()
    return fit_revenue(df, best["n_estimators"], best["max_depth"], best["learning_rate"]), scores


def score_forecast(preds: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """RMSE and R2 from sums of one pass; R2 is null when the label is constant."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return preds.agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_var")
    ).select("n", F.sqrt("_mse").alias("rmse"), (F.lit(1.0) - F.try_divide("_mse", "_var")).alias("r2"))


def next_month_features(df: DataFrame) -> DataFrame:
    """Each customer's latest month moved one month ahead.

    The lags shift by one, so the model sees what is known before the month
    starts; the other measures carry over from the latest month.
    """
    nxt = F.add_months("year_month", 1)
    return latest_per(df).select(
        "customer",
        nxt.alias("year_month"),
        F.col("revenue_sum").alias("revenue_lag_1"),
        F.col("revenue_lag_1").alias("revenue_lag_2"),
        F.col("revenue_lag_2").alias("revenue_lag_3"),
        "revenue_mean", "revenue_std", "hours_sum", "billingrate_mean", "project_count",
        F.month(nxt).alias("month"),
        F.quarter(nxt).alias("quarter"),
    )


def forecast_next(df: DataFrame, model: boosting.Model, customer: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Predicted revenue of the next month, with the features in ``keep``; an unknown customer gives no row."""
    if customer is not None:
        df = df.where(F.col("customer") == customer)
    return predict(model, next_month_features(df)).select(
        "customer", "year_month", F.date_format("year_month", "MMMM yyyy").alias("label"), *keep, "prediction")
