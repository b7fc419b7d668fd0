"""File source and batch reset queries; the files are written from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake.operators.screening import rule_high_risk_geo
from finlake.plans.oracle_views import with_views
from finlake.plans.registry import query
from finlake.plans.tables import aml_tx, decisions, ground_truth, paysim, table
from finlake.schemas import PAYSIM
from finlake.session import new_path
from finlake.sources import readers, sinks


def _as_csv(spark, df, name: str) -> str:
    path = new_path(spark, name) + ".csv"
    sinks.export_csv(df, path)
    return path


@query("src1_csv_inferred", """SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def _(spark, d):
    path = _as_csv(spark, table(spark, d, "customer"), "bronze")
    return readers.read_csv_inferred(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("int"))


@query("src3_staged_csv", with_views(f"SELECT {', '.join(PAYSIM.names)} FROM paysim", "paysim"))
def _(spark, d):
    return readers.read_staged_csv(spark, _as_csv(spark, paysim(spark, d).select(*PAYSIM.names), "stage"), PAYSIM)


@query("src4_load_upload", """SELECT p_name AS part_name, p_brand AS brand_name, p_size AS size FROM part""")
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("Part Name"), F.col("p_brand").alias("Brand Name"), F.col("p_size").alias("Size"))
    readers.load_upload(spark, _as_csv(spark, parts, "upload"))
    return spark.table("uploaded_data")


@query("src5_route_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    kind, df = readers.route_source(spark, _as_csv(spark, table(spark, d, "nation"), "routed"))
    assert kind == "sql"
    return df


@query("snk7_reset_batch", with_views(
    """SELECT 'transactions' AS "table", count(*) AS before, 0::BIGINT AS after FROM aml_tx UNION ALL SELECT 'flags', count(*), 0 FROM f_geo
    UNION ALL SELECT 'review_decisions', count(*), 0 FROM decisions UNION ALL SELECT 'ground_truth', count(*), 0 FROM ground_truth""",
    "aml_tx", "f_geo", "decisions", "ground_truth"))
def _(spark, d):
    tx = aml_tx(spark, d)
    frames = {"transactions": tx, "flags": rule_high_risk_geo(tx), "review_decisions": decisions(spark, d), "ground_truth": ground_truth(spark, d)}
    paths = {name: new_path(spark, name) for name in frames}
    counts = []
    for name, df in frames.items():
        df.write.parquet(paths[name])
        counts.append(spark.read.parquet(paths[name]).count())
    sinks.reset_batch(spark, paths)
    out = None
    for (name, path), n in zip(paths.items(), counts, strict=True):
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("after")).select(
            F.lit(name).alias("table"), F.lit(n).cast("bigint").alias("before"), "after")
        out = part if out is None else out.unionByName(part)
    return out
