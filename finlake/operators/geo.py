"""Crime points, hotspots and their place on the road network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.geodesy import add_latlon, haversine

# Number of hotspots and seed.
HOTSPOTS = 10
SEED = 42
# Points handled by one aggregate over the nodes; more points take more passes.
POINTS_PER_PASS = 50

Centre = tuple[int, float, float]


def crime_project(df: DataFrame) -> DataFrame:
    """Located crimes with their time; impossible date parts give a null time."""
    return df.dropna(subset=["X", "Y"]).select(
        F.try_make_timestamp("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", F.lit(0)).alias("ReportedDate"),
        "TYPE", F.col("Y").alias("Latitude"), F.col("X").alias("Longitude"), "NEIGHBOURHOOD",
    )


def utm_to_wgs84(df: DataFrame, zone: int = 10) -> DataFrame:
    """Replace grid coordinates in Latitude/Longitude by degrees."""
    return add_latlon(df, "Longitude", "Latitude", "Latitude", "Longitude", zone)


def hotspots(df: DataFrame, k: int = HOTSPOTS, seed: int = SEED) -> tuple[list[Centre], DataFrame]:
    """K-means on raw degrees: the ``k`` centres and the points with their cluster."""
    points = VectorAssembler(inputCols=["Latitude", "Longitude"], outputCol="features").transform(df)
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(points.select("features"))
    centres = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return centres, model.transform(points).drop("features")


def assign_cluster(df: DataFrame, centres: Sequence[Centre]) -> DataFrame:
    """Nearest given centre by squared distance in degrees, ties to the lowest id.

    The centres are a literal array inside the expression: no join, no
    shuffle, and the expression stays small however many centres there are.
    """
    places = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
                       for i, lat, lon in centres])

    def option(c: Column) -> Column:
        dy, dx = F.col("Latitude") - c["lat"], F.col("Longitude") - c["lon"]
        return F.struct((dy * dy + dx * dx).alias("d"), c["id"].alias("id"))

    located = F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull()
    return df.withColumn("cluster", F.when(located, F.array_min(F.transform(places, option))["id"]))


def nearest_node(nodes: DataFrame, points: Sequence[Centre]) -> DataFrame:
    """Great-circle nearest node of each point: cluster_id, lat, lon, node_id, metres.

    One aggregate keeps the best node of every point, combined map-side; the
    pairs themselves are never produced.
    """
    out = None
    for start in range(0, len(points), POINTS_PER_PASS):
        part = points[start:start + POINTS_PER_PASS]
        best = nodes.agg(*[
            F.min(F.struct(haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")).alias("d"),
                           F.col("id").alias("id"))).alias(f"_p{i}")
            for i, (_, lat, lon) in enumerate(part)
        ])
        rows = F.array(*[
            F.struct(F.lit(cid).alias("cluster_id"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"),
                     F.col(f"_p{i}.id").alias("node_id"), F.col(f"_p{i}.d").alias("metres"))
            for i, (cid, lat, lon) in enumerate(part)
        ])
        found = best.select(F.explode(rows).alias("r")).select("r.*")
        out = found if out is None else out.unionByName(found)
    return out


def centroid(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("Latitude").alias("lat"), F.avg("Longitude").alias("lon"))


def hotspot_table(assigned: DataFrame, placed: DataFrame, tour: DataFrame) -> DataFrame:
    """Hotspots with their size and whether the tour visits them."""
    sizes = assigned.groupBy(F.col("cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("crimes"))
    visited = tour.select(F.col("node").alias("node_id"), F.lit(True).alias("_in")).distinct()
    return (
        placed.join(sizes, "cluster_id", "left")
        .join(visited, "node_id", "left")
        .select("cluster_id", "node_id", "lat", "lon", F.coalesce("crimes", F.lit(0)).alias("crimes"),
                F.when(F.col("_in"), "Included").otherwise("Excluded").alias("status"))
    )
