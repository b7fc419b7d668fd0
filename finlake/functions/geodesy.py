"""Map projection and distance as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80 ellipsoid and UTM grid constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0
EARTH_RADIUS_M = 6371009.0


def utm_series(flattening: float = FLATTENING) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the inverse series coefficients.

    Krueger's series in the third flattening n: ``beta`` turns grid into
    conformal coordinates, ``delta`` conformal into geographic latitude.
    """
    n = flattening / (2 - flattening)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    ]
    return radius, beta, delta


def add_latlon(df: DataFrame, easting: str, northing: str, lat: str, lon: str, zone: int = 10) -> DataFrame:
    """Add latitude and longitude in degrees of northern-hemisphere UTM points.

    One projection per step of the formula: the intermediate columns are used
    several times, and nested in one expression they would be evaluated anew
    at every use.
    """
    radius, beta, delta = utm_series()
    xi, eta, chi = F.col("_xi"), F.col("_eta"), F.col("_chi")
    xi_c, eta_c = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_c = xi_c - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta_c = eta_c - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    meridian = F.lit(math.radians(zone * 6 - 183))
    return (
        df.withColumns({
            "_xi": F.col(northing) / F.lit(SCALE * radius),
            "_eta": (F.col(easting) - F.lit(FALSE_EASTING)) / F.lit(SCALE * radius),
        })
        .withColumns({"_xic": xi_c, "_etac": eta_c})
        .withColumn("_chi", F.asin(F.sin("_xic") / F.cosh("_etac")))
        .withColumns({lat: F.degrees(phi), lon: F.degrees(meridian + F.atan2(F.sinh("_etac"), F.cos("_xic")))})
        .drop("_xi", "_eta", "_xic", "_etac", "_chi")
    )


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dphi / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlam / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
