"""Geodesy as Spark column expressions (JVM-side, whole-stage codegen).

* great-circle distance (haversine, R = 6 371 000 m) and initial bearing;
* UTM zone / EPSG code of a longitude;
* inverse transverse Mercator (UTM -> WGS84) with Krüger's series in the
  third flattening n, written with ``sinh / cosh / asin / atan2`` so no
  per-row Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0

# WGS84 ellipsoid and UTM constants (public standard values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

_N = WGS84_F / (2 - WGS84_F)
_A = WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64 + _N ** 6 / 256)

# Krüger / Karney series coefficients (functions of n), inverse direction.
_BETA = [
    _N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360 - 81 * _N ** 5 / 512 + 96199 * _N ** 6 / 604800,
    _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440 + 46 * _N ** 5 / 105 - 1118711 * _N ** 6 / 3870720,
    17 * _N ** 3 / 480 - 37 * _N ** 4 / 840 - 209 * _N ** 5 / 4480 + 5569 * _N ** 6 / 90720,
    4397 * _N ** 4 / 161280 - 11 * _N ** 5 / 504 - 830251 * _N ** 6 / 7257600,
    4583 * _N ** 5 / 161280 - 108847 * _N ** 6 / 3991680,
    20648693 * _N ** 6 / 638668800,
]
_DELTA = [
    2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45 + 26 * _N ** 5 / 45 - 2854 * _N ** 6 / 675,
    7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45 + 2704 * _N ** 5 / 315 + 2323 * _N ** 6 / 945,
    56 * _N ** 3 / 15 - 136 * _N ** 4 / 35 - 1262 * _N ** 5 / 105 + 73814 * _N ** 6 / 2835,
    4279 * _N ** 4 / 630 - 332 * _N ** 5 / 35 - 399572 * _N ** 6 / 14175,
    4174 * _N ** 5 / 315 - 144838 * _N ** 6 / 6237,
    601676 * _N ** 6 / 22275,
]
# Forward direction (used by tests for round trips).
_ALPHA = [
    _N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180 - 127 * _N ** 5 / 288 + 7891 * _N ** 6 / 37800,
    13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440 + 281 * _N ** 5 / 630 - 1983433 * _N ** 6 / 1935360,
    61 * _N ** 3 / 240 - 103 * _N ** 4 / 140 + 15061 * _N ** 5 / 26880 + 167603 * _N ** 6 / 181440,
    49561 * _N ** 4 / 161280 - 179 * _N ** 5 / 168 + 6601661 * _N ** 6 / 7257600,
    34729 * _N ** 5 / 80640 - 3418889 * _N ** 6 / 1995840,
    212378941 * _N ** 6 / 319334400,
]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (sqrt(a) clamped to 1 against rounding)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    s1, s2 = F.sin(dlat / 2), F.sin(dlon / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    return F.lit(EARTH_RADIUS_M) * (F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, degrees in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlon = F.radians(lon2) - F.radians(lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return (F.degrees(F.atan2(y, x)) + F.lit(360.0)) % F.lit(360.0)


def utm_zone_number(lon: Column) -> Column:
    """int((lon + 180) / 6) + 1 with truncation toward zero."""
    return ((lon + F.lit(180.0)) / F.lit(6.0)).cast("int") + F.lit(1)


def utm_epsg(lon: Column, lat: Column | None = None, hemisphere_by: str = "longitude") -> Column:
    """EPSG code string of the UTM zone.

    ``hemisphere_by='longitude'`` reproduces the reference (north iff lon >= 0);
    ``'latitude'`` is the geographic rule (north iff lat >= 0, zone <= 60).
    """
    zone = utm_zone_number(lon)
    if hemisphere_by == "latitude":
        if lat is None:
            raise ValueError("hemisphere_by='latitude' needs a latitude column")
        zone = F.least(zone, F.lit(60))
        north = lat >= 0
    else:
        north = lon >= 0
    code = F.when(north, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)
    return F.concat(F.lit("EPSG:"), code.cast("string"))


def central_meridian(zone: int) -> float:
    return (zone - 1) * 6 - 180 + 3


def utm_to_wgs84(easting: Column, northing: Column, zone: Column | int, north: Column | bool = True
                 ) -> tuple[Column, Column]:
    """Inverse transverse Mercator: (easting, northing) of a UTM zone -> (lat, lon) degrees."""
    zone_c = zone if isinstance(zone, Column) else F.lit(zone)
    north_c = north if isinstance(north, Column) else F.lit(bool(north))
    lon0_deg = ((zone_c - F.lit(1)) * F.lit(6) - F.lit(177)).cast("double")
    n0 = F.when(north_c, F.lit(0.0)).otherwise(F.lit(UTM_FALSE_NORTHING_SOUTH))
    xi = (northing - n0) / F.lit(UTM_K0 * _A)
    eta = (easting - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * _A)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi_p = xi_p - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta_p = eta_p - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    # Central meridian added in degrees: easting 500000 gives it exactly.
    return F.degrees(phi), lon0_deg + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))


def wgs84_to_utm_py(lat: float, lon: float, zone: int, north: bool = True) -> tuple[float, float]:
    """Forward transverse Mercator in plain Python (tests / round trips)."""
    phi, lam = math.radians(lat), math.radians(lon - central_meridian(zone))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi_p = math.atan2(t, math.cos(lam))
    eta_p = math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    e = eta_p + sum(a * math.cos(2 * j * xi_p) * math.sinh(2 * j * eta_p) for j, a in enumerate(_ALPHA, 1))
    n = xi_p + sum(a * math.sin(2 * j * xi_p) * math.cosh(2 * j * eta_p) for j, a in enumerate(_ALPHA, 1))
    return (UTM_FALSE_EASTING + UTM_K0 * _A * e,
            (0.0 if north else UTM_FALSE_NORTHING_SOUTH) + UTM_K0 * _A * n)


def utm_to_wgs84_df(df, easting: str, northing: str, zone: Column | int, north: Column | bool = True,
                    lat_out: str = "latitude", lon_out: str = "longitude", keep: Column | None = None):
    """The inverse transverse Mercator as staged projections.

    Written as one column the series repeats xi', eta' and chi inside every
    term, so the expression tree (and the generated code) grows
    multiplicatively.  Each stage maps the last one's struct in an array of
    one, so every intermediate is computed once per row.  Rows where ``keep``
    is true keep their original coordinates; they have no array, and the
    stages stay out of the generated code, which the JVM runs uncompiled when
    it holds them.
    """
    zone_c = zone if isinstance(zone, Column) else F.lit(zone)
    north_c = north if isinstance(north, Column) else F.lit(bool(north))
    n0 = F.when(north_c, F.lit(0.0)).otherwise(F.lit(UTM_FALSE_NORTHING_SOUTH))
    plane = F.struct(((F.col(northing) - n0) / F.lit(UTM_K0 * _A)).alias("xi"),
                     ((F.col(easting) - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * _A)).alias("eta"),
                     ((zone_c - F.lit(1)) * F.lit(6) - F.lit(177)).cast("double").alias("lon0"))

    def sphere(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        xi_p, eta_p = xi, eta
        for j, b in enumerate(_BETA, start=1):
            xi_p = xi_p - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
            eta_p = eta_p - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        return F.struct(xi_p.alias("xi"), eta_p.alias("eta"), v["lon0"].alias("lon0"))

    def conformal(v: Column) -> Column:
        return F.struct(F.asin(F.sin(v["xi"]) / F.cosh(v["eta"])).alias("chi"),
                        (v["lon0"] + F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])))).alias("lon"))

    def degrees(v: Column) -> Column:
        phi = v["chi"]
        for j, dl in enumerate(_DELTA, start=1):
            phi = phi + F.lit(dl) * F.sin(F.lit(2.0 * j) * v["chi"])
        return F.struct(F.degrees(phi).alias("lat"), v["lon"].alias("lon"))

    stages = F.array(plane)
    if keep is not None:
        stages = F.when(~F.coalesce(keep, F.lit(False)), stages)
    for stage in (sphere, conformal, degrees):
        stages = F.transform(stages, stage)
    d = df.withColumn("_tm", stages)
    lat, lon = F.col("_tm")[0]["lat"], F.col("_tm")[0]["lon"]
    if keep is not None:
        lat = F.when(keep, F.col(northing)).otherwise(lat)
        lon = F.when(keep, F.col(easting)).otherwise(lon)
    return d.withColumns({lat_out: lat, lon_out: lon}).drop("_tm")
