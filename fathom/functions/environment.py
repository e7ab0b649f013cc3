"""Deterministic environmental attributes of a sounding (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's overlay): plume box and depth,
# temperature model, habitat depth classes, shallow-water risk depth.
PLUME_LAT = (40.0, 41.0)
PLUME_LON = (-74.0, -73.0)
PLUME_MIN_DEPTH = 100.0
BASE_TEMP_C, TEMP_REF_LAT, TEMP_PER_DEG_LAT, TEMP_PER_M = 20.0, 40.0, 0.5, 0.01
HABITAT_CLASSES = [(50.0, "shallow_water"), (200.0, "continental_shelf"), (1000.0, "continental_slope")]
HABITAT_DEEPEST = "deep_sea"
SHALLOW_RISK_DEPTH = 100.0


def plume_detected(lat: Column, lon: Column, depth: Column) -> Column:
    c = (lat.between(*PLUME_LAT) & lon.between(*PLUME_LON) & (depth > PLUME_MIN_DEPTH))
    return F.coalesce(c, F.lit(False))


def water_temperature(lat: Column, depth: Column) -> Column:
    base = F.lit(BASE_TEMP_C) - (lat - F.lit(TEMP_REF_LAT)) * F.lit(TEMP_PER_DEG_LAT)
    return F.greatest(F.lit(0.0), base - depth * F.lit(TEMP_PER_M))


def habitat_type(depth: Column) -> Column:
    e = None
    for bound, name in HABITAT_CLASSES:
        e = F.when(depth < bound, F.lit(name)) if e is None else e.when(depth < bound, F.lit(name))
    return e.otherwise(F.lit(HABITAT_DEEPEST))


def environmental_risk(plume: Column) -> Column:
    return F.when(plume, F.lit("high")).otherwise(F.lit("low"))


def risk_factors(plume: Column, depth: Column) -> Column:
    return F.array_compact(F.array(F.when(plume, F.lit("plume_detected")),
                                   F.when(depth < SHALLOW_RISK_DEPTH, F.lit("shallow_water"))))
