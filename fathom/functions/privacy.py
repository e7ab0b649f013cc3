"""Identifier hashing and coordinate jitter as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SALT = "default_salt"
HASH_PREFIX = "VESSEL_"
JITTER_RADIUS_M = 50.0
METRES_PER_DEGREE = 111000.0


def hash_vessel_id(c: Column, salt: str = DEFAULT_SALT) -> Column:
    """'VESSEL_' + upper(first 8 hex of sha256(f"{id}_{salt}")); NULL stays NULL."""
    txt = c.cast("string")
    h = F.sha2(F.concat(txt, F.lit(f"_{salt}")), 256)
    return F.when(txt.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(HASH_PREFIX), F.upper(F.substring(h, 1, 8))))


def hash_demo(c: Column, salt: str = DEFAULT_SALT) -> Column:
    """Demo variant: first 16 lower-case hex of sha256(id + salt), no separator."""
    return F.substring(F.sha2(F.concat(c.cast("string"), F.lit(salt)), 256), 1, 16)


def unit_uniform(*parts: Column) -> Column:
    """Deterministic U[0, 1) from a 64-bit hash of the given columns."""
    h = F.xxhash64(*parts)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def jitter_offsets(lat: Column, lon: Column, salt: str = DEFAULT_SALT,
                   radius_m: float = JITTER_RADIUS_M) -> tuple[Column, Column]:
    """Uniform offsets within +-radius (degrees); longitude scaled by cos(lat).

    Seeded by (salt, lat, lon), so the same point always moves the same way.
    """
    lat_j = F.lit(radius_m / METRES_PER_DEGREE)
    cos_lat = F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-12))
    lon_j = F.lit(radius_m) / (F.lit(METRES_PER_DEGREE) * cos_lat)
    u1 = unit_uniform(F.lit(salt), lat, lon, F.lit("lat"))
    u2 = unit_uniform(F.lit(salt), lat, lon, F.lit("lon"))
    return (F.lit(2.0) * u1 - F.lit(1.0)) * lat_j, (F.lit(2.0) * u2 - F.lit(1.0)) * lon_j
