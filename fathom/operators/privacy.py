"""Anonymisation, its reversal, and the hashed -> original mapping.

All narrow projections except the mapping (a ``distinct``) and the reversal
(left joins against the mapping; AQE broadcasts the mapping when its
runtime size is small and shuffles otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.privacy import DEFAULT_SALT, HASH_PREFIX, hash_vessel_id, jitter_offsets

ID_COLUMNS = ["vessel_id", "vessel_name", "survey_id"]


def anonymize(df: DataFrame, salt: str = DEFAULT_SALT, jitter: bool = True) -> DataFrame:
    """Hash identifier columns that are present; jitter rows flagged ``gps_jitter``."""
    cols = {c: hash_vessel_id(F.col(c), salt) for c in ID_COLUMNS if c in df.columns}
    out = df.withColumns(cols) if cols else df
    if jitter and "gps_jitter" in df.columns and {"latitude", "longitude"} <= set(df.columns):
        flag = F.coalesce(F.col("gps_jitter").cast("boolean"), F.lit(False))
        dlat, dlon = jitter_offsets(F.col("latitude"), F.col("longitude"), salt)
        out = out.withColumns({
            "latitude": F.when(flag, F.col("latitude") + dlat).otherwise(F.col("latitude")),
            "longitude": F.when(flag, F.col("longitude") + dlon).otherwise(F.col("longitude")),
            "gps_jitter_applied": F.when(flag, F.lit(True)),
            "jitter_radius_meters": F.when(flag, F.lit(50))})
    return out


def vessel_mapping(original: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """hashed -> original for every identifier value (distinct pairs).

    The hash is deterministic, so the mapping is a projection of the original
    table; no positional zip of two tables is needed.
    """
    parts = [original.select(hash_vessel_id(F.col(c), salt).alias("hashed"),
                             F.col(c).cast("string").alias("original"))
             for c in ID_COLUMNS if c in original.columns]
    if not parts:
        raise ValueError("no identifier column to map")
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    return m.where(F.col("original").isNotNull()).distinct()


def positional_mapping(original: DataFrame, anonymized: DataFrame, key: list[str]) -> DataFrame:
    """Mapping from two aligned tables joined on ``key`` (the reference zips
    them by position; ``key`` is the row identity, e.g. (survey, idx))."""
    cols = [c for c in ID_COLUMNS if c in original.columns and c in anonymized.columns and c not in key]
    o = original.select(*key, *[F.col(c).cast("string").alias(f"o_{c}") for c in cols])
    a = anonymized.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols])
    j = o.join(a, key)
    stacked = j.select(F.explode(F.array(*[F.struct(F.col(f"a_{c}").alias("hashed"),
                                                    F.col(f"o_{c}").alias("original")) for c in cols])).alias("m"))
    return stacked.select("m.hashed", "m.original").where(F.col("hashed").isNotNull()).distinct()


def deanonymize(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace hashed identifiers found in ``mapping`` by the original; keep others.

    A hash that two originals share is ambiguous and stays as it is, so every
    row comes out once."""
    mapping = mapping.groupBy("hashed").agg(
        F.when(F.count_distinct("original") == 1, F.min("original")).alias("original"))
    out = df
    for c in [c for c in ID_COLUMNS if c in df.columns]:
        m = mapping.select(F.col("hashed").alias(f"_h_{c}"), F.col("original").alias(f"_o_{c}"))
        out = (out.join(m, out[c] == m[f"_h_{c}"], "left")
                  .withColumn(c, F.coalesce(F.col(f"_o_{c}"), F.col(c).cast("string")))
                  .drop(f"_h_{c}", f"_o_{c}"))
    return out


def validate_anonymization(df: DataFrame, applied: bool = True) -> DataFrame:
    """Per survey: anonymised iff the flag is set and every vessel_id is hashed.

    (The reference samples only the first row; all rows are checked here.)
    """
    if "vessel_id" not in df.columns:
        return df.groupBy("survey_id").agg(F.lit(applied).alias("is_anonymized"))
    ok = F.coalesce(F.bool_and(F.col("vessel_id").startswith(HASH_PREFIX)), F.lit(True))
    return df.groupBy("survey_id").agg((F.lit(applied) & ok).alias("is_anonymized"))
