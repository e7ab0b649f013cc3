"""Survey-shaped views over the driver's tables.

The driver's tables hold no soundings, so the survey tables the operators run
on are derived from them with plain column expressions (see FIXTURES.md §2).
Each view exists twice: as a DataFrame builder (what the Spark queries read)
and as ANSI SQL text (inlined as a CTE by the DuckDB oracles).  Both read the
whole base table; no rows are dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x) -> Column:
    return F.lit(x).cast("double")


def _dc(c: Column) -> Column:
    return c.cast("double")


# ---------------------------------------------------------------- Spark side

def soundings_mbes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    lat = (F.when(eid % 997 == 0, _d(95)).when(eid % 1009 == 0, F.lit(None).cast("double"))
           .otherwise(_d(40) + _dc((uid % 50) * 100 + eid % 100) / _d(10000)))
    lon = (F.when(eid % 991 == 0, _d(-200))
           .otherwise(_d(-74) + _dc((uid % 40) * 100 + eid % 97) / _d(10000)))
    depth = (F.when(eid % 503 == 0, F.lit(None).cast("double")).when(eid % 499 == 0, -val)
             .when(eid % 487 == 0, _d(12000) + val).otherwise(val))
    return e.select(
        eid.alias("idx"), (uid % 8).alias("survey_id"),
        F.concat(F.lit("RV_"), (uid % 8).cast("string")).alias("vessel_id"),
        F.col("ts").alias("timestamp"), lat.alias("latitude"), lon.alias("longitude"),
        depth.alias("depth"), (_dc(eid % 201) - _d(100)).alias("beam_angle"),
        _dc(eid % 103).alias("quality"))


def soundings_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ok.alias("idx"), (ck % 8).alias("survey_id"), F.col("o_orderdate").alias("timestamp"),
        (_d(-89) + _dc(ck % 1781) / _d(10)).alias("latitude"),
        (_d(-179) + _dc(ck % 3581) / _d(10)).alias("longitude"),
        (F.col("o_totalprice") / _d(100)).alias("depth"),
        _dc(ok % 370).alias("heading"),
        (_dc(ok % 191) - _d(95)).alias("pitch"),
        (_dc(ck % 187) - _d(93)).alias("roll"),
        _dc(ck % 53).alias("velocity"),
        _dc(ok % 101).alias("quality"))


def points_lidar(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
        (F.col("l_suppkey") % 8).alias("survey_id"),
        F.col("l_shipdate").alias("timestamp"),
        (_d(40) + _dc(F.col("l_partkey") % 200) / _d(2000)).alias("latitude"),
        (_d(-74) + _dc(F.col("l_suppkey") % 100) / _d(2000)).alias("longitude"),
        (F.col("l_extendedprice") / _d(10) - _d(200)).alias("elevation"),
        (F.col("l_quantity") * _d(6)).alias("intensity"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 34).cast("int").alias("classification"),
        F.col("l_linenumber").alias("return_number"))


def soundings_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("idx"), (F.col("user_id") % 8).alias("survey_id"), F.col("ts").alias("timestamp"),
        _dc(F.lit(400000) + (eid % 2000) * 100).alias("longitude"),
        _dc(F.lit(5500000) + (eid % 3001) * 50).alias("latitude"),
        F.col("value").alias("depth"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ok.alias("job_id"),
        F.when(ck % 3 == 0, "netcdf").when(ck % 3 == 1, "bag").otherwise("geotiff").alias("output_format"),
        F.when(ck % 5 == 0, "mbes").when(ck % 5 == 1, "sbes").when(ck % 5 == 2, "lidar")
         .when(ck % 5 == 3, "singlebeam").otherwise("auv").alias("sensor_type"),
        F.when(ok % 10 < 6, "completed").when(ok % 10 == 6, "failed")
         .when(ok % 10 == 7, "processing").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(ok % 10 < 6, (F.lit(30) + ok % 571).cast("int")).alias("duration_s"),
        (_dc(ok % 101) / _d(100)).alias("quality_score"),
        ck.alias("total_points"))


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("vessel_key"), F.col("s_name").alias("vessel_name"),
                    F.concat(F.lit("RV_"), F.col("s_suppkey").cast("string")).alias("vessel_id"))


def env_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # (p_partkey % 50, floor(p_partkey / 50)) is unique over the whole table.
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(
        (pk % 50).cast("int").alias("row"),
        F.floor(pk / _d(50)).cast("int").alias("col"),
        (_d(5) + _dc(F.col("p_size") % 8)).alias("dissolved_oxygen"),
        (_dc(F.lit(75) + F.col("p_size") % 10) / _d(10)).alias("ph_level"),
        F.col("p_retailprice").alias("water_turbidity"))


# ------------------------------------------------------------ DuckDB side

_SQL = {
    "soundings_mbes": """
SELECT event_id AS idx, user_id % 8 AS survey_id, concat('RV_', CAST(user_id % 8 AS VARCHAR)) AS vessel_id, ts AS timestamp,
 CASE WHEN event_id % 997 = 0 THEN CAST(95 AS DOUBLE) WHEN event_id % 1009 = 0 THEN NULL
      ELSE CAST(40 AS DOUBLE) + CAST((user_id % 50) * 100 + event_id % 100 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS latitude,
 CASE WHEN event_id % 991 = 0 THEN CAST(-200 AS DOUBLE)
      ELSE CAST(-74 AS DOUBLE) + CAST((user_id % 40) * 100 + event_id % 97 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS longitude,
 CASE WHEN event_id % 503 = 0 THEN NULL WHEN event_id % 499 = 0 THEN -value
      WHEN event_id % 487 = 0 THEN CAST(12000 AS DOUBLE) + value ELSE value END AS depth,
 CAST(event_id % 201 AS DOUBLE) - CAST(100 AS DOUBLE) AS beam_angle, CAST(event_id % 103 AS DOUBLE) AS quality
FROM events""",
    "soundings_nav": """
SELECT o_orderkey AS idx, o_custkey % 8 AS survey_id, o_orderdate AS timestamp,
 CAST(-89 AS DOUBLE) + CAST(o_custkey % 1781 AS DOUBLE) / CAST(10 AS DOUBLE) AS latitude,
 CAST(-179 AS DOUBLE) + CAST(o_custkey % 3581 AS DOUBLE) / CAST(10 AS DOUBLE) AS longitude,
 o_totalprice / CAST(100 AS DOUBLE) AS depth, CAST(o_orderkey % 370 AS DOUBLE) AS heading,
 CAST(o_orderkey % 191 AS DOUBLE) - CAST(95 AS DOUBLE) AS pitch, CAST(o_custkey % 187 AS DOUBLE) - CAST(93 AS DOUBLE) AS roll,
 CAST(o_custkey % 53 AS DOUBLE) AS velocity, CAST(o_orderkey % 101 AS DOUBLE) AS quality
FROM orders""",
    "points_lidar": """
SELECT l_orderkey * 8 + l_linenumber AS idx, l_suppkey % 8 AS survey_id, l_shipdate AS timestamp,
 CAST(40 AS DOUBLE) + CAST(l_partkey % 200 AS DOUBLE) / CAST(2000 AS DOUBLE) AS latitude,
 CAST(-74 AS DOUBLE) + CAST(l_suppkey % 100 AS DOUBLE) / CAST(2000 AS DOUBLE) AS longitude,
 l_extendedprice / CAST(10 AS DOUBLE) - CAST(200 AS DOUBLE) AS elevation, l_quantity * CAST(6 AS DOUBLE) AS intensity,
 CAST((l_partkey + l_linenumber) % 34 AS INT) AS classification, l_linenumber AS return_number
FROM lineitem""",
    "soundings_utm": """
SELECT event_id AS idx, user_id % 8 AS survey_id, ts AS timestamp,
 CAST(400000 + (event_id % 2000) * 100 AS DOUBLE) AS longitude, CAST(5500000 + (event_id % 3001) * 50 AS DOUBLE) AS latitude,
 value AS depth
FROM events""",
    "jobs": """
SELECT o_orderkey AS job_id,
 CASE WHEN o_custkey % 3 = 0 THEN 'netcdf' WHEN o_custkey % 3 = 1 THEN 'bag' ELSE 'geotiff' END AS output_format,
 CASE WHEN o_custkey % 5 = 0 THEN 'mbes' WHEN o_custkey % 5 = 1 THEN 'sbes' WHEN o_custkey % 5 = 2 THEN 'lidar'
      WHEN o_custkey % 5 = 3 THEN 'singlebeam' ELSE 'auv' END AS sensor_type,
 CASE WHEN o_orderkey % 10 < 6 THEN 'completed' WHEN o_orderkey % 10 = 6 THEN 'failed'
      WHEN o_orderkey % 10 = 7 THEN 'processing' ELSE 'queued' END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 10 < 6 THEN CAST(30 + o_orderkey % 571 AS INT) END AS duration_s,
 CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS quality_score, o_custkey AS total_points
FROM orders""",
    "vessels": """
SELECT s_suppkey AS vessel_key, s_name AS vessel_name, concat('RV_', CAST(s_suppkey AS VARCHAR)) AS vessel_id FROM supplier""",
    "env_layer": """
SELECT CAST(p_partkey % 50 AS INT) AS row, CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS INT) AS col,
 CAST(5 AS DOUBLE) + CAST(p_size % 8 AS DOUBLE) AS dissolved_oxygen,
 CAST(75 + p_size % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS ph_level, p_retailprice AS water_turbidity
FROM part""",
}

BUILDERS = {
    "soundings_mbes": soundings_mbes,
    "soundings_nav": soundings_nav,
    "points_lidar": points_lidar,
    "soundings_utm": soundings_utm,
    "jobs": jobs,
    "vessels": vessels,
    "env_layer": env_layer,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the named views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def view_sql(name: str) -> str:
    return _SQL[name].strip()


# Columns of each view (plan-time schema knowledge for the oracle builders).
VIEW_COLUMNS = {
    "soundings_mbes": ["idx", "survey_id", "vessel_id", "timestamp", "latitude", "longitude", "depth",
                       "beam_angle", "quality"],
    "soundings_nav": ["idx", "survey_id", "timestamp", "latitude", "longitude", "depth", "heading", "pitch",
                      "roll", "velocity", "quality"],
    "points_lidar": ["idx", "survey_id", "timestamp", "latitude", "longitude", "elevation", "intensity",
                     "classification", "return_number"],
    "soundings_utm": ["idx", "survey_id", "timestamp", "longitude", "latitude", "depth"],
}
