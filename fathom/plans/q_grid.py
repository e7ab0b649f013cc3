"""Check queries: gridding and surfaces and raster products (§2.2).

All rows of the views are read; what a grid or a surface leaves out (soundings
without a position, for surfaces without a depth) the operators leave out.
``soundings_mbes`` has fixes out of range (FIXTURES.md §2), which span 55 by 126
degrees: queries on its cells use 0.01 degrees, those on every node 1 degree,
the surfaces, which the oracles find by comparing all nodes with all soundings,
2 degrees.  ``points_lidar`` uses the reference's 0.001 degrees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import grid as gr
from fathom.operators import surface as su
from fathom.operators.joins import join_null_safe
from fathom.plans.catalog import r6, register
from fathom.plans.oracle import sql_grid_cells as _sql_cells
from fathom.plans.oracle import sql_with as _with
from fathom.plans.views import view

RES = 0.01
NODES = 1.0
SURFACE = 2.0
_PLACED = "latitude IS NOT NULL AND longitude IS NOT NULL"


def _mbes(spark, sf_dir):
    return view(spark, sf_dir, "soundings_mbes")


def _cells(res=RES, depth_filter=False):
    return _sql_cells(res, depth_filter, where=_PLACED)


def _at(res, text):
    """Oracle text for another resolution."""
    return text.replace("CAST(0.01 AS DOUBLE)", f"CAST({res} AS DOUBLE)")


register("grid_cell_index", _with(_cells(), "SELECT survey_id, idx, row, col FROM cells"),
         ("soundings_mbes",))(
    lambda spark, sf_dir: gr.binned_points(_mbes(spark, sf_dir), "mbes", RES).select("survey_id", "idx", "row", "col"))

register("grid_density", _with(_cells(), "SELECT survey_id, row, col, count(*) AS density FROM cells GROUP BY ALL"),
         ("soundings_mbes",))(
    lambda spark, sf_dir: gr.cell_stats(gr.binned_points(_mbes(spark, sf_dir), "mbes", RES))
    .select("survey_id", "row", "col", "density"))

register("grid_uncertainty", _with(_cells(), """
SELECT survey_id, row, col, CAST(1.0 AS DOUBLE) AS uncertainty FROM cells GROUP BY ALL"""), ("soundings_mbes",))(
    lambda spark, sf_dir: gr.cell_stats(gr.binned_points(_mbes(spark, sf_dir), "mbes", RES))
    .select("survey_id", "row", "col", "uncertainty"))

register("grid_elevation_mean", _with(_cells(), """
SELECT survey_id, row, col, round(CAST(avg(CAST(CAST(z AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE), 6) AS elevation
FROM cells GROUP BY ALL"""), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(gr.cell_stats(gr.binned_points(_mbes(spark, sf_dir), "mbes", RES))
                             .select("survey_id", "row", "col", F.col("elevation_mean").alias("elevation"))))

_RUNNING_SQL = """
SELECT survey_id, row, col,
       round(CASE WHEN max(last_null) = max(n) - 1 THEN NULL
                  ELSE CAST(sum(CAST(CAST(CASE WHEN pos > last_null THEN z * CASE WHEN n - pos = n - 1 - last_null
                                                              THEN pow(2, -(n - 2 - last_null))
                                                              ELSE pow(2, -(n - pos)) END END AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE) END, 6) AS elevation
FROM (SELECT *, coalesce(max(CASE WHEN z IS NULL THEN pos END) OVER (PARTITION BY survey_id, row, col), -1) AS last_null
      FROM (SELECT survey_id, row, col, idx, z,
                   row_number() OVER (PARTITION BY survey_id, row, col ORDER BY idx) - 1 AS pos,
                   count(*) OVER (PARTITION BY survey_id, row, col) AS n
            FROM cells) a) b
GROUP BY survey_id, row, col"""

# NULL depths kept: exercises the restart of the running average.
register("grid_elevation_running", _with(_cells(), _RUNNING_SQL), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(gr.running_average(gr.binned_points(_mbes(spark, sf_dir), "mbes", RES))
                             .withColumnRenamed("elevation_running", "elevation")))

register("grid_elevation_running_lidar", _with(
    _sql_cells(res=0.001, depth_filter=False, src="points_lidar", z="elevation", where="latitude IS NOT NULL"),
    _RUNNING_SQL.replace("ORDER BY idx", "ORDER BY idx, z")), ("points_lidar",))(
    lambda spark, sf_dir: r6(gr.running_average(
        gr.binned_points(view(spark, sf_dir, "points_lidar"), "lidar", 0.001), order=["idx", "z"])
        .withColumnRenamed("elevation_running", "elevation")))

register("grid_rank", _with(_cells(), """
SELECT survey_id, row, col, idx, row_number() OVER (PARTITION BY survey_id, row, col ORDER BY idx) AS cell_rank,
       count(*) OVER (PARTITION BY survey_id, row, col) AS cell_points FROM cells"""), ("soundings_mbes",))(
    lambda spark, sf_dir: gr.grid_rank(gr.binned_points(_mbes(spark, sf_dir), "mbes", RES)))

register("grid_bounds", _with(_cells(depth_filter=True), """
SELECT survey_id, min_lat, max_lat, min_lon, max_lon, valid_points, n_rows, n_cols, CAST(0.01 AS DOUBLE) AS resolution
FROM b"""), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(su.surface_bounds(_mbes(spark, sf_dir), RES)))

register("grid_coordinates", _at(NODES, _with(_cells(NODES), """
SELECT survey_id, row, col, round(lat, 6) AS lat,
       round(min_lon + col * CAST(0.01 AS DOUBLE), 6) AS lon FROM nodes""")), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(gr.grid_nodes(gr.survey_grid_bounds(_mbes(spark, sf_dir), NODES), NODES)))


def _dense(spark, sf_dir):
    pts = _mbes(spark, sf_dir)
    bounds = gr.survey_grid_bounds(pts, NODES)
    grid = gr.attributed_grid(pts, "mbes", NODES, "mean", bounds)
    return gr.densify(grid, bounds, NODES), bounds


_DENSE_SQL = """
dense AS (SELECT n.survey_id, n.row, n.col, round(n.lat, 6) AS lat,
                 round(n.min_lon + n.col * CAST(0.01 AS DOUBLE), 6) AS lon,
                 round(g.elevation, 6) AS elevation, g.uncertainty, coalesce(g.density, 0) AS density
          FROM nodes n LEFT JOIN (SELECT survey_id, row, col,
                                         CAST(avg(CAST(CAST(z AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE) AS elevation,
                                         CAST(1.0 AS DOUBLE) AS uncertainty, count(*) AS density
                                  FROM cells GROUP BY ALL) g
          ON n.survey_id = g.survey_id AND n.row = g.row AND n.col = g.col)"""

register("grid_densify", _at(NODES, _with(_cells(NODES) + "," + _DENSE_SQL, "SELECT * FROM dense")), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(_dense(spark, sf_dir)[0]))

register("sink_raster_bands", _at(NODES, _with(_cells(NODES) + "," + _DENSE_SQL.replace("round(g.elevation, 6)", "g.elevation"), """
SELECT survey_id, row, col, 'elevation' AS band, CAST(elevation AS FLOAT) AS value FROM dense
UNION ALL SELECT survey_id, row, col, 'uncertainty', CAST(uncertainty AS FLOAT) FROM dense
UNION ALL SELECT survey_id, row, col, 'density', CAST(density AS FLOAT) FROM dense""")), ("soundings_mbes",))(
    lambda spark, sf_dir: gr.raster_bands(_dense(spark, sf_dir)[0]))


@register("raster_info", _with(_cells(NODES), """
SELECT survey_id, n_cols AS width, n_rows AS height, CAST(3 AS BIGINT) AS band_count, min_lat, max_lat, min_lon, max_lon,
       round((max_lon - min_lon) / n_cols, 6) AS pixel_width, round((max_lat - min_lat) / n_rows, 6) AS pixel_height,
       'EPSG:4326' AS crs
FROM b"""), ("soundings_mbes",))
def q_raster_info(spark, sf_dir):
    dense, bounds = _dense(spark, sf_dir)
    return r6(gr.raster_info(gr.raster_bands(dense), bounds).drop("nodata"))


register("surface_nearest", _at(SURFACE, _with(_cells(SURFACE, True), """
SELECT n.survey_id, n.row, n.col, round(n.lat, 6) AS lat, round(n.min_lon + n.col * CAST(0.01 AS DOUBLE), 6) AS lon,
       first(p.z ORDER BY sqrt((p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE))) * (p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE)))
                               + (p.latitude - n.lat) * (p.latitude - n.lat)), p.idx) AS z,
       first(p.idx ORDER BY sqrt((p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE))) * (p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE)))
                                 + (p.latitude - n.lat) * (p.latitude - n.lat)), p.idx) AS src_idx
FROM nodes n JOIN pts p ON n.survey_id = p.survey_id
GROUP BY n.survey_id, n.row, n.col, n.lat, n.min_lon""")), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(su.surface_nearest(_mbes(spark, sf_dir), SURFACE).drop("method")))

register("nearest_node_join", _at(SURFACE, _with(_cells(SURFACE, True), """
SELECT n.survey_id, count(*) AS nodes,
       sum(z) AS z_sum FROM (
  SELECT n.survey_id, n.row, n.col,
         first(p.z ORDER BY sqrt((p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE))) * (p.longitude - (n.min_lon + n.col * CAST(0.01 AS DOUBLE)))
                                 + (p.latitude - n.lat) * (p.latitude - n.lat)), p.idx) AS z
  FROM nodes n JOIN pts p ON n.survey_id = p.survey_id GROUP BY n.survey_id, n.row, n.col) n
GROUP BY n.survey_id""").replace("sum(z) AS z_sum", "round(sum(z), 6) AS z_sum")), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(su.surface_nearest(_mbes(spark, sf_dir), SURFACE)
                             .groupBy("survey_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("z").alias("z_sum"))))

register("attributed_grid_running", _with(_cells(), f"""
SELECT g.survey_id, g.row, g.col, round(b.min_lat + g.row * CAST(0.01 AS DOUBLE), 6) AS lat,
       round(b.min_lon + g.col * CAST(0.01 AS DOUBLE), 6) AS lon, g.elevation, CAST(1.0 AS DOUBLE) AS uncertainty,
       d.density
FROM ({_RUNNING_SQL}) g JOIN b ON g.survey_id = b.survey_id
JOIN (SELECT survey_id, row, col, count(*) AS density FROM cells GROUP BY ALL) d
  ON g.survey_id = d.survey_id AND g.row = d.row AND g.col = d.col"""), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(gr.attributed_grid(_mbes(spark, sf_dir), "mbes", RES, "running")))


# Angles from a node, or from a location, to all others: inside the hull no gap is over a half turn.
_GAPS = """
gaps AS (SELECT {key}, greatest(max(gap), min(t) + 2 * pi() - max(t)) AS gap
         FROM (SELECT {key}, t, lead(t) OVER (PARTITION BY {key} ORDER BY t) - t AS gap FROM angles) a GROUP BY {key})"""


@register("surface_linear")
def q_surface_linear(spark, sf_dir):
    """Linear surface on the multibeam view (rows-only; exactness is tested
    against one global triangulation in tests/test_surface_linear.py)."""
    return r6(su.surface_linear(_mbes(spark, sf_dir), SURFACE))


@register("surface_linear_plane", _at(SURFACE, _with(_cells(SURFACE, True) + """,
grid AS (SELECT survey_id, row, col, lat, min_lon + col * CAST(0.01 AS DOUBLE) AS lon FROM nodes),
angles AS (SELECT g.survey_id, g.row, g.col, CASE WHEN p.latitude <> g.lat OR p.longitude <> g.lon THEN atan2(p.latitude - g.lat, p.longitude - g.lon) END AS t
           FROM grid g JOIN pts p ON g.survey_id = p.survey_id),
hits AS (SELECT survey_id, row, col, bool_or(t IS NULL) AS hit FROM angles GROUP BY ALL),""" + _GAPS.format(key="survey_id, row, col"), """
SELECT g.survey_id, g.row, g.col, CASE WHEN hit OR gap <= pi() + 1e-9 THEN round(3 * lon - 2 * lat, 6) END AS z,
       CASE WHEN hit OR gap <= pi() + 1e-9 THEN 'linear' ELSE 'outside' END AS method
FROM grid g JOIN hits h ON g.survey_id = h.survey_id AND g.row = h.row AND g.col = h.col
JOIN gaps a ON g.survey_id = a.survey_id AND g.row = a.row AND g.col = a.col""")), ("soundings_mbes",))
def q_surface_plane(spark, sf_dir):
    """Linear surface of soundings on a plane: the plane at each node inside the
    hull, whatever the triangles, and NULL outside."""
    plane = F.when(F.col("depth").isNotNull(), 3 * F.col("longitude") - 2 * F.col("latitude"))
    return r6(su.surface_linear(_mbes(spark, sf_dir).withColumn("depth", plane), SURFACE).drop("lat", "lon"))


@register("triangulation")
def q_triangulation(spark, sf_dir):
    return su.triangulation(_mbes(spark, sf_dir), SURFACE)


@register("triangulation_counts", _with(_cells(SURFACE, True) + """,
places AS (SELECT DISTINCT survey_id, latitude, longitude FROM pts),
angles AS (SELECT p.survey_id, p.latitude, p.longitude, atan2(q.latitude - p.latitude, q.longitude - p.longitude) AS t
           FROM places p JOIN places q ON p.survey_id = q.survey_id AND (p.latitude <> q.latitude OR p.longitude <> q.longitude)),"""
          + _GAPS.format(key="survey_id, latitude, longitude"), """
SELECT survey_id, count(*) AS locations, 2 * count(*) - 2 - count(*) FILTER (WHERE gap >= pi() - 1e-12) AS triangles
FROM gaps GROUP BY survey_id"""), ("soundings_mbes",))
def q_triangulation_counts(spark, sf_dir):
    """Distinct locations and triangles of each survey; by Euler's formula the
    triangles are twice the locations less 2 and less those on the hull."""
    df = _mbes(spark, sf_dir)
    n = (su.valid_points(df, "depth").select("survey_id", "latitude", "longitude").distinct()
         .groupBy("survey_id").agg(F.count(F.lit(1)).alias("locations")))
    t = su.triangulation(df, SURFACE).groupBy("survey_id").agg(F.count(F.lit(1)).alias("triangles"))
    return join_null_safe(n, t, ["survey_id"])


@register("surface_build")
def q_surface_build(spark, sf_dir):
    """Surface step of a conversion: z column choice, valid points, bounds and
    the interpolated grid with its generation metadata (rows-only)."""
    from fathom.plans.convert import build_surface
    return build_surface(view(spark, sf_dir, "points_lidar"), "lidar", 0.001, method="nearest")
