"""Point -> grid binning and attributed grids.

Cells are keyed by integer (row, col) from the survey's minimum latitude /
longitude: ``row = int((lat - min_lat) / res)`` exactly as the reference
computes it (same IEEE operations, double literals).  All cell attributes
are hash aggregates on (survey, row, col) with map-side combine; node axes
are generated per survey and spread over tasks before the second explode, so a
large survey never builds its dense grid in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import join_null_safe, join_surveys
from fathom.operators.ordered import sequence
from fathom.session import materialize_small

RESOLUTION = 0.001  # degrees, the reference's grid resolution


def z_column(df: DataFrame, sensor: str | None = None) -> str:
    """Exporters use elevation iff lidar; the surface uses depth if present."""
    if sensor is not None:
        return "elevation" if sensor == "lidar" else "depth"
    return "depth" if "depth" in df.columns else "elevation"


def z_value(df: DataFrame, sensor: str | None = None) -> Column:
    c = z_column(df, sensor)
    return F.col(c) if c in df.columns else F.lit(None).cast("double")


def drop_null_xyz(df: DataFrame, z: str) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(z).isNotNull())


def axis_length(lo: Column, hi: Column, res: float) -> Column:
    """Length of ``np.arange(lo, hi + res, res)``: ceil((hi + res - lo) / res)."""
    return F.ceil(((hi + F.lit(res)) - lo) / F.lit(res)).cast("int")


def grid_bounds(points: DataFrame, res: float = RESOLUTION, valid_col: str | None = None) -> DataFrame:
    """Per survey: bounds, axis lengths, resolution, point count (small)."""
    b = points.groupBy("survey_id").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        (F.count(valid_col) if valid_col else F.count(F.lit(1))).alias("valid_points"))
    return b.withColumns({
        "n_rows": axis_length(F.col("min_lat"), F.col("max_lat"), res),
        "n_cols": axis_length(F.col("min_lon"), F.col("max_lon"), res),
        "resolution": F.lit(res)})


def cell_index(points: DataFrame, bounds: DataFrame, res: float = RESOLUTION) -> DataFrame:
    """Attach (row, col); keep points inside the grid shape.  ``bounds`` is
    one row per survey, broadcast when small."""
    j = join_surveys(points, bounds.select("survey_id", "min_lat", "min_lon", "n_rows", "n_cols"))
    row = F.floor((F.col("latitude") - F.col("min_lat")) / F.lit(res)).cast("int")
    col = F.floor((F.col("longitude") - F.col("min_lon")) / F.lit(res)).cast("int")
    j = j.withColumns({"row": row, "col": col})
    return j.where((F.col("row") >= 0) & (F.col("row") < F.col("n_rows"))
                   & (F.col("col") >= 0) & (F.col("col") < F.col("n_cols")))


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def survey_grid_bounds(df: DataFrame, res: float = RESOLUTION) -> DataFrame:
    """Grid bounds of the soundings with coordinates, materialised once (one
    row per survey) because binning, coordinates and densifying all read it."""
    return materialize_small(grid_bounds(located(df).select("survey_id", "latitude", "longitude"), res))


def binned_points(df: DataFrame, sensor: str, res: float = RESOLUTION,
                  bounds: DataFrame | None = None) -> DataFrame:
    """Soundings with z and (row, col), bounds from the points with coordinates."""
    pts = located(df).select("survey_id", "idx", "latitude", "longitude", z_value(df, sensor).alias("z"))
    return cell_index(pts, bounds if bounds is not None else survey_grid_bounds(df, res), res)


EXACT_MEAN_TYPE = "decimal(38,18)"


def exact_mean(c: str) -> Column:
    """Mean over the decimal values of ``c``: the sum is exact, so the result
    does not depend on partitioning or on the order partial sums arrive in
    (a double sum does, in its last bits).  Values that do not fit the decimal
    type (|x| >= 1e20) fall back to the double mean."""
    d = F.col(c).try_cast(EXACT_MEAN_TYPE)
    return F.when(F.count(d) == F.count(c), F.avg(d).cast("double")).otherwise(F.avg(c))


def cell_stats(binned: DataFrame) -> DataFrame:
    """density, true mean, uncertainty (1.0 where populated) per cell."""
    return binned.groupBy("survey_id", "row", "col").agg(
        F.count(F.lit(1)).alias("density"), exact_mean("z").alias("elevation_mean"),
        F.lit(1.0).alias("uncertainty"))


def running_average(binned: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The reference's order-dependent cell value e <- (e + z) / 2 in file order.

    Closed form: after the last NULL of a cell (a NULL makes the cell NULL and
    the next point restarts it), the m remaining points get weights
    2^-(m-1) for the first and 2^-r for the others (r = rank from the end).
    Ranks and the last NULL's position come from :func:`sequence` (its
    per-slice summary), which splits hot cells across tasks; one aggregate
    over the ranked points finishes the cell values.  Its terms are scaled by
    powers of two and summed as decimals, without rounding, so the result has
    the same bits for any partitioning; values of 1e20 and more sum as doubles.
    """
    order = order or ["idx"]
    keys = ["survey_id", "row", "col"]
    s = (sequence(binned.select(*keys, *order, "z"), by=keys, order=order, count_col="n", last_null_of="z")
         .withColumnRenamed("last_null_pos", "last_null"))
    m = F.col("n") - 1 - F.col("last_null")
    r = F.col("n") - F.col("pos")
    w = F.when(r == m, F.pow(F.lit(2.0), -(m - 1))).otherwise(F.pow(F.lit(2.0), -r))
    term = F.when(F.col("pos") > F.col("last_null"), w * F.col("z"))
    exact = term.try_cast(EXACT_MEAN_TYPE)
    total = F.when(F.count(exact) == F.count(term), F.sum(exact).cast("double")).otherwise(F.sum(term))
    return (s.groupBy(*keys)
             .agg(total.alias("elevation_running"),
                  F.max(F.col("last_null") == F.col("n") - 1).alias("_ends_null"))
             .select(*keys, F.when(F.col("_ends_null"), F.lit(None).cast("double"))
                     .otherwise(F.col("elevation_running")).alias("elevation_running")))


def attributed_grid(df: DataFrame, sensor: str, res: float = RESOLUTION,
                    method: str = "mean", bounds: DataFrame | None = None) -> DataFrame:
    """Sparse attributed grid: (survey, row, col, lat, lon, elevation,
    uncertainty, density).  ``method='running'`` reproduces the reference's
    running average; ``'mean'`` is the true cell mean."""
    bounds = bounds if bounds is not None else survey_grid_bounds(df, res)
    b = binned_points(df, sensor, res, bounds)
    cells = cell_stats(b)
    if method == "running":
        cells = join_null_safe(cells, running_average(b), ["survey_id", "row", "col"])
        elev = F.col("elevation_running")
    else:
        elev = F.col("elevation_mean")
    return (join_null_safe(cells, bounds.select("survey_id", "min_lat", "min_lon"), ["survey_id"])
                 .select("survey_id", "row", "col",
                         (F.col("min_lat") + F.col("row") * F.lit(res)).alias("lat"),
                         (F.col("min_lon") + F.col("col") * F.lit(res)).alias("lon"),
                         elev.alias("elevation"), "uncertainty", "density"))


def grid_nodes(bounds: DataFrame, res: float = RESOLUTION) -> DataFrame:
    """Every node of every survey grid: (survey, row, col, lat, lon).

    Rows are exploded first (n_rows per survey) and hash-spread on
    (survey, row) before the columns are exploded, so a large survey's
    nodes are generated by many tasks.
    """
    rows = bounds.select("survey_id", "min_lat", "min_lon", "n_cols",
                         F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    rows = rows.repartition("survey_id", "row")
    nodes = rows.select("survey_id", "row", "min_lat", "min_lon",
                        F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return nodes.select("survey_id", "row", "col",
                        (F.col("min_lat") + F.col("row") * F.lit(res)).alias("lat"),
                        (F.col("min_lon") + F.col("col") * F.lit(res)).alias("lon"))


def densify(grid: DataFrame, bounds: DataFrame, res: float = RESOLUTION) -> DataFrame:
    """Dense grid: every node, NULL elevation/uncertainty and 0 density where empty."""
    nodes = grid_nodes(bounds, res)
    g = grid.select("survey_id", "row", "col", "elevation", "uncertainty", "density")
    return (join_null_safe(nodes, g, ["survey_id", "row", "col"], "left")
                 .withColumn("density", F.coalesce(F.col("density"), F.lit(0)).cast("long")))


def raster_bands(dense: DataFrame) -> DataFrame:
    """Long-form 3-band float32 raster: (survey, band, row, col, value)."""
    return dense.select("survey_id", "row", "col", F.expr(
        "stack(3, 'elevation', CAST(elevation AS FLOAT), 'uncertainty', CAST(uncertainty AS FLOAT), "
        "'density', CAST(density AS FLOAT)) AS (band, value)"))


def raster_info(bands: DataFrame, bounds: DataFrame) -> DataFrame:
    """width, height, band count, bounds, pixel size, nodata per raster."""
    shape = bands.groupBy("survey_id").agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"),
        F.countDistinct("band").alias("band_count"))
    return (join_null_safe(shape, bounds.select("survey_id", "min_lat", "max_lat", "min_lon", "max_lon"), ["survey_id"])
                 .withColumns({
                     "pixel_width": (F.col("max_lon") - F.col("min_lon")) / F.col("width"),
                     "pixel_height": (F.col("max_lat") - F.col("min_lat")) / F.col("height"),
                     "crs": F.lit("EPSG:4326"), "nodata": F.lit(float("nan"))}))


def grid_rank(binned: DataFrame) -> DataFrame:
    """Rank of each point inside its cell in file order (1-based) and the cell size."""
    keys = ["survey_id", "row", "col"]
    s = sequence(binned.select(*keys, "idx"), by=keys, order=["idx"], count_col="cell_points")
    return s.select(*keys, "idx", (F.col("pos") + 1).alias("cell_rank"), "cell_points")

