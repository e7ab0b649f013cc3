"""Interpolated surfaces: every grid node gets the value of its nearest
sounding (planar distance in degrees, ties -> lowest idx), without a
cartesian product.

Nearest node join:

* soundings at the same coordinate collapse to the lowest idx first (a
  "group of copies" holding a third of the rows becomes one candidate);
* a survey's locations are ranked along a Z-order curve; runs of ``BOX``
  locations are boxes with their own tight bounds, runs of ``FANOUT`` boxes are
  boxes of the next level: a packed tree whose boxes follow the density, so a
  dense spot is many small boxes and a far-off fix shares none with it;
* nodes search in blocks of ``BLOCK`` x ``BLOCK``, from the top level down: the
  nearest sounding of each node of a block is no farther than the least of the
  boxes' greatest distances, and boxes that start beyond that go, with all below
  them.  A block whose bounds leave more than ``FANOUT`` boxes is wide for their
  level (a far node next to one of a dense spot), so its nodes go on one by one;
  a block or a node meets ``FANOUT`` children of a few boxes at a level, never a
  level's boxes;
* each node drops more of these by its own bounds and is compared with the
  locations of the others, ``min_by`` over (distance, idx): the brute-force
  answer, ties included.

Work is bounded by boxes near a block, whatever the density.  One plan, no
rounds on the driver but the number of levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.grid import RESOLUTION, grid_bounds, grid_nodes
from fathom.operators.joins import join_null_safe, join_surveys
from fathom.operators.ordered import sequence
from fathom.session import checkpoint_dir, materialize_small

EDGE_EPS = 1e-9  # degrees; keeps the bounds conservative under rounding
#: Locations of a box, boxes of a box of the next level, nodes on a block's side.
BOX = 32
FANOUT = 16
BLOCK = 8
_BITS = 26


def valid_points(df: DataFrame, z: str) -> DataFrame:
    return (df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(z).isNotNull())
              .select("survey_id", "idx", "latitude", "longitude", F.col(z).cast("double").alias("z")))


def _distinct_locations(pts: DataFrame) -> DataFrame:
    # Two plain columns instead of one struct: a hash aggregate, no sort of the soundings.
    return pts.groupBy("survey_id", "latitude", "longitude").agg(F.min("idx").alias("idx"), F.min_by("z", "idx").alias("z"))


def _z_order(df: DataFrame) -> DataFrame:
    """Adds ``curve``, the place on the Z-order curve over the survey's bounds.
    Each step that moves a number's bits one place apart reads the last one
    twice, so it is a projection of its own: nested, the steps double."""
    def steps(v, lo, hi):
        v, lo, hi = F.col(v), F.col(lo), F.col(hi)
        return F.coalesce(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float((1 << _BITS) - 1))), F.lit(0)).cast("long")

    df = df.withColumns({"_x": steps("longitude", "min_lon", "max_lon"), "_y": steps("latitude", "min_lat", "max_lat")})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_x", "_y")})
    return df.withColumn("curve", F.col("_x").bitwiseOR(F.shiftleft("_y", 1))).drop("_x", "_y")


def _gap(lo, hi, first, last):
    """Distance along an axis between [lo, hi] and [first, last]."""
    return F.greatest(F.lit(0.0), first - hi, lo - last)


def _reach(lo, hi, first, last):
    """Greatest distance along an axis between points of the two ranges."""
    return F.greatest(last - lo, hi - first)


def _bounds(x0, x1, y0, y1, box):
    """Least and greatest distance between a rectangle and a box."""
    gx, gy = _gap(x0, x1, box["x0"], box["x1"]), _gap(y0, y1, box["y0"], box["y1"])
    rx, ry = _reach(x0, x1, box["x0"], box["x1"]), _reach(y0, y1, box["y0"], box["y1"])
    return F.sqrt(gx * gx + gy * gy), F.sqrt(rx * rx + ry * ry)


def _near(df: DataFrame, x0, x1, y0, y1) -> DataFrame:
    """Keep of the array ``boxes`` those that may hold the nearest location of a point of the rectangle."""
    most = F.array_min(F.transform("boxes", lambda b: _bounds(x0, x1, y0, y1, b)[1]))
    # Exploded from an array of one, the bound is computed once a row, not once a box.
    df = df.select("*", F.explode(F.array(most)).alias("most"))
    return df.withColumn("boxes", F.filter("boxes", lambda b: _bounds(x0, x1, y0, y1, b)[0] <= F.col("most") + F.lit(EDGE_EPS))).drop("most")


def nearest_node_join(nodes: DataFrame, pts: DataFrame, bounds: DataFrame, res: float = RESOLUTION) -> DataFrame:
    """(survey, row, col, lat, lon) x soundings -> nearest sounding per node."""
    checkpoint_dir(nodes.sparkSession)
    locs = join_surveys(_distinct_locations(pts), bounds.select("survey_id", "min_lat", "max_lat", "min_lon", "max_lon"))
    locs = _z_order(locs).select("survey_id", "idx", "latitude", "longitude", "z", "curve")
    placed = sequence(locs, by=["survey_id"], order=["curve", "idx"]).withColumn("box", F.floor(F.col("pos") / BOX).cast("long"))
    rect = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    leaves = (placed.groupBy("survey_id", "box").agg(
        F.min("longitude").alias("x0"), F.max("longitude").alias("x1"), F.min("latitude").alias("y0"), F.max("latitude").alias("y1"),
        F.collect_list(F.struct("longitude", "latitude", "idx", "z")).alias("locations")).checkpoint(eager=True))
    last = leaves.agg(F.max("box")).first()[0] or 0
    levels = [leaves.drop("locations")]
    while last > 0:
        last //= FANOUT
        up = F.floor(F.col("box") / FANOUT ** len(levels)).cast("long").alias("box")
        levels.append(leaves.groupBy("survey_id", up).agg(*rect))

    # Blocks of nodes come down the levels with the boxes that may be nearest.
    key = ["survey_id", F.floor(F.col("row") / BLOCK), F.floor(F.col("col") / BLOCK)]
    blocks = nodes.groupBy(*key).agg(F.collect_list(F.struct("row", "col", "lat", "lon")).alias("members"))
    found = blocks.select("survey_id", "members", F.lit(0).cast("long").alias("up"))
    sides = ["bx0", "bx1", "by0", "by1"]
    box = F.struct("box", "x0", "x1", "y0", "y1")

    def sided(df: DataFrame) -> DataFrame:
        """The bounds of each row's nodes, and its first node, which tells it from other rows."""
        of = {"bx0": F.array_min("members.lon"), "bx1": F.array_max("members.lon"), "by0": F.array_min("members.lat"), "by1": F.array_max("members.lat")}
        return df.withColumns({**of, "first": F.array_min("members")})

    found = sided(found)
    for boxes in levels[::-1]:
        children = boxes.groupBy("survey_id", F.floor(F.col("box") / FANOUT).cast("long").alias("up")).agg(F.collect_list(box).alias("boxes"))
        found = (join_null_safe(found, children, ["survey_id", "up"]).groupBy("survey_id", "first", *sides)
                 .agg(F.first("members").alias("members"), F.flatten(F.collect_list("boxes")).alias("boxes")))
        found = _near(found, *map(F.col, sides))
        parts = F.when(F.size("boxes") > FANOUT, F.transform("members", lambda m: F.array(m))).otherwise(F.array("members"))
        found = _near(sided(found.select("survey_id", "boxes", F.explode(parts).alias("members"))), *map(F.col, sides))
        if boxes is not levels[0]:
            found = found.select("survey_id", "first", "members", *sides, F.explode("boxes.box").alias("up"))

    cell = ["survey_id", "row", "col"]
    found = found.select("survey_id", "boxes", F.explode("members").alias("m")).select("survey_id", "m.*", "boxes")
    lon, lat = F.col("lon"), F.col("lat")
    found = _near(found, lon, lon, lat, lat).select(*cell, "lat", "lon", F.explode("boxes.box").alias("box"))
    found = join_null_safe(found, leaves.select("survey_id", "box", "locations"), ["survey_id", "box"])

    def distance(p):
        dx, dy = p["longitude"] - lon, p["latitude"] - lat
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), p["idx"].alias("idx"), p["z"].alias("z"))

    best = F.array_min(F.transform("locations", distance))
    return (found.select(*cell, "lat", "lon", best.alias("best")).groupBy(*cell, "lat", "lon").agg(F.min("best").alias("best"))
            .select(*cell, "lat", "lon", F.col("best.z").alias("z"), F.col("best.idx").alias("src_idx")))


def surface_nearest(df: DataFrame, res: float = RESOLUTION, z: str | None = None) -> DataFrame:
    """Every node of each survey's grid with its nearest valid sounding's value."""
    z = z or ("depth" if "depth" in df.columns else "elevation")
    pts = valid_points(df, z)
    bounds = materialize_small(grid_bounds(pts, res))
    nodes = grid_nodes(bounds, res)
    return nearest_node_join(nodes, pts, bounds, res).withColumn("method", F.lit("nearest"))


def surface_bounds(df: DataFrame, res: float = RESOLUTION, z: str | None = None) -> DataFrame:
    """bounds, shape, resolution and valid point count of each survey's surface."""
    z = z or ("depth" if "depth" in df.columns else "elevation")
    return grid_bounds(valid_points(df, z), res)


_LINEAR = ("surface_linear", "triangulation")


def __getattr__(name):
    """The Delaunay-based surface lives in ``surface_linear``; re-exported
    lazily so either module can be imported first."""
    if name in _LINEAR:
        from fathom.operators import surface_linear
        return getattr(surface_linear, name)
    raise AttributeError(name)
