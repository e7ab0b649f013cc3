"""Delaunay triangulation of each survey's soundings and the piecewise-linear
surface over it.

A survey's locations are cut into tiles of about ``TILE_POINTS`` by their own
ranks (strips of equal count along the longitude, then along the latitude inside
a strip), so clusters and far-off fixes make no large tile.  Each tile is
triangulated by itself.  A triangle is final when its circle lies in the open
rectangle that holds no other tile's locations.  What a tile hands on are the
vertices of its other triangles and of its hull, and the edges around its final
part; blocks of tiles are triangulated from these alone.  All triangles that are
not final yet have only such vertices, and the edges tell which triangles of the
block merely span a part that is final already.  So every block adds exactly the
triangles that cross its tiles, and the last block, with the whole plane as its
rectangle, adds the rest: those over gaps and along the hull.

A block has the locations near its tiles' borders, about the square root of
their number.  Soundings almost on one line, whose circles are all large, are
the exception: most of them stay until the last block.

The surface is read off the triangles: each covers the nodes of its rows between
its two edges there, which needs no join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.delaunay import Triangulation, circles_within
from fathom.operators.grid import RESOLUTION, grid_bounds, grid_nodes
from fathom.operators.joins import join_null_safe
from fathom.operators.ordered import sequence
from fathom.operators.surface import _distinct_locations, nearest_node_join, valid_points
from fathom.session import checkpoint_dir, ship_package

TILE_POINTS = 1000
#: Tiles, then strips, that make a block.
FANOUT = 4
#: How far outside a triangle, as a share of it, a node still counts as on its edge.
EDGE = 1e-9

_VERTICES = [f"{v}{c}" for v in "abc" for c in "xyz"]
_RECT = ["x0", "x1", "y0", "y1"]
#: Rows of a tile: ``point`` (a, with ax ay az), ``edge`` (a to b, its final part on the left), ``triangle``.
_STATE = ["key", "strip", "tile", "kind", "a", "b", "c", *_VERTICES, *_RECT]
_SCHEMA = ", ".join(["key string, strip long, tile long, kind string, a long, b long, c long",
                     *[f"{c} double" for c in [*_VERTICES, *_RECT]]])


def settle(part: pd.DataFrame) -> pd.DataFrame:
    """Triangulate a block: its new final triangles, and what it hands on."""
    points = part[part["kind"] == "point"].sort_values("a", ignore_index=True)
    ids = points["a"].to_numpy(np.int64)
    x, y, z = (points[c].to_numpy(float) for c in ("ax", "ay", "az"))
    region = (part["x0"].min(), part["x1"].max(), part["y0"].min(), part["y1"].max())
    mesh = Triangulation(x, y, ids)
    tri = mesh.triangles()
    left = {e: t for t, (a, b, c) in enumerate(tri.tolist()) for e in ((a, b), (b, c), (c, a))}
    final = circles_within(x, y, tri, region)

    # Triangles over what is final already: from its edges on, up to its edges.
    known = part[part["kind"] == "edge"]
    rim = set(zip(np.searchsorted(ids, known["a"].to_numpy(np.int64)).tolist(), np.searchsorted(ids, known["b"].to_numpy(np.int64)).tolist(), strict=True))
    old = np.zeros(len(tri), bool)
    stack = [left[e] for e in rim]
    while stack:
        t = stack.pop()
        if not old[t]:
            old[t] = True
            a, b, c = tri[t].tolist()
            stack += [left[v, u] for u, v in ((a, b), (b, c), (c, a)) if (u, v) not in rim and (v, u) in left]

    new = tri[final & ~old]
    new = np.take_along_axis(new, np.argsort(ids[new], axis=1), axis=1)
    out = [pd.DataFrame({"kind": "triangle", **{v: ids[new[:, k]] for k, v in enumerate("abc")},
                         **{f"{v}{c}": w[new[:, k]] for k, v in enumerate("abc") for c, w in (("x", x), ("y", y), ("z", z))}})]
    if np.isfinite(region).any():
        done = final | old
        edges, stays = [], np.zeros(len(ids), bool)
        stays[tri[~done]] = True
        if not len(tri):
            stays[:] = True
        for (u, v), t in left.items():
            other = left.get((v, u))
            if other is None:
                stays[[u, v]] = True
            if done[t] and (other is None or not done[other]):
                edges.append((ids[u], ids[v]))
        out.append(pd.DataFrame({"kind": "point", "a": ids[stays], "ax": x[stays], "ay": y[stays], "az": z[stays]}))
        out.append(pd.DataFrame(edges, columns=["a", "b"]).assign(kind="edge"))
    out = pd.concat([o.astype({c: "Int64" for c in "abc" if c in o}) for o in out if len(o)], ignore_index=True) if any(map(len, out)) else pd.DataFrame()
    out = out.reindex(columns=_STATE)
    out["key"], out["strip"], out["tile"] = part["key"].iloc[0], part["strip"].iloc[0], part["tile"].iloc[0]
    out[_RECT] = region
    return out.astype({"key": object, "kind": object})


def _tiles(locs: DataFrame) -> DataFrame:
    """Locations with strip, tile and the open rectangle around the tile that holds no other tile's."""
    side = F.ceil(F.sqrt(F.col("n") / F.lit(float(TILE_POINTS))))
    rows = locs.select(F.col("survey_id").cast("string").alias("key"), "idx", F.col("longitude").alias("ax"), F.col("latitude").alias("ay"), F.col("z").alias("az"))
    rows = sequence(rows, by=["key"], order=["ax", "ay"], count_col="n").withColumn("side", side)
    rows = rows.withColumn("strip", F.floor(F.col("pos") * F.col("side") / F.col("n"))).drop("pos", "n")
    rows = sequence(rows, by=["key", "strip"], order=["ay", "ax"], count_col="n")
    rows = rows.withColumn("tile", F.floor(F.col("pos") * F.col("side") / F.col("n"))).drop("pos", "n", "side")

    def between(by: list[str], at: str, c: str, names: tuple[str, str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(at)
        ends = rows.groupBy(*by, at).agg(F.min(c).alias("first"), F.max(c).alias("last"))
        return ends.select(*by, at, F.coalesce(F.lag("last").over(w), F.lit(float("-inf"))).alias(names[0]),
                           F.coalesce(F.lead("first").over(w), F.lit(float("inf"))).alias(names[1]))

    rows = join_null_safe(rows, between(["key"], "strip", "ax", ("x0", "x1")), ["key", "strip"])
    rows = join_null_safe(rows, between(["key", "strip"], "tile", "ay", ("y0", "y1")), ["key", "strip", "tile"])
    none = {c: F.lit(None).cast("long") for c in "bc"} | {c: F.lit(None).cast("double") for c in _VERTICES[3:]}
    return rows.withColumns({"kind": F.lit("point"), "a": F.col("idx"), **none}).select(*_STATE)


def _triangles(locs: DataFrame) -> DataFrame:
    """(survey_id, a < b < c, their coordinates and values) of all surveys."""
    checkpoint_dir(locs.sparkSession)
    ship_package(locs.sparkSession)
    kind = locs.schema["survey_id"].dataType
    state = _tiles(locs).checkpoint(eager=True)
    most = state.agg(F.max("tile"), F.max("strip")).first()
    found = []
    levels = [("tile", most[0] or 0), ("strip", most[1] or 0)]
    state = state.groupBy("key", "strip", "tile").applyInPandas(settle, _SCHEMA).checkpoint(eager=True)
    for name, last in levels:
        while last > 0:
            found.append(state.where(F.col("kind") == "triangle"))
            last //= FANOUT
            state = (state.where(F.col("kind") != "triangle").withColumn(name, F.floor(F.col(name) / FANOUT))
                     .groupBy("key", "strip", "tile").applyInPandas(settle, _SCHEMA).checkpoint(eager=True))
    out = state.where(F.col("kind") == "triangle")
    for f in found:
        out = out.unionByName(f)
    return out.select(F.col("key").cast(kind).alias("survey_id"), "a", "b", "c", *_VERTICES)


def _covered(triangles: DataFrame, bounds: DataFrame, res: float) -> DataFrame:
    """(survey_id, row, col, z) of the nodes in triangles: rows of a triangle
    first, then the columns between its edges there; of the triangles that share
    a node's edge the least (a, b, c) counts."""
    t = join_null_safe(triangles, bounds.select("survey_id", "min_lat", "min_lon", "n_rows", "n_cols"), ["survey_id"])

    def span(least, most, start, count):
        """Numbers of the axis places within [least, most], one more on each side for rounding."""
        first = F.greatest(F.floor((least - F.col(start)) / res) - 1, F.lit(0))
        last = F.least(F.ceil((most - F.col(start)) / res) + 1, F.col(count) - 1)
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    ax, ay, az, bx, by, bz, cx, cy, cz = map(F.col, _VERTICES)
    t = t.select("*", F.explode(span(F.least(ay, by, cy), F.greatest(ay, by, cy), "min_lat", "n_rows")).alias("row"))
    t = t.withColumn("lat", F.col("min_lat") + F.col("row") * F.lit(res))

    def crossing(px, py, qx, qy):
        """Where the row meets an edge; the edge's ends where it has no height there."""
        share = F.least(F.greatest((F.col("lat") - py) / F.nullif(qy - py, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return px + (qx - px) * share, px, qx, F.col("lat").between(F.least(py, qy) - F.lit(res), F.greatest(py, qy) + F.lit(res))

    lows, highs = [], []
    for e in (crossing(ax, ay, bx, by), crossing(bx, by, cx, cy), crossing(cx, cy, ax, ay)):
        at, p, q, near = e
        lows.append(F.when(near, F.coalesce(at, F.least(p, q))))
        highs.append(F.when(near, F.coalesce(at, F.greatest(p, q))))
    t = t.withColumns({"west": F.least(*lows), "east": F.greatest(*highs)}).where(F.col("west").isNotNull())
    # A large triangle's rows go to many tasks before their columns are written out.
    t = t.repartition("survey_id", "a", "b", "c", "row")
    t = t.select("*", F.explode(span(F.col("west"), F.col("east"), "min_lon", "n_cols")).alias("col"))
    px, py = F.col("min_lon") + F.col("col") * F.lit(res), F.col("lat")
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    t = t.withColumns({"l1": ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det,
                       "l2": ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det})
    t = t.withColumn("l3", F.lit(1.0) - F.col("l1") - F.col("l2")).where(F.least("l1", "l2", "l3") >= -EDGE)
    z = F.col("l1") * az + F.col("l2") * bz + F.col("l3") * cz
    return t.groupBy("survey_id", "row", "col").agg(F.min_by(z, F.struct("a", "b", "c")).alias("z"))


def surface_linear(df: DataFrame, res: float = RESOLUTION, z: str | None = None) -> DataFrame:
    """Every node: linear interpolation in the Delaunay triangle containing it;
    NULL outside the convex hull; surveys with < 3 valid points or collinear
    points fall back to the nearest sounding (as the reference does).

    ``method`` is 'linear', 'outside' or 'nearest'.  A NULL survey is a survey."""
    z = z or ("depth" if "depth" in df.columns else "elevation")
    pts = valid_points(df, z)
    bounds = grid_bounds(pts, res)
    triangles = _triangles(_distinct_locations(pts))
    has = triangles.select("survey_id").distinct().withColumn("has", F.lit(True))
    bounds = join_null_safe(bounds, has, ["survey_id"], "left").checkpoint(eager=True)
    keys = ["survey_id", "row", "col"]
    nodes = grid_nodes(bounds.where("has"), res)
    out = join_null_safe(nodes, _covered(triangles, bounds, res), keys, "left").select(
        *keys, "lat", "lon", "z", F.when(F.col("z").isNull(), "outside").otherwise("linear").alias("method"))
    flat = bounds.where("has IS NULL").drop("has")
    if flat.isEmpty():
        return out
    flat_pts = join_null_safe(pts, flat.select("survey_id"), ["survey_id"], "left_semi")
    near = nearest_node_join(grid_nodes(flat, res), flat_pts, flat, res)
    return out.unionByName(near.select(*keys, "lat", "lon", "z", F.lit("nearest").alias("method")))


def triangulation(df: DataFrame, res: float = RESOLUTION, z: str | None = None) -> DataFrame:
    """Delaunay triangles of each survey's valid soundings (survey, a < b < c as
    sounding idx), each once.  Of soundings at one place the least idx counts;
    where four lie on one circle, the least idx decides.  A survey whose
    soundings are on one line has none."""
    z = z or ("depth" if "depth" in df.columns else "elevation")
    return _triangles(_distinct_locations(valid_points(df, z))).select("survey_id", "a", "b", "c")
