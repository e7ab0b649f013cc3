"""Tiled linear surface and triangulation equal one global triangulation."""

from fractions import Fraction

import numpy as np
import pytest

from fathom.functions.delaunay import Triangulation
from fathom.operators import surface as su
from fathom.operators import surface_linear as sl

SOUNDINGS = "survey_id long, idx long, latitude double, longitude double, depth double"


def delaunay(x, y):
    """One triangulation of all points."""
    return Triangulation(x, y, np.arange(len(x))).triangles()


def hull(x, y):
    """Points on the convex hull's boundary, counter-clockwise, without rounding."""
    pts = sorted({(Fraction(a), Fraction(b)) for a, b in zip(x.tolist(), y.tolist())})

    def half(points):
        h = []
        for p in points:
            while len(h) >= 2 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) < (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)
        return h
    return half(pts)[:-1] + half(pts[::-1])[:-1]


def locate_linear(x, y, z, tri, qx, qy, tol=1e-9):
    """Linear interpolation in the triangle around each point, NaN outside."""
    out = np.full(len(qx), np.nan)
    ax, ay, bx, by, cx, cy = (v[tri[:, k]] for k in range(3) for v in (x, y))
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    for i, (px, py) in enumerate(zip(qx, qy)):
        l1 = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
        l2 = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
        inside = np.flatnonzero((l1 >= -tol) & (l2 >= -tol) & (1 - l1 - l2 >= -tol))
        if len(inside):
            t = inside[0]
            out[i] = l1[t] * z[tri[t, 0]] + l2[t] * z[tri[t, 1]] + (1 - l1[t] - l2[t]) * z[tri[t, 2]]
    return out


def complete(got, x, y):
    """Distinct triangles with empty circles that fill the hull, by Euler's formula and by area."""
    tri = np.array(got)
    h = hull(x, y)
    assert len(set(got)) == len(got) == 2 * len(x) - 2 - len(h)
    ax, ay, bx, by, cx, cy = (v[tri[:, k]] for k in range(3) for v in (x, y))
    area = np.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).sum() / 2
    whole = float(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1])) / 2)
    assert abs(area - whole) < 1e-9 * max(1.0, whole)


def soundings(spark, x, y, z=None, survey=1):
    rows = [(survey, i, float(y[i]), float(x[i]), float(i % 7 if z is None else z[i])) for i in range(len(x))]
    kind = "string" if isinstance(survey, str) else "long"
    return spark.createDataFrame(rows, SOUNDINGS.replace("survey_id long", f"survey_id {kind}"))


def triangles(df, res=0.01):
    return [tuple(r) for r in su.triangulation(df, res).select("a", "b", "c").collect()]


def _rows():
    rng = np.random.default_rng(3)
    rows = []
    for s, n in ((1, 2500), (2, 150)):
        x = -74 + rng.random(n) * 0.2
        y = 40 + rng.random(n) * 0.1
        rows += [(s, i, float(y[i]), float(x[i]), float(3 * x[i] - 2 * y[i] + (i % 7))) for i in range(n)]
    rows += [(3, i, 41.0 + i * 0.001, -70.0 + i * 0.002, float(i)) for i in range(10)]  # collinear
    return rows


def test_kernel_empty_circles():
    """Exact, with points on lines, circles and a far fix."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.random(40), np.arange(8) / 8, np.zeros(8), 1e6]
    y = np.r_[rng.random(40), np.zeros(8), np.arange(1, 9) / 8, 3.0]
    got = [tuple(sorted(t)) for t in delaunay(x, y).tolist()]
    complete(got, x, y)
    fx, fy = [Fraction(v) for v in x.tolist()], [Fraction(v) for v in y.tolist()]
    for a, b, c in got:
        bx, by, cx, cy = fx[b] - fx[a], fy[b] - fy[a], fx[c] - fx[a], fy[c] - fy[a]
        det = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / det, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / det
        assert all((fx[i] - fx[a] - ux) ** 2 + (fy[i] - fy[a] - uy) ** 2 >= ux * ux + uy * uy for i in range(len(x)))


def test_linear_surface_equals_global(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    out = su.surface_linear(df, 0.005).toPandas()
    assert set(out[out.survey_id == 3].method) == {"nearest"}
    for s in (1, 2):
        g = [r for r in rows if r[0] == s]
        x = np.array([r[3] for r in g]); y = np.array([r[2] for r in g]); z = np.array([r[4] for r in g])
        o = out[out.survey_id == s]
        ref = locate_linear(x, y, z, delaunay(x, y), o.lon.to_numpy(), o.lat.to_numpy())
        got = o.z.to_numpy(dtype=float)
        assert (np.isnan(ref) == np.isnan(got)).all()
        ok = ~np.isnan(ref)
        assert np.abs(ref[ok] - got[ok]).max() < 1e-9


def test_triangulation_equals_global(spark):
    rows = [r for r in _rows() if r[0] == 1]
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    got = [tuple(r) for r in su.triangulation(df, 0.005).select("a", "b", "c").collect()]
    x = np.array([r[3] for r in rows]); y = np.array([r[2] for r in rows])
    ref = {tuple(sorted(t)) for t in delaunay(x, y).tolist()}
    assert len(got) == len(set(got)) and set(got) == ref


@pytest.mark.parametrize("tile_points", [15, 60])
def test_small_tiles(spark, monkeypatch, tile_points):
    """Many tiles and levels, points on an ellipse's disc."""
    monkeypatch.setattr(sl, "TILE_POINTS", tile_points)
    monkeypatch.setattr(sl, "FANOUT", 2)
    rng = np.random.default_rng(11)
    x = -74 + rng.random(1200); y = 40 + rng.random(1200) * 0.5
    keep = (x + 73.5) ** 2 / 0.25 + (y - 40.25) ** 2 / 0.0625 < 1
    x, y = x[keep], y[keep]
    z = np.sin(x * 7) + y
    df = soundings(spark, x, y, z)
    tri = delaunay(x, y)
    got = triangles(df, 0.02)
    complete(got, x, y)
    assert set(got) == {tuple(sorted(t)) for t in tri.tolist()}
    out = su.surface_linear(df, 0.02).toPandas()
    ref = locate_linear(x, y, z, tri, out.lon.to_numpy(), out.lat.to_numpy())
    val = out.z.to_numpy(dtype=float)
    assert (np.isnan(ref) == np.isnan(val)).all() and set(out.method) == {"linear", "outside"}
    ok = ~np.isnan(ref)
    assert np.abs(ref[ok] - val[ok]).max() < 1e-9


def test_lattice_ties_are_consistent(spark, monkeypatch):
    """Regular-grid soundings (every cell's corners cocircular): all blocks
    break ties the same way, so their union is one triangulation."""
    monkeypatch.setattr(sl, "TILE_POINTS", 40)
    pts = [(i, j) for i in range(36) for j in range(24) if (i * 7 + j * 3) % 11]  # a few holes
    x = np.array([i / 128 for i, _ in pts]); y = np.array([j / 128 for _, j in pts])
    z = np.array([float((i * j) % 13) for i, j in pts])
    df = soundings(spark, x, y, z)
    ref_tri = delaunay(x, y)
    got = triangles(df)
    complete(got, x, y)
    assert set(got) == {tuple(sorted(t)) for t in ref_tri.tolist()}
    out = su.surface_linear(df, 1 / 300).toPandas()
    ref = locate_linear(x, y, z, ref_tri, out.lon.to_numpy(), out.lat.to_numpy())
    val = out.z.to_numpy(dtype=float)
    assert (np.isnan(ref) == np.isnan(val)).all()
    ok = ~np.isnan(ref)
    assert np.abs(ref[ok] - val[ok]).max() < 1e-9


def test_clusters_lines_and_a_far_fix(spark, monkeypatch):
    """Gaps, hot tiles by extent, points on one line, repeated positions."""
    monkeypatch.setattr(sl, "TILE_POINTS", 50)
    rng = np.random.default_rng(5)
    x = np.r_[-74 + rng.random(300) * 0.05, -73.6 + rng.random(300) * 1e-4, np.full(60, -73.8), 179.0]
    y = np.r_[40 + rng.random(300) * 0.05, 40 + rng.random(300) * 1e-4, 40 + np.arange(60) / 256, -89.0]
    got = triangles(soundings(spark, np.r_[x, x[:9]], np.r_[y, y[:9]]))
    complete(got, x, y)
    assert set(got) == {tuple(sorted(t)) for t in delaunay(x, y).tolist()}


def test_triangulation_two_clusters(spark):
    """Triangles over the empty gap between two clusters are kept; survey ids are file names."""
    rng = np.random.default_rng(5)
    n = 400
    x = np.r_[-74 + rng.random(n) * 0.05, -73.6 + rng.random(n) * 0.05]
    y = 40 + rng.random(2 * n) * 0.05
    df = soundings(spark, x, y, survey="s1.csv")
    got = su.triangulation(df, 0.005).collect()
    assert {r.survey_id for r in got} == {"s1.csv"}
    complete([(r.a, r.b, r.c) for r in got], x, y)


def test_null_survey_is_a_survey(spark):
    """Equal soundings under a NULL survey, a numbered one, and one on a line."""
    rng = np.random.default_rng(8)
    x, y = rng.random(60), rng.random(60)
    one = soundings(spark, x, y)
    line = soundings(spark, np.arange(5.0) / 10, np.zeros(5), survey=None)
    for a, line_of in ((one, None), (line, 0)):
        both = a.unionByName(a.selectExpr("CAST(NULL AS BIGINT) AS survey_id", "idx", "latitude", "longitude", "depth")) if line_of is None else a
        out = su.surface_linear(both, 0.1).toPandas()
        if line_of is None:
            g = [out[out.survey_id.isna()], out[out.survey_id == 1]]
            g = [v.sort_values(["row", "col"])[["row", "col", "z", "method"]].reset_index(drop=True) for v in g]
            assert len(g[0]) and g[0].equals(g[1]) and set(g[0].method) == {"linear", "outside"}
            assert {r[1:] for r in map(tuple, su.triangulation(both).collect()) if r[0] is None} == {tuple(sorted(t)) for t in delaunay(x, y).tolist()}
        else:
            assert len(out) == 5 and set(out.method) == {"nearest"}
