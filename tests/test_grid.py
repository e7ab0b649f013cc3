"""Gridding on the multibeam mock file (FIXTURES §3) and the nearest surface
against brute force."""

import math

from pyspark.sql import functions as F

from fathom.operators import grid as gr
from fathom.operators import surface as su

EXPECTED = {  # (row, col): density, running average (reference), true mean
    (0, 0): (10, 21.375586, 16.01), (0, 1): (1, 25.0, 25.0), (1, 1): (10, 50.336133, 39.6),
    (2, 2): (9, 87.146875, 73.911111), (3, 3): (10, 141.123633, 121.12), (3, 4): (1, 153.4, 153.4),
    (4, 4): (10, 215.94082, 190.79),
}


def test_axes_lengths(mbes_mock):
    b = gr.grid_bounds(mbes_mock.select("survey_id", "latitude", "longitude")).collect()[0]
    assert (b.n_rows, b.n_cols) == (6, 7)


def test_running_and_mean(mbes_mock):
    run = {(r.row, r.col): r for r in gr.attributed_grid(mbes_mock, "mbes", method="running").collect()}
    mean = {(r.row, r.col): r for r in gr.attributed_grid(mbes_mock, "mbes", method="mean").collect()}
    assert set(run) == set(EXPECTED)
    for k, (dens, ravg, tmean) in EXPECTED.items():
        assert run[k].density == dens
        assert round(run[k].elevation, 6) == ravg
        assert round(mean[k].elevation, 6) == round(tmean, 6)
        assert run[k].uncertainty == 1.0


def test_running_average_null_restart(spark):
    rows = [(1, 0, 40.0, -74.0, 10.0), (1, 1, 40.0, -74.0, None), (1, 2, 40.0, -74.0, 20.0),
            (1, 3, 40.0, -74.0, 30.0), (2, 0, 40.0, -74.0, 5.0), (2, 1, 40.0, -74.0, None)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    got = {r.survey_id: r.elevation_running for r in gr.running_average(gr.binned_points(df, "mbes")).collect()}
    assert got == {1: 25.0, 2: None}


def test_densify_counts(mbes_mock):
    pts = mbes_mock
    bounds = gr.grid_bounds(pts.select("survey_id", "latitude", "longitude"))
    dense = gr.densify(gr.attributed_grid(pts, "mbes"), bounds)
    assert dense.count() == 42
    assert dense.agg(F.sum("density")).collect()[0][0] == 51
    bands = gr.raster_bands(dense)
    assert bands.count() == 126


def test_nearest_equals_brute_force(spark):
    rows = [(s, i, 40.0 + ((i * 37) % 101) / 5000.0, -74.0 + ((i * 53) % 97) / 5000.0, float(i % 17))
            for s in (1, 2) for i in range(150 if s == 1 else 20)]
    rows += [(1, 1000 + i, 40.0, -74.0, 99.0) for i in range(5)]  # a group of copies
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    res = 0.001
    got = {(r.survey_id, r.row, r.col): (r.z, r.src_idx) for r in su.surface_nearest(df, res).collect()}
    pts = {}
    for s, i, la, lo, z in rows:
        pts.setdefault(s, []).append((i, la, lo, z))
    for s, p in pts.items():
        la0, la1 = min(x[1] for x in p), max(x[1] for x in p)
        lo0, lo1 = min(x[2] for x in p), max(x[2] for x in p)
        nr, nc = math.ceil((la1 + res - la0) / res), math.ceil((lo1 + res - lo0) / res)
        for r in range(nr):
            for c in range(nc):
                y, x = la0 + r * res, lo0 + c * res
                best = min(p, key=lambda q: (math.sqrt((q[2] - x) * (q[2] - x) + (q[1] - y) * (q[1] - y)), q[0]))
                assert got[(s, r, c)] == (best[3], best[0]), (s, r, c)


def test_nearest_on_clusters_and_null_surveys(spark):
    """Dense spots, a far-off fix, ties, repeated positions; a NULL survey is a survey."""
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.r_[rng.random(900) * 1e-3, 5 + rng.integers(0, 9, 300) / 8, 90.0, rng.random(40) * 10]
    y = np.r_[rng.random(900) * 1e-3, 1 + rng.integers(0, 9, 300) / 8, -45.0, rng.random(40) * 10]
    rows = [(s, i, float(y[i]), float(x[i]), float(i)) for s in (None, 7) for i in range(len(x))]
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    out = su.surface_nearest(df, 1.5).collect()
    assert len(out) == 2 * len({(r.row, r.col) for r in out})
    for r in out:
        d = np.sqrt((x - r.lon) ** 2 + (y - r.lat) ** 2)
        assert r.src_idx == int(np.argmin(d)) and r.z == float(r.src_idx)


def test_nearest_far_nodes_meet_few_boxes(spark, monkeypatch):
    """A dense spot and a far fix: no block or node meets a level's boxes at once, and the answer is that of brute force."""
    import numpy as np
    rng = np.random.default_rng(5)
    n = 6000  # 188 boxes
    x, y = np.r_[rng.random(n) * 1e-2, 60.0], np.r_[rng.random(n) * 1e-2, 30.0]
    df = spark.createDataFrame([(1, i, float(y[i]), float(x[i]), float(i)) for i in range(n + 1)], "survey_id long, idx long, latitude double, longitude double, depth double")
    met, near = [], su._near
    monkeypatch.setattr(su, "_near", lambda d, *sides: met.append(near(d, *sides)) or met[-1])
    out = su.surface_nearest(df, 3.0).collect()
    for r in out:
        d = np.sqrt((x - r.lon) ** 2 + (y - r.lat) ** 2)
        assert r.src_idx == int(np.argmin(d)) and r.z == float(r.src_idx)
    # What the nodes themselves start with, and the work on each row of soundings.
    assert met[-2].agg(F.max(F.size("boxes"))).first()[0] <= 2 * su.FANOUT


def test_nearest_sorts_no_soundings(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.5, 1.0)], "survey_id long, idx long, latitude double, longitude double, z double")
    assert "SortAggregate" not in su._distinct_locations(df)._jdf.queryExecution().executedPlan().toString()
    locs = df.withColumns({c: F.lit(v) for c, v in (("min_lat", 0.0), ("max_lat", 1.0), ("min_lon", 0.0), ("max_lon", 1.0))})
    plan = su._z_order(locs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("floor(") <= 2
    x = int(0.5 * ((1 << su._BITS) - 1))  # interleaved with itself: every bit twice
    assert su._z_order(locs).first().curve == int("".join(b * 2 for b in bin(x)[2:]), 2)


def test_soundings_are_not_shuffled_to_their_survey(spark):
    """Joining the survey's profile and bounds leaves the soundings where they are; a NULL survey is a survey."""
    from fathom.operators.reproject import reproject_to_wgs84
    rows = [(s, i, 40.0 + i / 100, -74.0 + i / 50, 1.0) for s in (1, None) for i in range(9)]
    rows += [(2, i, 5500000.0 + 900 * i, 500000.0 + 900 * i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    moved = reproject_to_wgs84(df)
    cells = gr.cell_index(moved, gr.survey_grid_bounds(moved, 0.1), 0.1)
    for d in (moved, cells):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        # The projection's series are mapped over an array that kept rows do not have.
        assert "cosh" not in plan.lower() or "transform" in plan
    got = {(r.survey_id, r.idx): r for r in cells.collect()}
    assert len(got) == len(rows)
    for s, i, la, lo, _ in rows:
        r = got[(s, i)]
        assert (r.latitude, r.longitude) == (la, lo) if s != 2 else 49 < r.latitude < 50 and 14.9 < r.longitude < 15.2
