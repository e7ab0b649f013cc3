"""The default detector against the FIXTURES §3 detector table."""

import pytest

from fathom.operators import detector as det
from fathom.operators import scoring as sc


def _pts(spark, depths, lat=None, lon=None):
    rows = [(1, i, lat[i] if lat else 40.0 + i * 1e-3, lon[i] if lon else -74.0 + i * 1e-3, d)
            for i, d in enumerate(depths)]
    return spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")


@pytest.mark.parametrize("depths,expected,rate,conf", [
    ([10.5, 12.3, 15.7, 200.0, 18.2],
     [(3, "depth_jump", "medium", 184.3, 0.9215), (4, "depth_jump", "medium", -181.8, 0.909)], 0.4, 0.5),
    ([10.5, 12.3, 200.0, 15.7, -5.0],
     [(2, "depth_jump", "medium", 187.7, 0.9385), (3, "depth_jump", "medium", -184.3, 0.9215),
      (4, "unrealistic_depth", "high", -5.0, 1.0)], 0.6, 0.5),
    ([10.5, -5.0, 15000.0],
     [(1, "unrealistic_depth", "high", -5.0, 1.0), (2, "depth_jump", "high", 15005.0, 1.0),
      (2, "unrealistic_depth", "high", 15000.0, 1.0)], 1.0, 0.5),
])
def test_detector_cases(spark, depths, expected, rate, conf):
    df = _pts(spark, depths)
    got = sorted((r.pos, r.type, r.severity, round(r.value, 4), round(r.confidence, 4))
                 for r in det.detector_anomalies(df).collect())
    assert got == sorted(expected)
    q = sc.detector_qc(df).collect()[0]
    assert round(q.anomaly_rate, 6) == rate and q.confidence == conf


def test_duplicate_coordinates(spark):
    lat = [40.0] * 11 + [41.0]
    lon = [-74.0] * 11 + [-73.0]
    df = _pts(spark, [10.0] * 12, lat, lon)
    a = det.detector_anomalies(df).collect()
    assert [(r.type, r.value, round(r.confidence, 2)) for r in a] == [("coordinate_duplicate", 11.0, 0.22)]
    q = sc.detector_qc(df).collect()[0]
    assert q.confidence == 0.7


def test_time_order_sorts_before_diff(spark):
    rows = [(1, 0, "2024-01-01 00:00:03", 300.0), (1, 1, "2024-01-01 00:00:01", 10.0),
            (1, 2, "2024-01-01 00:00:02", 12.0)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, timestamp string, depth double") \
              .selectExpr("survey_id", "idx", "CAST(timestamp AS TIMESTAMP) AS timestamp", "depth")
    a = det.detector_anomalies(df).collect()
    assert [(r.idx, r.pos, r.value) for r in a] == [(0, 2, 288.0)]
