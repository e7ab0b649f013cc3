"""Overlay values, submission payload pieces (FIXTURES §3) and job analytics."""

from pyspark.sql import functions as F

from fathom.operators import jobs as jb
from fathom.operators import overlay as ov
from fathom.operators import submission as sb
from fathom.sinks.products import ProductInfo


def test_environment_values(spark):
    df = spark.createDataFrame([(1, 0, 40.7128, -74.0060, 10.5), (1, 1, 40.5, -73.5, 150.0)],
                               "survey_id long, idx long, latitude double, longitude double, depth double")
    r = {x.idx: x for x in ov.apply_overlay(df, "environment").collect()}
    assert (r[0].plume_detected, round(r[0].water_temperature, 4), r[0].habitat_type, r[0].environmental_risk,
            r[0].risk_factors) == (False, 19.5386, "shallow_water", "low", ["shallow_water"])
    assert (r[1].plume_detected, round(r[1].water_temperature, 4), r[1].habitat_type, r[1].environmental_risk,
            r[1].risk_factors) == (True, 18.25, "continental_shelf", "high", ["plume_detected"])


def test_unknown_overlay(spark):
    df = spark.range(1)
    try:
        ov.apply_overlay(df, "nope")
    except ValueError as e:
        assert "environment" in str(e)
    else:
        raise AssertionError("expected ValueError")
    assert ov.overlay_info("environment")["version"] == "1.0.0"


def test_layer_join(spark):
    pts = spark.createDataFrame([(1, 0, 40.0, -74.0), (1, 1, 40.015, -73.985)],
                                "survey_id long, idx long, latitude double, longitude double")
    layer = spark.createDataFrame([(0, 0, 7.0), (1, 1, 8.0)], "row int, col int, dissolved_oxygen double")
    out = {r.idx: r.dissolved_oxygen for r in
           ov.apply_overlay(pts, "water_quality", {"layer": layer, "resolution": 0.01}).collect()}
    assert out == {0: 7.0, 1: 8.0}


def _catalog(spark, size):
    cat = spark.createDataFrame(
        [("S1", 40.7128, 40.7178, -74.006, -74.001, None, 0.95, 0)],
        "survey_id string, min_lat double, max_lat double, min_lon double, max_lon double, quality_score double, "
        "data_quality_score double, anomaly_count long").drop("quality_score")
    files = spark.createDataFrame([("S1", "s1.nc", size, "abc")],
                                  "survey_id string, filename string, file_size_bytes long, checksum string")
    return sb.payloads(cat, files, ProductInfo(run_ts="2024-01-01T00:00:00Z"))


def test_payload_ring_quality_and_validation(spark):
    p = _catalog(spark, 0)
    r = p.collect()[0]
    ring = [list(x) for x in r.metadata.spatial_coverage.coordinates[0]]
    assert ring == [[-74.006, 40.7128], [-74.001, 40.7128], [-74.001, 40.7178], [-74.006, 40.7178],
                    [-74.006, 40.7128]]
    assert r.metadata.data_quality.quality_score == 0.95
    v = sb.validate_payload(p).collect()[0]
    assert v.status == "invalid"
    assert [c.status for c in v.checks if c.field == "file_size"] == ["invalid"]
    w = sb.warnings(p).collect()[0].warnings
    assert w == ["No API key provided - upload will fail in production"]
    assert sb.validate_payload(_catalog(spark, 10)).collect()[0].status == "valid"
    m = sb.manifest(p, "2024-01-01T00:00:00Z").collect()[0]
    assert m.manifest_version == "1.0" and len(m.files) == 1 and m.files[0].file_type == "data"


def test_job_metrics_and_cancel(spark):
    jobs = spark.createDataFrame(
        [(1, "completed", 0.9), (2, "failed", 0.1), (3, "queued", 0.5), (4, "processing", 0.7), (5, "completed", 1.0)],
        "job_id long, status string, quality_score double").withColumn("created_at", F.col("job_id"))
    m = jb.metrics(jobs).collect()[0]
    assert (m.total, m.completed, m.failed, m.active, m.success_rate) == (5, 2, 1, 2, 66.67)
    q = jb.queue_status(jobs).collect()[0]
    assert (q.estimated_wait_seconds, q.available_slots) == (120, 4)
    c = {r.job_id: (r.status, r.outcome) for r in jb.cancel(jobs, jobs.where("job_id IN (1, 3)"), "t").collect()}
    assert c[1] == ("completed", "rejected") and c[3] == ("cancelled", "cancelled") and c[4][1] == "unchanged"
    p = jb.page(jobs, None, 2, 1).collect()
    assert [r.job_id for r in p] == [4, 3] and p[0].total == 5 and p[0].has_more


def test_detector_report_formats(spark):
    """JSON reads back, YAML's strings are quoted, text has ten anomalies and the rest's number."""
    import json

    from fathom.sinks import reports
    rows = [(1, i, 10.0, 20.0 + i, 500.0 if i % 2 else 10.0) for i in range(20)] + [(2, 0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, latitude double, longitude double, depth double")
    rep = reports.detector_report(df, 'in "x".csv', "default", "2024-01-01T00:00:00Z")
    out = {f: {r.survey_id: r.report for r in reports.rendered(rep, f).collect()} for f in ("json", "yaml", "text")}
    js = json.loads(out["json"][1])
    assert js["results"]["anomaly_count"] == 19 and len(js["results"]["anomalies"]) == 10 and js["input_file"] == 'in "x".csv'
    assert out["yaml"][1].startswith('timestamp: "2024-01-01T00:00:00Z"\ninput_file: "in \\"x\\".csv"\n')
    assert out["yaml"][1].count("- type: ") == 10 and "anomalies: []" in out["yaml"][2]
    assert out["text"][1].endswith("... and 9 more\n") and "Anomaly rate: 95.00%" in out["text"][1] and "more" not in out["text"][2]
