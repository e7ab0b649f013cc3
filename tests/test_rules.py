"""Range rules, group rules and scores against hand-derived values (FIXTURES §3)."""

from pyspark.sql import functions as F

from fathom.operators import rules as rl
from fathom.operators import scoring as sc


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_latitude_longitude_ranges(spark):
    df = _df(spark, [(1, 0, 40.0, -100.0), (1, 1, 95.0, -200.0), (1, 2, 60.0, -60.0)],
             "survey_id long, idx long, latitude double, longitude double")
    a = rl.range_anomalies(df, "mbes").collect()
    got = sorted((r.column, r.idx, r.severity, r.threshold) for r in a)
    assert got == [("latitude", 1, "high", "-90-90"), ("longitude", 1, "high", "-180-180")]
    assert {r.description for r in a} == {"Invalid latitude value: 95.0", "Invalid longitude value: -200.0"}


def test_depth_range_and_score(spark):
    df = _df(spark, [(1, 0, 10.0), (1, 1, -5.0), (1, 2, 15000.0)], "survey_id long, idx long, depth double")
    a = rl.range_anomalies(df, "mbes").collect()
    assert sorted(r.idx for r in a) == [1, 2]
    assert all(r.severity == "high" and r.threshold == "0-12000m" for r in a)
    q = sc.rule_qc(df, "mbes").collect()[0]
    # two high anomalies of three rows: tier 0.2, capped at 0.6 -> 0.2
    assert q.anomaly_count == 2 and q.quality_score == 0.2


def test_one_high_in_thousand_scores_06(spark):
    rows = [(1, i, 10.0 if i else -1.0) for i in range(1000)]
    df = _df(spark, rows, "survey_id long, idx long, depth double")
    q = sc.rule_qc(df, "sbes").collect()[0]
    assert q.quality_score == 0.6


def test_null_never_flagged(spark):
    df = _df(spark, [(1, 0, None), (1, 1, 5.0)], "survey_id long, idx long, depth double")
    assert rl.range_anomalies(df, "mbes").count() == 0


def test_duplicate_timestamps_count_all_copies(spark):
    df = _df(spark, [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, None), (1, 4, None), (2, 0, "a")],
             "survey_id long, idx long, timestamp string")
    a = {r.survey_id: r.value for r in rl.duplicate_timestamp_anomalies(df).collect()}
    assert a == {1: 4.0}


def test_outlier_needs_ten_rows(spark):
    rows = [(1, i, 10.0) for i in range(9)] + [(1, 9, 10000.0)]
    df = _df(spark, rows, "survey_id long, idx long, depth double")
    assert rl.depth_outlier_anomalies(df).count() == 0  # std too large: no 3-sigma outlier
    rows = [(1, i, 10.0 + (i % 2)) for i in range(30)] + [(1, 30, 500.0)]
    df = _df(spark, rows, "survey_id long, idx long, depth double")
    out = rl.depth_outlier_anomalies(df).collect()
    assert [r.idx for r in out] == [30]


def test_mock_file_has_no_anomalies(mbes_mock):
    q = sc.qc_summary(mbes_mock, "mbes", "auto").collect()[0]
    assert q.total_points == 51 and q.total_anomalies == 0
    assert q.rule_score == 1.0 and q.detector_confidence == 0.9 and q.quality_score == 1.0


def test_mock_file_statistics(mbes_mock):
    from fathom.operators.stats import sensor_statistics
    s = sensor_statistics(mbes_mock, "mbes").collect()[0]
    assert (s.depth_min, s.depth_max) == (10.5, 223.4)
    assert round(s.depth_mean, 6) == 88.603922 and round(s.depth_std, 6) == 64.900949
    assert round(s.beam_angle_mean, 6) == 52.205882 and round(s.beam_angle_std, 6) == 26.375401


def test_rules_applied_names(mbes_mock):
    assert rl.rules_applied(mbes_mock, "mbes") == [
        "latitude_range_check", "longitude_range_check", "depth_range_check", "beam_angle_range_check",
        "quality_range_check", "duplicate_timestamp_check", "depth_consistency_check"]


def test_skip_mode(mbes_mock):
    q = sc.qc_summary(mbes_mock, "mbes", "skip").collect()[0]
    assert q.status == "skipped" and q.quality_score is None
