"""NULL keys, NaN text, hash collisions and long headers keep their rows."""

import pytest

from fathom.operators import privacy, reproject, rules
from fathom.sources import files


def test_null_survey_is_reprojected(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 20.0), (None, 1, 11.0, 21.0)], "survey_id string, idx long, latitude double, longitude double")
    assert reproject.reproject_to_wgs84(df).count() == 2


def test_null_timestamps_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("a", 2, "x")], "survey_id string, idx long, timestamp string")
    got = {r.idx: r.is_duplicate for r in rules.duplicate_flags(df, ["timestamp"]).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_ambiguous_hash_keeps_one_row(spark):
    df = spark.createDataFrame([("h",), ("k",)], "vessel_id string")
    mapping = spark.createDataFrame([("h", "a"), ("h", "b"), ("k", "c")], "hashed string, original string")
    assert sorted(r.vessel_id for r in privacy.deanonymize(df, mapping).collect()) == ["c", "h"]


def test_nan_text_is_null(spark, tmp_path):
    p = tmp_path / "s1.csv"
    p.write_text("timestamp,latitude,longitude,depth,beam_angle\n2024-01-01T00:00:00Z,1.0,2.0,NaN,3\n")
    r = files.scan_surveys(spark, str(p), "mbes").select("depth").first()
    assert r.depth is None


def test_header_longer_than_one_read(spark, tmp_path):
    p = tmp_path / "wide.csv"
    head = ",".join([f"padding_column_{i:08d}" for i in range(5000)] + ["timestamp", "latitude", "longitude", "depth"])
    assert len(head) > files.HEAD_BYTES
    p.write_text(head + "\n")
    got = files.first_lines(spark, str(p)).first()
    assert got["header"] == head


def test_no_local_checkpoint_folder_on_a_cluster(monkeypatch):
    from fathom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_null_survey_has_the_scores_of_any_other(spark):
    """Equal soundings under survey NULL and survey 1: equal QC, grids, reports and records."""
    from fathom.operators import grid, scoring
    from fathom.plans import convert
    from fathom.sinks import products, reports
    rows = [(s, i, f"2024-01-01 00:00:{i // 2 % 60:02d}", 10 + (i % 12) / 100, 20 + (i % 5) / 100, 900.0 if i % 9 == 0 else -1.0 if i == 4 else 10.0 + i, 50.0)
            for s in (1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "survey_id long, idx long, timestamp string, latitude double, longitude double, depth double, quality double")
    df = df.withColumn("timestamp", df["timestamp"].cast("timestamp"))
    qc = scoring.qc_summary(df, "mbes", "auto")
    bounds = grid.survey_grid_bounds(df, 0.01)
    cells = grid.attributed_grid(df, "mbes", 0.01, "running", bounds)
    dense = grid.densify(cells, bounds, 0.01)
    files_of = df.select("survey_id").distinct().selectExpr("survey_id", "'f.csv' AS filename", "7L AS file_size_bytes", "'00' AS checksum")
    record = convert.stage_metadata(df, convert.ConvertOptions("mbes"), files_of, qc)
    tables = [qc, scoring.rule_qc(df, "mbes"), scoring.detector_qc(df), dense, grid.raster_info(grid.raster_bands(dense), bounds), record,
              products.grid_metadata(cells, df, "mbes", qc), products.raster_tags(df, "mbes", qc),
              reports.rendered(reports.detector_report(df, "f.csv", "default", "2024-01-01"), "text"), products.trajectory_variables(df, "mbes")]
    for t in tables:
        got = {True: [], False: []}
        for r in t.collect():
            got[r.survey_id is None].append(repr([r[c] for c in t.columns if c != "survey_id"]))
        assert got[True] and sorted(got[True]) == sorted(got[False])
    r = qc.where("survey_id IS NULL").first()
    assert r.detector_anomalies > 0 and r.rule_anomalies > 0 and dense.agg({"density": "sum"}).first()[0] == 120
    c = record.where("survey_id IS NULL").first().conversion
    assert c.input_file_size_bytes == 7 and c.quality_metrics.anomaly_count == r.total_anomalies and c.data_extent.max_depth == 900.0
