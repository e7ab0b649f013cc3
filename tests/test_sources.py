"""File sources: aliases, comment-prefixed text, file order, sniffing."""

import os
import tempfile

from fathom.sources import files as fs
from tests.conftest import DATA


def test_scan_mock_mbes(mbes_mock):
    assert mbes_mock.count() == 51
    cols = set(mbes_mock.columns)
    assert {"timestamp", "latitude", "longitude", "depth", "beam_angle", "quality", "intensity", "idx",
            "survey_id"} <= cols
    first = mbes_mock.where("idx = 0").collect()[0]
    assert (first.latitude, first.depth, first.survey_id) == (40.7128, 10.5, "mbes_ping")


def test_scan_singlebeam_comment_text(spark):
    names = ["timestamp", "latitude", "longitude", "depth", "quality", "heading", "pitch", "roll", "velocity"]
    df = fs.scan_surveys(spark, os.path.join(DATA, "singlebeam.txt"), "sbes", "csv", comment="#",
                         header=False, names=names)
    assert df.count() == 31
    from fathom.operators.stats import sensor_statistics
    s = sensor_statistics(df, "sbes").collect()[0]
    assert (s.depth_min, s.depth_max, round(s.depth_mean, 6), round(s.depth_std, 6)) == \
        (10.5, 96.7, 43.322581, 26.586923)
    assert sorted(r.idx for r in df.collect()) == list(range(31))


def test_alias_before_required_check(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Time, LAT ,lon,z\n2024-01-01T00:00:00Z,1.0,2.0,3.0\n1704067201,1.5,2.5,3.5\n")
    df = fs.scan_surveys(spark, str(p), "mbes")
    rows = sorted(df.collect(), key=lambda r: r.idx)
    assert [r.depth for r in rows] == [3.0, 3.5]
    assert rows[1].timestamp.isoformat().startswith("2024-01-01T00:00:01")


def test_missing_required(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("timestamp,latitude\n2024-01-01T00:00:00Z,1.0\n")
    try:
        fs.scan_surveys(spark, str(p), "mbes")
    except ValueError as e:
        assert "longitude" in str(e) and "depth" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_sniff(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("Timestamp,Latitude,Longitude,x\n1,2,3,4\n")
    (tmp_path / "bad.csv").write_text("invalid_column\n1\n2\n")
    got = {os.path.basename(r.path): r.valid
           for r in fs.sniff_format(fs.first_lines(spark, str(tmp_path)), "mbes").collect()}
    assert got == {"ok.csv": True, "bad.csv": False}


def test_catalog_and_checksum(spark):
    c = fs.file_checksums(spark, os.path.join(DATA, "mbes_ping.csv")).collect()[0]
    import hashlib
    with open(os.path.join(DATA, "mbes_ping.csv"), "rb") as f:
        data = f.read()
    assert c.checksum == hashlib.sha256(data).hexdigest() and c.file_size_bytes == len(data)


def test_json_records_array(spark, tmp_path):
    p = tmp_path / "auv_track.json"
    p.write_text('[{"time": "2024-01-01T00:00:00Z", "lat": 40.1, "lon": -74.2, "altitude": 55.5, "speed": 2.5},'
                 ' {"time": "2024-01-01T00:00:05Z", "lat": 40.2, "lon": -74.1, "altitude": 60.0, "speed": 3.0}]')
    df = fs.scan_surveys(spark, str(p), "auv", "json")
    rows = sorted(df.collect(), key=lambda r: r.idx)
    assert [(r.idx, r.latitude, r.depth, r.velocity, r.survey_id, r.sensor_type) for r in rows] == \
        [(0, 40.1, 55.5, 2.5, "auv_track", "auv"), (1, 40.2, 60.0, 3.0, "auv_track", "auv")]


def test_file_positions_across_splits(spark, tmp_path):
    """idx = line position even when a file is read as many splits."""
    p = tmp_path / "long.csv"
    with open(p, "w") as f:
        f.write("timestamp,latitude,longitude,depth\n")
        for i in range(60000):
            f.write(f"2024-01-01T00:00:00Z,{i},-74.0,{i % 500}.5\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        df = fs.scan_surveys(spark, str(p), "mbes")
        bad = df.where("idx != CAST(latitude AS BIGINT)").count()
        n = df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n == 60000 and bad == 0
