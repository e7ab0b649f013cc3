"""Statistics and metadata of tables without a sensor's columns."""

from fathom.operators import stats


def test_no_known_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "survey_id string, note string")
    assert stats.generic_statistics(df).columns == ["survey_id", "column", "min", "max", "mean", "std"]
    assert stats.generic_statistics(df).isEmpty()
    assert stats.parse_warnings(df, "mbes").isEmpty()
    assert {r.survey_id for r in stats.sensor_statistics(df, "mbes").collect()} == {"a", None}


def test_metadata_of_a_generic_sensor(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None)], "survey_id string, latitude double, longitude double")
    row, = stats.parser_metadata(df, "generic").collect()
    assert (row.total_points, row.sensor_type, row.latitude_range, row.longitude_range) == (2, "generic", [1.0, 3.0], [2.0, 2.0])


def test_lidar_value_count_maps(spark):
    """One map a survey, NULL values left out, a NULL survey kept."""
    rows = [(1, 2, 1), (1, 2, 2), (1, None, 1), (None, 5, 1)]
    df = spark.createDataFrame(rows, "survey_id long, classification int, return_number int")
    got = {r.survey_id: r for r in stats.parser_metadata(df, "lidar").collect()}
    assert got[1].classification_counts == {2: 2} and got[1].return_number_distribution == {1: 2, 2: 1}
    assert got[None].classification_counts == {5: 1}
