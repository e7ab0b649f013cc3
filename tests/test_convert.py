"""The conversion composition end to end on the smallest driver tables."""

import tempfile

import pytest

from fathom.plans.convert import ConvertOptions, convert, stage_metadata
from fathom.plans.views import view
from fathom.sinks.products import ProductInfo
from tests.conftest import SF


def test_invalid_options():
    for kw in ({"sensor": "sonar"}, {"sensor": "mbes", "output_format": "xyz"}, {"sensor": "mbes", "qc_mode": "x"}):
        with pytest.raises(ValueError):
            ConvertOptions(**kw).validate()


@pytest.mark.parametrize("fmt,expect_col", [("netcdf", "time"), ("bag", "elevation"), ("geotiff", "band")])
def test_convert_products(spark, fmt, expect_col):
    opts = ConvertOptions("mbes", output_format=fmt, qc_mode="manual", anonymize=True, add_overlay=True,
                          resolution=0.01, info=ProductInfo(run_ts="2024-01-01T00:00:00Z"))
    out = tempfile.mkdtemp(prefix="fathom-convert-")
    res = convert(view(spark, SF, "soundings_mbes").where("latitude <= 90 AND longitude >= -180"), opts, out)
    assert expect_col in res["product"].columns
    assert res["metrics"]["output_rows"] == res["product"].count() > 0
    r = res["result"].collect()
    assert len(r) == 8 and all(x.status == "completed" and x.anonymized and x.overlay_applied for x in r)
    assert sum(x.data_points_processed for x in r) == view(spark, SF, "soundings_mbes").where(
        "latitude <= 90 AND longitude >= -180").count()
    assert "plume_detected" in res["points"].columns


def test_stage_metadata_projected(spark):
    m = stage_metadata(view(spark, SF, "soundings_utm"), ConvertOptions("mbes")).collect()
    assert all(x.reprojection.applied and x.reprojection.source_crs == "EPSG:32633" for x in m)
