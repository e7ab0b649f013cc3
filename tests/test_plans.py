"""Plan properties of the core operators and the driver contract."""

import __spark_entry__ as E
from fathom.operators import rules as rl
from fathom.plans.views import view
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_rules_single_scan_no_shuffle(spark):
    p = _plan(rl.range_anomalies(view(spark, SF, "points_lidar"), "lidar"))
    assert "Exchange" not in p and "CartesianProduct" not in p and "BatchEvalPython" not in p
    assert "ReadSchema" in p


def test_no_cartesian_or_python_udf_in_core_queries(spark):
    qs = E.queries()
    for k in ["qc_mbes", "qc_summary", "detector", "grid_elevation_running", "reproject", "overlay_environment",
              "anonymize_identifiers", "track_segments"]:
        p = _plan(qs[k](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, k
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, k


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() == 8
    assert set(E.oracle_sql()) <= set(E.queries())


def test_topk_and_paging_plans(spark):
    qs = E.queries()
    top = qs["top_anomalies"](spark, SF)
    top.collect()
    assert "WindowGroupLimit" in _plan(top)  # partial top-k before the shuffle
    page = qs["jobs_page"](spark, SF)
    page.collect()
    assert "TakeOrderedAndProject" in _plan(page)  # no global sort for a page
