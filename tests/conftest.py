import os
import sys
import tempfile
import warnings

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
warnings.filterwarnings("ignore", category=FutureWarning)

DATA = os.path.join(ROOT, "tests", "data")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fathom.session import build_session
    s = build_session("local[4]", app="fathom-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="fathom-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mbes_mock(spark):
    from fathom.sources.files import scan_surveys
    return scan_surveys(spark, os.path.join(DATA, "mbes_ping.csv"), "mbes").cache()
