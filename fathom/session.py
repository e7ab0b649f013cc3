"""SparkSession construction and cluster-shared settings.

Everything here is plain Spark configuration.  Nothing is hard-wired to a
machine: the checkpoint folder is taken from ``spark.checkpoint.dir`` when the
cluster names one and only falls back to a scratch folder in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every fathom job relies on (UTC instants, AQE re-planning, Arrow).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Remove checkpoint files once their DataFrames are unreachable, so the
    # shared checkpoint folder does not grow with every run.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "fathom",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with fathom's base settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Runtime-settable SQL confs also apply to a session created elsewhere.
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cutting lineage.

    Reads ``spark.checkpoint.dir`` from the session; only in local mode (tests,
    a laptop) a fresh scratch folder is created and registered when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="fathom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize_small(df):
    """Checkpoint a small per-key table (e.g. one row per survey) that several
    branches of a plan read: one tiny write instead of repeating the full
    scan that produced it in every branch."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fathom`` importable in Python workers (executors).

    Operators that run Python in tasks (mapInPandas / applyInPandas / cogroup
    / applyInPandasWithState) pickle functions by module reference, so the
    package must be on the executors' path.  The package is zipped once per
    SparkContext and registered with ``addPyFile`` -- the programmatic form of
    ``spark-submit --py-files``; Spark serves the archive to every executor.
    A deployment that already installs fathom on the executors loses nothing.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="fathom-pyfiles-"), "fathom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("fathom", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
