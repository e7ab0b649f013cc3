"""Analytics over a ``jobs`` table (one row per conversion job).

The reference keeps jobs in in-process dicts; here they are a table and every
API read becomes an aggregate or a filtered, ordered read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (the reference's job-queue constants).
AVG_PROCESSING_SECONDS = 120
MAX_CONCURRENT_JOBS = 5
SENSOR_TYPES = ["mbes", "sbes", "lidar", "singlebeam", "auv"]
OUTPUT_FORMATS = ["netcdf", "bag", "geotiff"]
QC_MODES = ["auto", "manual", "skip"]
ACTIVE = ["queued", "processing"]


def health_counts(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(F.count_if(s.isin(*ACTIVE)).alias("active_jobs"),
                    F.count_if(s == "completed").alias("completed_jobs"),
                    F.count_if(s == "failed").alias("failed_jobs"))


def metrics(jobs: DataFrame) -> DataFrame:
    """total / completed / failed / active and success rate (percent, 2 dp)."""
    s = F.col("status")
    t = jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"),
                 F.count_if(s == "failed").alias("failed"), F.count_if(s.isin(*ACTIVE)).alias("active"))
    processed = F.col("completed") + F.col("failed")
    rate = F.when(processed > 0, F.col("completed") / processed * F.lit(100.0)).otherwise(F.lit(0.0))
    return t.withColumn("success_rate", F.round(rate, 2))


def queue_status(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    t = jobs.agg(F.count_if(s == "queued").alias("queued_jobs"),
                 F.count_if(s == "processing").alias("processing_jobs"))
    wait = F.col("queued_jobs") * F.lit(AVG_PROCESSING_SECONDS)
    return t.withColumns({
        "estimated_wait_seconds": wait,
        "estimated_wait_minutes": F.round(wait / F.lit(60.0), 1),
        "max_concurrent_jobs": F.lit(MAX_CONCURRENT_JOBS),
        "available_slots": F.greatest(F.lit(0), F.lit(MAX_CONCURRENT_JOBS) - F.col("processing_jobs"))})


def page(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first (job_id breaks ties), offset/limit, with total and has_more.

    The limit is the feature (a page).  ``total`` is a scalar subquery, so it
    is computed once in the cluster rather than by a driver-side count.
    """
    f = jobs.where(F.col("status") == status) if status else jobs
    total = f.select(F.count(F.lit(1))).scalar()
    p = f.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(offset).limit(limit)
    return p.withColumns({"total": total, "has_more": F.lit(offset + limit) < total})


def sorted_jobs(jobs: DataFrame, status: str = "all", sort_by: str = "created_at",
                ascending: bool = False) -> DataFrame:
    f = jobs if status == "all" else jobs.where(F.col("status") == status)
    key = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return f.orderBy(key, F.col("job_id").asc())


def lookup(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == F.lit(job_id))


def cancel(jobs: DataFrame, requests: DataFrame, run_ts: str) -> DataFrame:
    """Apply cancel requests (job_id) as one batch state transition.

    Requests for queued/processing jobs cancel them; others are rejected with
    the reason; jobs without a request are unchanged.  Returns the new
    snapshot with an ``outcome`` column.
    """
    req = requests.select("job_id").distinct().withColumn("_req", F.lit(True))
    j = jobs.join(req, "job_id", "left")
    asked = F.coalesce(F.col("_req"), F.lit(False))
    can = F.col("status").isin(*ACTIVE)
    outcome = F.when(asked & can, "cancelled").when(asked, "rejected").otherwise("unchanged")
    return j.select(
        *[c for c in jobs.columns if c != "status"],
        F.when(asked & can, F.lit("cancelled")).otherwise(F.col("status")).alias("status"),
        outcome.alias("outcome"),
        F.when(asked & can, F.lit("Job cancelled by user"))
         .when(asked, F.concat(F.lit("Cannot cancel job with status: "), F.col("status"))).alias("message"),
        F.when(asked & can, F.lit(run_ts)).alias("cancelled_at"))


def map_summary(jobs: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Counts by status, the mean quality in percent (1 dp) and, given job
    locations (job_id, latitude, longitude), the map centre (mean position)."""
    s = F.col("status")
    aggs = [F.count(F.lit(1)).alias("total_jobs"), F.count_if(s == "completed").alias("completed"),
            F.count_if(s == "processing").alias("processing"),
            F.round(F.avg("quality_score") * F.lit(100.0), 1).alias("avg_quality_pct")]
    if locations is not None:
        jobs = jobs.join(locations.select("job_id", "latitude", "longitude"), "job_id", "left")
        aggs += [F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon")]
    return jobs.agg(*aggs)


def duration_text(created: Column, completed: Column) -> Column:
    """'{m}m {s}s' between two instants; 'In progress...' when not completed."""
    secs = F.unix_timestamp(completed) - F.unix_timestamp(created)
    return F.when(completed.isNull(), F.lit("In progress...")).otherwise(
        F.format_string("%dm %ds", F.floor(secs / 60), F.pmod(secs, F.lit(60))))


def validate_requests(req: DataFrame) -> DataFrame:
    """Per request: list of parameter errors; accepted iff none."""
    errs = F.array_compact(F.array(
        F.when(~F.col("sensor_type").isin(*SENSOR_TYPES),
               F.concat(F.lit("Unsupported sensor type: "), F.col("sensor_type"))),
        F.when(~F.col("output_format").isin(*OUTPUT_FORMATS),
               F.concat(F.lit("Unsupported output format: "), F.col("output_format"))),
        F.when(~F.col("qc_mode").isin(*QC_MODES), F.concat(F.lit("Unsupported QC mode: "), F.col("qc_mode"))),
        F.when(F.col("input_exists") == F.lit(False), F.lit("Input file not found"))))
    return req.withColumns({"errors": errs, "accepted": F.size(errs) == 0})
