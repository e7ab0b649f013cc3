"""QC report products: the first anomalies per survey and the report record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import detector as det
from fathom.operators import rules as rl
from fathom.operators import scoring as sc
from fathom.operators.joins import join_null_safe


def rule_order(sensor: str):
    """Position of an anomaly's rule in the sensor's rule list (report order)."""
    names = [rl.rule_name(r) for r in rl.rules_for(sensor)]
    expr = F.when(F.lit(False), F.lit(0))
    for i, n in enumerate(names):
        expr = expr.when(F.col("rule") == n, F.lit(i))
    return expr.otherwise(F.lit(len(names)))


def top_anomalies(anomalies: DataFrame, sensor: str, k: int = 10) -> DataFrame:
    """First ``k`` anomalies per survey in report order (rule order, then idx).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so each map task ships at most ``k`` rows per survey.
    """
    w = Window.partitionBy("survey_id").orderBy(rule_order(sensor), F.col("idx").asc_nulls_first())
    return anomalies.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def qc_report(summary: DataFrame, anomalies: DataFrame, sensor: str, k: int = 10) -> DataFrame:
    """One record per survey: summary, the first ``k`` anomalies and the
    count of the rest ("... and N more")."""
    top = (top_anomalies(anomalies, sensor, k)
           .groupBy("survey_id")
           .agg(F.sort_array(F.collect_list(F.struct("rn", "idx", "type", "severity", "description")))
                .alias("first_anomalies")))
    return (join_null_safe(summary, top, ["survey_id"], "left")
                   .withColumn("more_anomalies",
                               F.greatest(F.lit(0), F.col("total_anomalies") - F.lit(k))))


def detector_report(df: DataFrame, source: str, model: str, run_ts: str, k: int = 10) -> DataFrame:
    """One record per survey of the detector's run: when, on what, with which
    model, points, anomalies, confidence, anomaly rate, the first ``k``
    anomalies (jumps, depths, coordinates; then in position order) and the
    number of the rest."""
    kinds = F.array_position(F.array(*[F.lit(t) for t in ("depth_jump", "unrealistic_depth", "coordinate_duplicate")]), F.col("type"))
    w = Window.partitionBy("survey_id").orderBy(kinds, F.col("pos").asc_nulls_last(), "description")
    first = (det.detector_anomalies(df).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("survey_id")
             .agg(F.sort_array(F.collect_list(F.struct("rn", "type", "severity", "description"))).alias("anomalies")))
    out = join_null_safe(sc.detector_qc(df), first, ["survey_id"], "left")
    none = F.expr("cast(array() as array<struct<rn:int,type:string,severity:string,description:string>>)")
    return out.select("survey_id", F.lit(run_ts).alias("timestamp"), F.lit(source).alias("input_file"), F.lit(model).alias("model_path"),
                      "total_points", "anomaly_count", "confidence", "anomaly_rate", F.coalesce("anomalies", none).alias("anomalies"),
                      F.greatest(F.lit(0), F.col("anomaly_count") - k).alias("more_anomalies"))


#: Fields of a report's head and of its results, in order.
_HEAD = ("timestamp", "input_file", "model_path")
_RESULTS = ("total_points", "anomaly_count", "confidence", "anomaly_rate")


def rendered(report: DataFrame, fmt: str = "json") -> DataFrame:
    """(survey_id, report): the records as JSON, YAML or text, one string each."""
    def quoted(c):
        listed = F.to_json(F.array(c.cast("string")))  # YAML takes JSON's quoted strings
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    if fmt == "json":
        text = F.to_json(F.struct(*_HEAD, F.struct(*_RESULTS, "anomalies").alias("results")))
    elif fmt == "yaml":
        items = F.transform("anomalies", lambda a: F.concat(F.lit("\n  - type: "), quoted(a["type"]), F.lit("\n    severity: "), quoted(a["severity"]),
                                                            F.lit("\n    description: "), quoted(a["description"])))
        text = F.concat(*[F.concat(F.lit(f"{c}: "), quoted(F.col(c)), F.lit("\n")) for c in _HEAD], F.lit("results:\n"),
                        *[F.concat(F.lit(f"  {c}: "), F.col(c).cast("string"), F.lit("\n")) for c in _RESULTS],
                        F.when(F.size("anomalies") == 0, F.lit("  anomalies: []\n")).otherwise(F.concat(F.lit("  anomalies:"), F.array_join(items, ""), F.lit("\n"))))
    elif fmt == "text":
        items = F.transform("anomalies", lambda a: F.format_string("  %d. %s\n     Type: %s, Severity: %s\n", a["rn"], a["description"], a["type"], a["severity"]))
        text = F.concat(F.format_string("QC Report - %s\nInput: %s\nTotal points: %d\nAnomalies: %d\nConfidence: %.3f\nAnomaly rate: %.2f%%\n",
                                        "timestamp", "input_file", "total_points", "anomaly_count", "confidence", F.col("anomaly_rate") * 100),
                        F.array_join(items, ""),
                        F.when(F.col("more_anomalies") > 0, F.format_string("  ... and %d more\n", "more_anomalies")).otherwise(F.lit("")))
    else:
        raise ValueError(f"Unsupported report format: {fmt}")
    return report.select("survey_id", text.alias("report"))
