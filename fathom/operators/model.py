"""Pluggable anomaly scoring.

The default model is the deterministic detector, run natively
(:mod:`fathom.operators.detector`).  A user model is any function from a
pandas batch of soundings to a pandas frame of anomaly rows; it runs with
``mapInPandas`` (Arrow batches, one Python worker per task), so it scales
with the number of partitions and never sees more than one batch at a time.
Models that need neighbours in time order should be given the output of
:func:`fathom.operators.ordered.sequence` (position and previous values).
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from fathom.operators import detector as det

MODEL_OUTPUT = ("survey_id long, idx long, type string, severity string, value double, "
                "confidence double, description string")
# Model file extensions the reference accepts.
MODEL_EXTENSIONS = [".onnx", ".pb", ".h5", ".pkl", ".joblib"]

BatchModel = Callable[[pd.DataFrame], pd.DataFrame]


def predict_anomalies(df: DataFrame, model: BatchModel | None = None, columns: list[str] | None = None) -> DataFrame:
    """Anomaly rows from the default detector, or from ``model`` per Arrow batch."""
    if model is None:
        return det.detector_anomalies(df)
    from fathom.session import ship_package
    ship_package(df.sparkSession)
    cols = columns or df.columns
    out_cols = [c.split()[0] for c in MODEL_OUTPUT.split(", ")]

    def run(batches):
        for pdf in batches:
            res = model(pdf)
            if len(res):
                yield res.reindex(columns=out_cols)

    return df.select(*cols).mapInPandas(run, MODEL_OUTPUT)


def model_info(model: BatchModel | None = None, model_path: str | None = None) -> dict:
    info = {
        "model_type": "deterministic_stub" if model is None else getattr(model, "__name__", "user_model"),
        "model_path": model_path,
        "model_loaded": True,
        "description": "Deterministic anomaly detection for ocean mapping data" if model is None
        else (model.__doc__ or "").strip(),
        "capabilities": det.CAPABILITIES if model is None else [],
    }
    if model_path:
        info["file_valid"] = validate_model_file(model_path)
    return info


def validate_model_file(path: str) -> bool:
    """Extension is a known model format and the file exists and is non-empty."""
    return (any(path.endswith(e) for e in MODEL_EXTENSIONS) and os.path.exists(path)
            and os.path.getsize(path) > 0)
