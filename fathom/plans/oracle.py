"""SQL text builders for the DuckDB oracles.

These only produce SQL strings that the driver (or tools/oracle_check.py)
runs in DuckDB to check the Spark operators; nothing here executes queries.
"""

from __future__ import annotations

from fathom.operators.rules import RANGE_RULES, rules_for


def sql_range(view: str, sensor: str, only: list[str] | None = None, columns: list[str] | None = None) -> str:
    """Range anomalies (survey_id, idx, rule, type, severity, column, value, threshold)."""
    cols = [c for c in rules_for(sensor) if c in RANGE_RULES and (only is None or c in only)]
    if columns is not None:
        cols = [c for c in cols if c in columns]
    parts = []
    for c in cols:
        lo, hi, typ, sev, thr = RANGE_RULES[c][:5]
        parts.append(
            f"SELECT survey_id, idx, '{c}_range_check' AS rule, '{typ}' AS type, '{sev}' AS severity, "
            f"'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, '{thr}' AS threshold "
            f"FROM {view} WHERE {c} < {lo} OR {c} > {hi}")
    return "\nUNION ALL\n".join(parts)


def sql_duplicate_ts(view: str) -> str:
    return (f"SELECT survey_id, CAST(NULL AS BIGINT) AS idx, 'duplicate_timestamp_check' AS rule, "
            f"'duplicate_timestamp' AS type, 'medium' AS severity, 'timestamp' AS \"column\", "
            f"CAST(sum(n) AS DOUBLE) AS value, '0' AS threshold "
            f"FROM (SELECT survey_id, timestamp, count(*) AS n FROM {view} GROUP BY survey_id, timestamp) d "
            f"WHERE n > 1 GROUP BY survey_id")


def sql_outliers(view: str) -> str:
    return (f"SELECT v.survey_id, v.idx, 'depth_consistency_check' AS rule, 'depth_outlier' AS type, "
            f"'medium' AS severity, 'depth' AS \"column\", v.depth AS value, "
            f"printf('3σ from mean (%.2f±%.2f)', s.mean, s.std) AS threshold "
            f"FROM {view} v JOIN (SELECT survey_id, count(*) AS n_rows, count(depth) AS n_values, "
            f"avg(depth) AS mean, stddev_samp(depth) AS std FROM {view} GROUP BY survey_id) s "
            f"ON v.survey_id = s.survey_id "
            f"WHERE s.n_rows >= 10 AND s.n_values >= 5 AND abs(v.depth - s.mean) > 3 * s.std")


def sql_rule_anomalies(view: str, sensor: str, has_ts: bool = True, has_depth: bool = True,
                       columns: list[str] | None = None) -> str:
    from fathom.plans.views import VIEW_COLUMNS
    columns = columns if columns is not None else VIEW_COLUMNS.get(view)
    parts = [sql_range(view, sensor, columns=columns)]
    rules = rules_for(sensor)
    if "duplicate_timestamp" in rules and has_ts:
        parts.append(sql_duplicate_ts(view))
    if "depth_consistency" in rules and has_depth:
        parts.append(sql_outliers(view))
    return "\nUNION ALL\n".join(p for p in parts if p)


def sql_depth_seq(view: str) -> str:
    return (f"SELECT survey_id, idx, depth, "
            f"depth - lag(depth) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS diff, "
            f"row_number() OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) - 1 AS pos "
            f"FROM {view}")


def sql_detector(view: str) -> str:
    """Detector anomalies (survey_id, idx, pos, type, severity, value, confidence)."""
    return f"""
SELECT survey_id, idx, pos, 'depth_jump' AS type,
       CASE WHEN abs(diff) > 200 THEN 'high' ELSE 'medium' END AS severity,
       round(diff, 6) AS value, round(CAST(least(1.0, abs(diff) / 200.0) AS DOUBLE), 6) AS confidence
FROM ({sql_depth_seq(view)}) s WHERE diff > 100 OR diff < -100
UNION ALL
SELECT survey_id, idx, pos, 'unrealistic_depth', 'high', depth, CAST(1.0 AS DOUBLE)
FROM ({sql_depth_seq(view)}) s WHERE depth < 0 OR depth > 12000
UNION ALL
SELECT survey_id, NULL, NULL, 'coordinate_duplicate', 'medium', CAST(n AS DOUBLE), round(CAST(least(1.0, n / 50.0) AS DOUBLE), 6)
FROM (SELECT survey_id, latitude, longitude, count(*) AS n FROM {view}
      WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY survey_id, latitude, longitude) g
WHERE n > 10"""


def sql_tier(rate: str, high: str, total: str, tiers, zero, rest) -> str:
    whens = "".join(f" WHEN {rate} < {b} THEN {s}" for b, s in tiers)
    zero_part = f" WHEN {rate} = 0 THEN {zero}" if zero is not None else ""
    base = f"(CASE{zero_part}{whens} ELSE {rest} END)"
    return (f"CAST(CASE WHEN {total} = 0 THEN 0.0 WHEN {high} > 0 THEN least({base}, 0.6) "
            f"ELSE {base} END AS DOUBLE)")


# Grid oracles: points, per-survey bounds, binned cells and node axes as CTEs.
def sql_grid_cells(res=0.01, depth_filter=True, src="soundings_mbes", z="depth", where="latitude <= 90 AND longitude >= -180"):
    r = f"CAST({res} AS DOUBLE)"
    dfil = f" AND {z} IS NOT NULL" if depth_filter else ""
    return f"""
pts AS (SELECT survey_id, idx, latitude, longitude, {z} AS z FROM {src}
        WHERE {where}{dfil}),
b AS (SELECT survey_id, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon,
             max(longitude) AS max_lon, count(*) AS valid_points,
             CAST(ceil(((max(latitude) + {r}) - min(latitude)) / {r}) AS INT) AS n_rows,
             CAST(ceil(((max(longitude) + {r}) - min(longitude)) / {r}) AS INT) AS n_cols
      FROM pts GROUP BY survey_id),
cells AS (SELECT * FROM (
            SELECT p.survey_id, p.idx, p.z, CAST(floor((p.latitude - b.min_lat) / {r}) AS INT) AS row,
                   CAST(floor((p.longitude - b.min_lon) / {r}) AS INT) AS col, b.n_rows, b.n_cols
            FROM pts p JOIN b ON p.survey_id = b.survey_id) x
          WHERE row >= 0 AND row < n_rows AND col >= 0 AND col < n_cols),
nodes AS (SELECT survey_id, CAST(row AS INT) AS row, CAST(unnest(range(0, n_cols)) AS INT) AS col,
                 min_lat + CAST(row AS INT) * {r} AS lat, min_lon * 1 AS min_lon
          FROM (SELECT survey_id, min_lat, min_lon, n_cols, unnest(range(0, n_rows)) AS row FROM b) rr)"""


def sql_with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"
