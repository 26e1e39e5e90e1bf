"""Column dictionaries and output layouts."""

from __future__ import annotations

import re

# --- fixed values: accepted raw headers and their normalised names ---
RAW_TO_NORMALISED = {
    "DataID": "data_id",
    "Name": "name",
    "SegmentID": "segment_id",
    "RouteAlternative": "route_alternative",
    "RequestedTime": "requested_time",
    "Timestamp": "timestamp",
    "DayInWeek": "day_in_week",
    "DayType": "day_type",
    "Duration": "duration",
    "Duration (seconds)": "duration",
    "Static Duration": "static_duration",
    "Static Duration (seconds)": "static_duration",
    "Distance": "distance",
    "Distance (meters)": "distance",
    "Speed": "speed",
    "Speed (km/h)": "speed",
    "Url": "url",
    "Polyline": "polyline",
}
OPTIONAL_COLUMNS = {"static_duration"}

# --- fixed values: output column order ---
HOURLY_COLUMNS = [
    "link_id", "date", "hour_of_day", "daytype", "n_total", "n_valid", "valid_hour", "no_valid_hour",
    "avg_duration_sec", "std_duration_sec", "avg_static_duration_sec", "std_static_duration_sec",
    "avg_distance_m", "avg_speed_kmh",
]
WEEKLY_COLUMNS = [
    "link_id", "daytype", "weekday_index", "hour_of_day", "avg_n_valid", "total_valid_n", "total_not_valid",
    "avg_dur", "std_dur", "avg_static_dur", "std_static_dur", "avg_dist", "avg_speed", "n_days",
]
REPORT_COLUMNS = [
    "From", "To", "perfect_match_percent", "threshold_pass_percent", "failed_percent", "total_success_rate",
    "total_observations", "successful_observations", "failed_observations", "total_routes",
    "single_route_observations", "multi_route_observations", "expected_observations", "missing_observations",
    "data_coverage_percent",
]
# names of at most ten characters for attribute tables with that limit
REPORT_SHORT_NAMES = {
    "perfect_match_percent": "perfect_p",
    "threshold_pass_percent": "thresh_p",
    "failed_percent": "failed_p",
    "total_success_rate": "total_succ",
    "total_observations": "total_obs",
    "successful_observations": "success_ob",
    "failed_observations": "failed_obs",
    "total_routes": "total_rts",
    "single_route_observations": "single_obs",
    "multi_route_observations": "multi_obs",
    "expected_observations": "expect_obs",
    "missing_observations": "missing_ob",
    "data_coverage_percent": "coverage_p",
}
# names under which stored rollups may carry the map columns
ROLLUP_VARIANTS = {
    "hour_of_day": "hour",
    "avg_dur": "avg_duration_sec",
    "avg_speed": "avg_speed_kmh",
}
NULL_TOKENS = ["", "NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "<NA>"]

LONG_COLUMNS = {"data_id", "segment_id"}
INT_COLUMNS = {"route_alternative"}
DOUBLE_COLUMNS = {"duration", "static_duration", "distance", "speed"}


def snake_case(name: str) -> str:
    """``RouteAlternative`` / ``my col-name`` -> ``route_alternative`` / ``my_col_name``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[\s\-._]+", "_", spaced).strip("_").lower()


def normalised_name(name: str) -> str:
    """Name a raw header gets after ingest."""
    return RAW_TO_NORMALISED.get(name) or snake_case(name)


def missing_columns(columns: list[str]) -> list[str]:
    """Required logical columns that no header in ``columns`` provides."""
    present = {normalised_name(c) for c in columns}
    required = dict.fromkeys(RAW_TO_NORMALISED.values())
    return [c for c in required if c not in OPTIONAL_COLUMNS and c not in present]
