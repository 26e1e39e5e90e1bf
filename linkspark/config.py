"""Run parameters. One dataclass per workflow, one name per setting."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from zoneinfo import ZoneInfo

INFINITY = float("inf")


@dataclass(frozen=True)
class AggregationParams:
    """Settings of the hourly / weekly rollup run."""

    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    timezone: str = "Asia/Jerusalem"
    # validity
    valid_codes_ok: tuple[str, ...] = ()
    duration_range_sec: tuple[float, float] = (0.0, INFINITY)
    distance_range_m: tuple[float, float] = (0.0, INFINITY)
    speed_range_kmh: tuple[float, float] = (0.0, INFINITY)
    # deduplication
    remove_data_id_duplicates: bool = True
    remove_link_timestamp_duplicates: bool = True
    # selection
    start_date: date | str | None = None
    end_date: date | str | None = None
    weekday_include: tuple[int, ...] | None = None
    hours_include: tuple[int, ...] | None = None
    whitelist_links: tuple[str, ...] | str | None = None
    blacklist_links: tuple[str, ...] | str | None = None
    weekday_only: bool = False
    weekend_only: bool = False
    holiday_only: bool = False
    # day types and holidays
    daytype_mapping: dict = field(default_factory=dict)
    holidays_as: str = "holiday"
    # rollups
    min_valid_per_hour: int = 1
    weekly_grouping: str = "daytype"
    recompute_std_from_raw: bool = False
    write_parquet: bool = False

    def check(self) -> "AggregationParams":
        """Raise ValueError when a setting is outside its allowed range."""
        if isinstance(self.min_valid_per_hour, bool) or not isinstance(self.min_valid_per_hour, int):
            raise ValueError("min_valid_per_hour must be an int")
        if not 0 <= self.min_valid_per_hour <= 1000:
            raise ValueError("min_valid_per_hour must be between 0 and 1000")
        if not is_valid_timezone(self.timezone):
            raise ValueError(f"unknown timezone: {self.timezone}")
        if self.weekly_grouping not in ("daytype", "weekday_index"):
            raise ValueError("weekly_grouping must be 'daytype' or 'weekday_index'")
        if self.holidays_as not in ("holiday", "weekend", "weekday"):
            raise ValueError("holidays_as must be 'holiday', 'weekend' or 'weekday'")
        return self


@dataclass(frozen=True)
class ValidationParams:
    """Settings of the geometric validation of observed routes."""

    use_hausdorff: bool = True
    use_length_check: bool = False
    use_coverage_check: bool = False
    hausdorff_threshold_m: float = 5.0
    length_check_mode: str = "ratio"
    length_ratio_min: float = 0.90
    length_ratio_max: float = 1.10
    epsilon_length_m: float = 0.5
    min_link_length_m: float = 20.0
    coverage_min: float = 0.85
    coverage_spacing_m: float = 1.0
    polyline_precision: int = 5
    # None: decoded coordinates are metric already
    crs_metric: str | None = "EPSG:2039"


@dataclass(frozen=True)
class CompletenessParams:
    """Recording schedule that expected observations are derived from."""

    start_date: date
    end_date: date
    interval_minutes: int = 15

    def expected_observations(self) -> int:
        """Slots of all whole days from start to end, both included."""
        if self.start_date > self.end_date:
            return 0
        days = (self.end_date - self.start_date).days + 1
        return int(days * 1440 / self.interval_minutes)


@dataclass(frozen=True)
class QualityThresholds:
    """Limits used by the data-quality audit."""

    min_valid_speed: float = 0.1
    max_valid_speed: float = 200.0
    extreme_low_speed: float = 5.0
    extreme_high_speed: float = 120.0
    min_valid_duration: float = 1.0
    max_valid_duration: float = 7200.0
    extreme_short_duration: float = 30.0
    extreme_long_duration: float = 3600.0
    min_observations_reliable: int = 10
    min_observations_sparse: int = 3
    min_observations_critical: int = 1
    min_length_m: float = 1.0
    max_length_m: float = 50000.0


def is_valid_timezone(name: str) -> bool:
    """True when ``name`` is a known IANA zone."""
    try:
        ZoneInfo(name)
    except Exception:
        return False
    return True
