"""Class breaks and visual scales as data columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.quantiles import exact_quantiles, quantile_row

# --- fixed values: default symbology of the two metrics and the named presets ---
DEFAULT_SYMBOLOGY = {
    "duration": {"classification": "quantiles", "n_classes": 5, "outlier_caps": (2, 98), "width": (1, 8), "opacity": (0.3, 1.0)},
    "speed": {"classification": "quantiles", "n_classes": 5, "outlier_caps": (2, 98), "width": (1, 8), "opacity": (0.3, 1.0)},
}
PRESETS = {
    "duration_focused": {"metric": "duration", "classification": "quantiles", "n_classes": 7, "outlier_caps": (5, 95), "width": (2, 10), "opacity": (0.4, 1.0)},
    "speed_focused": {"metric": "speed", "classification": "standard_deviation", "n_classes": 5, "outlier_caps": (2, 98), "width": (1, 6), "opacity": (0.3, 0.9)},
    "reliability_focused": {"metric": "duration", "classification": "quantiles", "n_classes": 5, "outlier_caps": (10, 90), "width": (1, 8), "opacity": (0.2, 1.0)},
}
METRIC_COLUMNS = {"duration": "avg_duration_sec", "speed": "avg_speed_kmh"}


def _class_of(value: Column, breaks: Column, n_classes: int) -> Column:
    """0-based class: number of breaks not above the value, kept inside the classes."""
    index = F.size(F.filter(breaks, lambda b: b <= value)) - 1
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(index, F.lit(n_classes - 1))))


def quantile_breaks(df: DataFrame, column: str, n_classes: int = 5) -> DataFrame:
    """One row ``breaks``: equal numbers of values between neighbours."""
    probabilities = [i / n_classes for i in range(n_classes + 1)]
    return exact_quantiles(df, column, probabilities, "breaks")


def _even(low: Column, high: Column, n_classes: int) -> Column:
    return F.array(*[low + (high - low) * float(i) / n_classes for i in range(n_classes)], high)


def equal_breaks(df: DataFrame, column: str, n_classes: int = 5) -> DataFrame:
    return df.agg(_even(F.min(column), F.max(column), n_classes).alias("breaks"))


def _stddev(column: str, n_classes: int) -> Column:
    half = n_classes // 2
    inner = [F.avg(column) + i * F.stddev_pop(column) for i in range(-half, half + 1)]
    inner[0] = F.least(inner[0], F.min(column))
    inner[-1] = F.greatest(inner[-1], F.max(column))
    return F.array_sort(F.array(*inner))


def stddev_breaks(df: DataFrame, column: str, n_classes: int = 5) -> DataFrame:
    """Mean plus and minus whole population deviations; the outer breaks reach the data range."""
    return df.agg(_stddev(column, n_classes).alias("breaks"))


# In the functions below ``source`` is the table that statistics are taken from, by default ``df``
# itself. Chained calls pass the same source, so statistics do not nest.


def classify(
    df: DataFrame,
    column: str,
    method: str = "quantiles",
    n_classes: int = 5,
    manual_breaks: list[float] | None = None,
    source: DataFrame | None = None,
    breaks: Column | None = None,
) -> DataFrame:
    """Append ``class_index``. ``breaks`` are those of a method that needs statistics, where they are known already."""
    data = df if source is None else source
    classes = 2 * (n_classes // 2) if method == "standard_deviation" else n_classes
    if breaks is not None:
        pass
    elif method == "quantiles":
        breaks = quantile_breaks(data, column, n_classes).scalar()
    elif method == "equal_interval":
        breaks = equal_breaks(data, column, n_classes).scalar()
    elif method == "standard_deviation":
        breaks = stddev_breaks(data, column, n_classes).scalar()
    elif method == "manual":
        if not manual_breaks:
            raise ValueError("manual classification needs breaks")
        breaks, classes = F.array(*[F.lit(float(b)) for b in sorted(manual_breaks)]), len(manual_breaks) - 1
    else:
        raise ValueError(f"unknown method {method}")
    with_breaks = df.withColumn("__breaks", breaks)
    return with_breaks.withColumn("class_index", _class_of(F.col(column), F.col("__breaks"), classes)).drop("__breaks")


def capped_classes(
    df: DataFrame, column: str, caps=(2, 98), n_classes: int = 5, source: DataFrame | None = None, limits: Column | None = None
) -> DataFrame:
    """Append ``capped_value`` and ``color_index``: equal classes between two percentiles, ``limits`` where they are known."""
    if limits is None:
        limits = exact_quantiles(df if source is None else source, column, [caps[0] / 100, caps[1] / 100], "limits").scalar()
    low, high, value = F.col("__limits")[0], F.col("__limits")[1], F.col(column)
    capped = F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
    out = df.withColumn("__limits", limits).withColumns(
        {"capped_value": capped, "__breaks": _even(low, high, n_classes)}
    )
    index = _class_of(F.col("capped_value"), F.col("__breaks"), n_classes)
    return out.withColumn("color_index", index).drop("__limits", "__breaks")


def _scaled(df: DataFrame, name: str, value: Column, low: float, high: float, source: DataFrame | None) -> DataFrame:
    span = (df if source is None else source).agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s"))
    lo, hi = F.col("__span.lo"), F.col("__span.hi")
    # a constant column maps to the lower end
    share = F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.when(value.isNotNull(), 0.0))
    return df.withColumn("__span", span.scalar()).withColumn(name, share * (high - low) + low).drop("__span")


def width_scale(
    df: DataFrame, column: str = "n_valid", limits=(1, 8), mapping: str = "linear", source: DataFrame | None = None
) -> DataFrame:
    """Append ``line_width`` by min-max scaling of the value, its log(1 + x) or its root."""
    value = {"log": F.log1p(column), "sqrt": F.sqrt(column)}.get(mapping, F.col(column).cast("double"))
    return _scaled(df, "line_width", value, *limits, source)


def opacity_scale(
    df: DataFrame, column: str = "n_valid", limits=(0.3, 1.0), kind: str = "sample_size", source: DataFrame | None = None
) -> DataFrame:
    """Append ``opacity``; sample sizes are scaled on log(1 + n)."""
    value = F.log1p(column) if kind == "sample_size" else F.col(column).cast("double")
    return _scaled(df, "opacity", value, *limits, source)


def color_ramp(df: DataFrame, column: str, source: DataFrame | None = None) -> DataFrame:
    """Append ``color``: green over yellow to red between the 5th and 95th percentile, grey for NULL."""
    limits = exact_quantiles(df if source is None else source, column, [0.05, 0.95], "limits")
    low, high, value = F.col("__limits")[0], F.col("__limits")[1], F.col(column)
    share = F.when(
        high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0))))
    ).otherwise(0.5)
    ranked = df.withColumn("__limits", limits.scalar()).withColumn("normalized", F.when(value.isNotNull(), share))
    n = F.col("normalized")
    red = F.when(n < 0.5, F.floor(n * 2 * 255)).otherwise(255).cast("int")
    green = F.when(n < 0.5, 255).otherwise(F.floor((1 - n) * 2 * 255)).cast("int")
    hexed = F.when(n.isNotNull(), F.format_string("#%02x%02x00", red, green)).otherwise("#999999")
    return ranked.withColumn("color", hexed).drop("__limits")


def traffic_class(df: DataFrame, metric: str = "duration") -> DataFrame:
    """Append ``duration_min`` and a three-colour class by fixed limits."""
    out = df.withColumn("duration_min", F.col("avg_duration_sec") / 60)
    if metric == "speed":
        speed = F.col("avg_speed_kmh")
        color = F.when(speed < 30, "red").when(speed < 50, "orange").otherwise("green")
    else:
        minutes = F.col("duration_min")
        color = F.when(minutes < 3, "green").when(minutes < 5, "orange").otherwise("red")
    return out.withColumn("color", color)


def symbology(df: DataFrame, metric: str = "duration", preset: str | None = None) -> DataFrame:
    """All class and scale columns of one metric under a default or named configuration."""
    config = PRESETS[preset] if preset else DEFAULT_SYMBOLOGY[metric]
    column = METRIC_COLUMNS[config.get("metric", metric)]
    n, method, caps = config["n_classes"], config["classification"], config["outlier_caps"]
    # breaks and caps of one column come from one selection
    wanted = {"limits": (column, [caps[0] / 100, caps[1] / 100])}
    if method == "quantiles":
        wanted["breaks"] = (column, [i / n for i in range(n + 1)])
    row = quantile_row(df, wanted, [_stddev(column, n).alias("breaks")] if method == "standard_deviation" else None)
    known = row.select(F.struct("*").alias("s")).scalar()
    out = df.withColumn("__known", known)
    breaks = F.col("__known.breaks") if "breaks" in row.columns else None
    out = classify(out, column, method, n, source=df, breaks=breaks)
    out = capped_classes(out, column, caps, n, limits=F.col("__known.limits")).drop("__known")
    out = width_scale(out, "n_valid", config["width"], source=df)
    return opacity_scale(out, "n_valid", config["opacity"], source=df)
