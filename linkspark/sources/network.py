"""Reference networks from Parquet, CSV with WKT, or GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions.geometry import from_wkt
from linkspark.functions.text import link_key
from linkspark.operators.spatial import drop_unusable

REQUIRED = ["Id", "From", "To"]
GEOJSON_FEATURE = (
    "type STRING, properties MAP<STRING, STRING>, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>"
)


def resolve_fields(df: DataFrame) -> DataFrame:
    """Bring ``Id``, ``From``, ``To`` to that spelling; ValueError when one is absent."""
    by_lower = {c.lower(): c for c in df.columns}
    missing = [r for r in REQUIRED if r.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing network fields: {', '.join(missing)}")
    return df.withColumnsRenamed({by_lower[r.lower()]: r for r in REQUIRED})


def finish(df: DataFrame) -> DataFrame:
    """Resolved fields, ``link_id``, and only links with a usable line."""
    resolved = resolve_fields(df)
    keyed = resolved.withColumn("link_id", link_key(F.col("From"), F.col("To")))
    return drop_unusable(keyed.where(F.col("line").isNotNull()))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columns Id, From, To and ``line`` or WKT ``geometry``."""
    df = spark.read.parquet(path)
    return finish(df if "line" in df.columns else _from_wkt(df))


def read_wkt_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return finish(_from_wkt(spark.read.option("header", True).option("sep", sep).csv(path)))


def _from_wkt(df: DataFrame) -> DataFrame:
    geometry = next((c for c in df.columns if c.lower() in ("geometry", "wkt", "geom")), None)
    if geometry is None:
        raise ValueError("no geometry column")
    return df.withColumn("line", from_wkt(F.col(geometry))).drop(geometry)


def from_features(features: DataFrame) -> DataFrame:
    """Text rows ``value``, one GeoJSON feature each."""
    parsed = features.select(F.from_json("value", GEOJSON_FEATURE).alias("f")).where(
        F.col("f.geometry.type") == "LineString"
    )
    line = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    def field(name: str):
        names = [name, name.lower(), name.upper()]
        return F.coalesce(*[F.try_element_at("f.properties", F.lit(n)) for n in names]).alias(name)

    return finish(parsed.select(*[field(name) for name in REQUIRED], line.alias("line")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    return from_features(spark.read.text(path))
