"""Satellite passes as GeoJSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark.functions.casts import iso_ts, text_or_null, to_bool

PASS_SCHEMA = """
  type STRING, metadata STRUCT<pass_id: STRING, satellite: STRING, sensor_type: STRING, acquisition_time: STRING, swath_width_km: DOUBLE,
    resolution_m: DOUBLE, cloud_cover_percent: DOUBLE, processing_level: STRING, detections_count: INT>,
  features ARRAY<STRUCT<type: STRING, id: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>,
    properties: STRUCT<detection_id: STRING, timestamp: STRING, confidence: DOUBLE, vessel_length_m: DOUBLE, vessel_width_m: DOUBLE,
      orientation_deg: DOUBLE, detection_method: STRING, is_dark_ship: BOOLEAN>>>, _corrupt STRING"""
CSV_SCHEMA = ", ".join(f"{c} STRING" for c in "pass_id satellite detection_id timestamp latitude longitude confidence length_m width_m orientation is_dark_ship detection_method".split())
OLD_CSV_SCHEMA = ", ".join(f"{c} STRING" for c in "detection_id timestamp latitude longitude confidence vessel_length_m source".split())
COLUMNS = ["detection_id", "ts", "latitude", "longitude", "confidence", "vessel_length_m", "vessel_width_m", "orientation_deg", "detection_method", "is_dark_ship", "pass_id", "satellite", "sensor_type"]


def read_passes(spark: SparkSession, path: str, glob: str = "*.{geojson,json}") -> DataFrame:
    """One row per file, as read."""
    reader = spark.read.schema(PASS_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob)
    return reader.json(path).withColumn("source", F.col("_metadata.file_path"))


def rejected_passes(passes: DataFrame) -> DataFrame:
    """Files that are no FeatureCollection."""
    return passes.where("coalesce(type, '') <> 'FeatureCollection'").select("source", "type", F.col("_corrupt").alias("content"))


def geojson_features(passes: DataFrame) -> DataFrame:
    """Detections of the passes; a feature without two coordinates or with an unreadable time goes."""
    each = passes.where("type = 'FeatureCollection'").select("metadata", F.explode("features").alias("f"))
    p = "f.properties"
    found = each.select(
        F.coalesce(f"{p}.detection_id", "f.id").alias("detection_id"), iso_ts(f"{p}.timestamp").alias("ts"),
        F.col("f.geometry.coordinates").alias("xy"), F.coalesce(f"{p}.confidence", F.lit(0.5)).alias("confidence"),
        *(F.col(f"{p}.{c}").alias(c) for c in ("vessel_length_m", "vessel_width_m", "orientation_deg", "detection_method")),
        F.coalesce(f"{p}.is_dark_ship", F.lit(False)).alias("is_dark_ship"), "metadata.pass_id", "metadata.satellite", "metadata.sensor_type")
    whole = found.where((F.size("xy") >= 2) & F.col("ts").isNotNull())
    return whole.withColumns({"latitude": F.get("xy", F.lit(1)), "longitude": F.get("xy", F.lit(0))}).where("latitude is not null and longitude is not null").select(*COLUMNS)


def read_satellite_geojson(spark: SparkSession, path: str) -> DataFrame:
    return geojson_features(read_passes(spark, path))


def csv_detections(rows: DataFrame) -> DataFrame:
    """Detections of text rows; one with an unreadable time, place, confidence or size goes."""
    number = lambda c: text_or_null(c).try_cast("double")
    fine = lambda c: text_or_null(c).isNull() | number(c).isNotNull()
    found = rows.where(fine("length_m") & fine("width_m") & fine("orientation")).select(
        "detection_id", iso_ts("timestamp").alias("ts"), number("latitude").alias("latitude"), number("longitude").alias("longitude"),
        number("confidence").alias("confidence"), number("length_m").alias("vessel_length_m"), number("width_m").alias("vessel_width_m"),
        number("orientation").alias("orientation_deg"), "detection_method", to_bool("is_dark_ship").alias("is_dark_ship"), "pass_id", "satellite", F.lit(None).cast("string").alias("sensor_type"))
    return found.where("ts is not null and latitude is not null and longitude is not null and confidence is not null")


def read_satellite_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_detections(spark.read.schema(CSV_SCHEMA).option("header", True).option("pathGlobFilter", "*.csv").csv(path))


def read_satellite_csv_old(spark: SparkSession, path: str) -> DataFrame:
    """The older layout of seven columns."""
    rows = spark.read.schema(OLD_CSV_SCHEMA).option("header", True).csv(path)
    missing = F.lit(None).cast("string")
    return csv_detections(rows.withColumnsRenamed({"vessel_length_m": "length_m", "source": "satellite"}).withColumns(
        {c: missing for c in ("pass_id", "width_m", "orientation", "is_dark_ship", "detection_method")}))


def read_satellite(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension, or a folder of files of both kinds."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".csv"):
        return read_satellite_csv(spark, path)
    if name.endswith((".geojson", ".json")):
        return read_satellite_geojson(spark, path)
    if "." in name:
        raise ValueError(f"neither GeoJSON nor CSV: {path}")
    return read_satellite_geojson(spark, path).unionByName(read_satellite_csv(spark, path))
