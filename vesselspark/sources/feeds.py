"""Drone frames, the AIS aggregator's JSON, weather, AIS history and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark.functions.casts import iso_ts

DRONE_SCHEMA = """
  frame_id STRING, timestamp STRING, drone STRUCT<drone_id: STRING, name: STRING, position: STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude_m: DOUBLE, heading: DOUBLE>>,
  model STRUCT<name: STRING, version: STRING, inference_time_ms: INT>, detections_count INT,
  detections ARRAY<STRUCT<detection_id: STRING, class: STRING, confidence: DOUBLE, bbox: STRUCT<x: INT, y: INT, width: INT, height: INT>,
    geo_position: STRUCT<latitude: DOUBLE, longitude: DOUBLE>, estimated_dimensions: STRUCT<length_m: DOUBLE, width_m: DOUBLE>, tracking_id: STRING>>"""
AIS_SCHEMA = """
  MessageType STRING, MetaData STRUCT<MMSI: LONG, ShipName: STRING, time_utc: STRING, latitude: DOUBLE, longitude: DOUBLE>,
  Message STRUCT<
    PositionReport: STRUCT<UserID: LONG, Latitude: DOUBLE, Longitude: DOUBLE, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: DOUBLE, NavigationalStatus: INT>,
    ShipStaticData: STRUCT<UserID: LONG, Name: STRING, ImoNumber: LONG, Type: INT, Dimension: STRUCT<A: INT, B: INT>>>"""
WEATHER_SCHEMA = """
  location STRUCT<name: STRING, lat: DOUBLE, lon: DOUBLE>,
  current_weather STRUCT<time: STRING, temperature: DOUBLE, windspeed: DOUBLE, winddirection: DOUBLE, weathercode: INT>"""
HISTORY_SCHEMA = """
  mmsi STRING, ship_name STRING, ship_type STRING, timestamp STRING, latitude DOUBLE, longitude DOUBLE, speed_knots DOUBLE, heading DOUBLE,
  origin_port STRING, destination_port STRING, status STRING, anomaly_flag BOOLEAN, anomaly_type STRING"""


def drone_detections(frames: DataFrame) -> DataFrame:
    """One row per detection with its frame's data; frames without a readable time are not used."""
    each = frames.withColumn("ts", iso_ts("timestamp")).where("ts is not null").withColumn("d", F.explode("detections"))
    zero = F.lit(0.0)
    return each.select(
        "frame_id", "ts", "drone.drone_id", F.col("drone.name").alias("drone_name"), *(F.col(f"drone.position.{c}").alias(f"drone_{c}") for c in ("latitude", "longitude", "altitude_m", "heading")),
        F.col("model.name").alias("model_name"), F.col("model.version").alias("model_version"), "model.inference_time_ms", "detections_count",
        "d.detection_id", F.coalesce("d.class", F.lit("unknown")).alias("object_class"), F.coalesce("d.confidence", zero).alias("confidence"),
        F.struct(F.col("d.bbox.x"), F.col("d.bbox.y"), F.col("d.bbox.width").alias("w"), F.col("d.bbox.height").alias("h")).alias("bounding_box"),
        F.coalesce("d.geo_position.latitude", zero).alias("latitude"), F.coalesce("d.geo_position.longitude", zero).alias("longitude"),
        F.col("d.estimated_dimensions.length_m").alias("estimated_length_m"), F.col("d.estimated_dimensions.width_m").alias("estimated_width_m"), "d.tracking_id")


def read_drone(spark: SparkSession, path: str) -> DataFrame:
    """A folder of frames, one a file; files that can't be read give nothing."""
    return drone_detections(spark.read.schema(DRONE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path))


def ais_positions(messages: DataFrame) -> DataFrame:
    """Position reports and static data as one frame; other types go."""
    p, s, m = "Message.PositionReport", "Message.ShipStaticData", "MetaData"
    is_position, is_static = F.col("MessageType") == "PositionReport", F.col("MessageType") == "ShipStaticData"
    either = lambda a, b: F.when(is_position, a).otherwise(b)
    known = messages.where((is_position & F.col(p).isNotNull()) | (is_static & F.col(s).isNotNull()))
    number = lambda c: F.nullif(F.col(c), F.lit(0).cast("long"))
    size = F.coalesce(f"{s}.Dimension.A", F.lit(0)) + F.coalesce(f"{s}.Dimension.B", F.lit(0))
    return known.select(
        iso_ts(f"{m}.time_utc").alias("ts"), either(F.col(f"{p}.Latitude"), F.coalesce(f"{m}.latitude", F.lit(0.0))).alias("latitude"),
        either(F.col(f"{p}.Longitude"), F.coalesce(f"{m}.longitude", F.lit(0.0))).alias("longitude"),
        F.coalesce(either(number(f"{p}.UserID"), number(f"{s}.UserID")), F.col(f"{m}.MMSI")).cast("string").alias("mmsi"),
        either(F.col(f"{m}.ShipName"), F.coalesce(F.nullif(F.col(f"{s}.Name"), F.lit("")), F.col(f"{m}.ShipName"))).alias("ship_name"),
        F.col(f"{p}.Sog").alias("speed_knots"), F.col(f"{p}.TrueHeading").alias("heading"), F.col(f"{p}.Cog").alias("course"), F.col(f"{p}.NavigationalStatus").alias("nav_status"),
        F.when(is_static, F.col(f"{s}.ImoNumber").cast("string")).alias("imo"), F.when(is_static, F.coalesce(F.col(f"{s}.Type").cast("string"), F.lit(""))).alias("ship_type"),
        F.when(is_static, size.cast("double")).alias("vessel_length_m"))


def read_ais_json(spark: SparkSession, path: str) -> DataFrame:
    return ais_positions(spark.read.schema(AIS_SCHEMA).json(path))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    w = "current_weather"
    return spark.read.schema(WEATHER_SCHEMA).json(path).select(
        iso_ts(f"{w}.time").alias("ts"), F.col("location.lat").alias("latitude"), F.col("location.lon").alias("longitude"), F.col(f"{w}.temperature").alias("temperature_c"),
        F.col(f"{w}.windspeed").alias("wind_speed_knots"), F.col(f"{w}.winddirection").alias("wind_direction"), F.col(f"{w}.weathercode").alias("weather_code"),
        F.concat(F.lit("open-meteo:"), "location.name").alias("source"))


def read_ais_history(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(HISTORY_SCHEMA).option("header", True).csv(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(content, document_type, metadata)`` of a JSON array of documents."""
    rows = spark.read.schema("content STRING, metadata MAP<STRING, STRING>").option("multiLine", True).json(path)
    return rows.select("content", F.coalesce(F.col("metadata")["type"], F.lit("unknown")).alias("document_type"), "metadata")
