"""Ship data derived from the driver's ``events`` by whole-number arithmetic, so that Spark and SQL agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VESSEL_TYPES = ["CARGO", "TANKER", "CONTAINER", "FISHING", "PASSENGER", "BULK_CARRIER"]
SENSOR_OF = {"click": "ais", "signup": "ais", "view": "radar", "purchase": "satellite", "error": "drone"}
POSITIONS = f"""
  SELECT event_id, ts, cast(200000000 + user_id AS STRING) AS mmsi,
    concat('VESSEL ', lpad(cast(user_id AS STRING), 4, '0')) AS ship_name,
    CASE user_id % 6 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(VESSEL_TYPES))} END AS vessel_type,
    CASE {' '.join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in SENSOR_OF.items())} END AS sensor,
    cast(6 AS DOUBLE) + cast((user_id * 7919) % 1800 AS DOUBLE) / 100 + cast((event_id * 31) % 200 - 100 AS DOUBLE) / 1000 AS latitude,
    cast(66 AS DOUBLE) + cast((user_id * 104729) % 3300 AS DOUBLE) / 100 + cast((event_id * 17) % 200 - 100 AS DOUBLE) / 1000 AS longitude,
    value / 10 AS speed_knots, cast((event_id * 37) % 360 AS DOUBLE) AS course,
    cast(20 + (user_id * 13) % 380 AS DOUBLE) AS vessel_length_m, cast(event_id % 101 AS DOUBLE) / 100 AS confidence,
    event_type = 'purchase' AND event_id % 7 = 0 AS is_dark_ship
  FROM {{events}}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSITIONS.replace("{events}", "{source}"), source=table(spark, sf_dir, "events"))


def sql_positions() -> str:
    """The same as SQL, for a WITH clause."""
    return POSITIONS.format(events="events")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest position of each vessel as a track row."""
    last = positions(spark, sf_dir).groupBy("mmsi").agg(F.max_by(F.struct("*"), F.struct("ts", "event_id")).alias("p"))
    return last.select(
        F.concat(F.lit("TRK-"), "mmsi").alias("track_id"), "p.*",
        F.when(F.col("p.event_id") % 5 == 0, "dropped").when(F.col("p.event_id") % 5 == 1, "tentative").otherwise("confirmed").alias("track_status"),
        F.col("p.ts").alias("updated_at"))
