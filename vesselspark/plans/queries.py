"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

Ship data come from ``adapter``. ``NOW`` stands for the present. Native limits of seconds would split everything at the
density of these tables, so gaps are of hours here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.operators import filters, history, proximity, sinks
from vesselspark.plans.adapter import positions, sql_positions, tracks

NOW = datetime(2024, 1, 31)
MUMBAI, CHENNAI = (18.9388, 72.8354), (13.0827, 80.2707)
QUERIES: dict = {}
SQL: dict[str, str] = {}

P = f"p AS ({sql_positions()})"
T = P + """, t AS (
  SELECT 'TRK-' || mmsi AS track_id, *, CASE event_id % 5 WHEN 0 THEN 'dropped' WHEN 1 THEN 'tentative' ELSE 'confirmed' END AS track_status, ts AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS rn FROM p) WHERE rn = 1)"""


def km(lat1, lon1, lat2, lon2, radius=6371.0) -> str:
    """Great-circle distance as SQL."""
    return (f"(2 * {radius} * asin(sqrt(least(1.0, power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))")


def nm(*at) -> str:
    return km(*at, radius=3440.065)


def values(rows, names) -> str:
    """A table of constants as SQL."""
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) + ("::DOUBLE" if isinstance(x, float) else "") for x in row) + ")" for row in rows)
    return f"(VALUES {body}) AS d({names})"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


# Selections

@query("f1_speed_anomalies", f"WITH {P} SELECT event_id, mmsi, speed_knots FROM p WHERE speed_knots > 25")
def _(spark, d):
    return filters.speed_anomalies(positions(spark, d), 25).select("event_id", "mmsi", "speed_knots")


@query("f2_bounding_box", f"WITH {P} SELECT event_id, mmsi, latitude, longitude FROM p WHERE latitude BETWEEN 8 AND 20 AND longitude BETWEEN 70 AND 80")
def _(spark, d):
    return filters.in_bounding_box(positions(spark, d), 8, 20, 70, 80).select("event_id", "mmsi", "latitude", "longitude")


@query("f3_trajectory", f"WITH {P} SELECT event_id, ts, latitude, longitude FROM p WHERE mmsi = '200000007'")
def _(spark, d):
    return filters.ship_trajectory(positions(spark, d), "200000007").select("event_id", "ts", "latitude", "longitude")


@query("f4_active_tracks", f"WITH {T} SELECT track_id, track_status, updated_at FROM t WHERE track_status <> 'dropped'")
def _(spark, d):
    return filters.active_tracks(tracks(spark, d)).select("track_id", "track_status", "updated_at")


@query("f5_dark_ships", f"WITH {T} SELECT track_id, latitude, longitude FROM t WHERE track_status <> 'dropped' AND is_dark_ship")
def _(spark, d):
    return filters.active_dark_ships(tracks(spark, d)).select("track_id", "latitude", "longitude")


@query("f6_tracks_where", f"WITH {T} SELECT track_id, vessel_type, speed_knots FROM t WHERE vessel_type = 'TANKER' AND speed_knots > 2")
def _(spark, d):
    return filters.tracks_where(tracks(spark, d), "TANKER", faster=2).select("track_id", "vessel_type", "speed_knots")


@query("f7_heading_north", f"WITH {P} SELECT event_id, course FROM p WHERE course >= 315 OR course <= 45")
def _(spark, d):
    return filters.heading_sector(positions(spark, d), "north").select("event_id", "course")


@query("f7_heading_east", f"WITH {P} SELECT event_id, course FROM p WHERE course BETWEEN 45 AND 135")
def _(spark, d):
    return filters.heading_sector(positions(spark, d), "east").select("event_id", "course")


@query("f8_last_2_days", f"WITH {P} SELECT event_id, ts FROM p WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 DAY")
def _(spark, d):
    return filters.time_filter(positions(spark, d), "2 days", NOW, "ts").select("event_id", "ts")


@query("f8_yesterday", f"WITH {P} SELECT event_id, ts FROM p WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'")
def _(spark, d):
    return filters.time_filter(positions(spark, d), "yesterday", NOW, "ts").select("event_id", "ts")


@query("f10_match_filters", f"""WITH {T} SELECT track_id, vessel_type, speed_knots FROM t
  WHERE contains(replace(upper(vessel_type), '_', ' '), 'BULK') AND speed_knots > 1 AND {km('latitude', 'longitude', 9.9312, 76.2673)} <= 100""")
def _(spark, d):
    return filters.match_filters(tracks(spark, d), {"vessel_type": "bulk", "speed_gt": 1, "port": "Kochi", "limit": 5}).select("track_id", "vessel_type", "speed_knots")


@query("f11_cargo_overspeed", f"""WITH {P} SELECT event_id, mmsi, speed_knots FROM p WHERE speed_knots > 25 AND 60 + cast(mmsi AS BIGINT) % 30 BETWEEN 70 AND 79
  ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(spark, d):
    typed = positions(spark, d).withColumn("ship_type_code", F.col("mmsi").cast("long") % 30 + 60)
    return filters.cargo_overspeed(typed).select("event_id", "mmsi", "speed_knots")


@query("f12_track_by_id", f"WITH {T} SELECT track_id, track_status, latitude FROM t WHERE track_id = 'TRK-200000011'")
def _(spark, d):
    return filters.track_by_id(tracks(spark, d), "TRK-200000011").select("track_id", "track_status", "latitude")


@query("f13_recently_updated", f"WITH {T} SELECT track_id, updated_at FROM t WHERE track_status <> 'dropped' AND updated_at >= TIMESTAMP '2024-01-30 12:00:00'")
def _(spark, d):
    return filters.recently_updated(tracks(spark, d), NOW, 43_200).select("track_id", "updated_at")


# Joins by place

@query("j1_ships_near_point", f"""WITH {T} SELECT track_id, round(distance_km, 4) AS distance_km FROM (
  SELECT track_id, {km('latitude', 'longitude', *MUMBAI)} AS distance_km FROM t WHERE track_status <> 'dropped') WHERE distance_km <= 600 ORDER BY distance_km, track_id LIMIT 100""")
def _(spark, d):
    found = proximity.ships_near_point(tracks(spark, d), *MUMBAI, 600)
    return found.select("track_id", F.round("distance_km", 4).alias("distance_km"))


@query("j2_ships_near_port", f"""WITH {T} SELECT track_id, 'Chennai' AS port_name, round(distance_km, 4) AS distance_km FROM (
  SELECT track_id, {km('latitude', 'longitude', *CHENNAI)} AS distance_km FROM t WHERE track_status <> 'dropped') WHERE distance_km <= 500 ORDER BY distance_km, track_id LIMIT 100""")
def ships_near_port(spark: SparkSession, d: str) -> DataFrame:
    found = proximity.ships_near_port(tracks(spark, d), config.ports(spark), "chennai", 500)
    return found.select("track_id", "port_name", F.round("distance_km", 4).alias("distance_km"))


@query("j3_positions_near_port", f"WITH {P} SELECT event_id, round(x, 4) AS distance_nm FROM (SELECT *, {nm('latitude', 'longitude', *MUMBAI)} AS x FROM p) WHERE x < 100")
def _(spark, d):
    return proximity.positions_near_port(positions(spark, d), *MUMBAI, 100).select("event_id", F.round("distance_nm", 4).alias("distance_nm"))


@query("j4_ships_in_range", f"WITH {P} SELECT event_id, mmsi, round(x, 4) AS distance_nm FROM (SELECT *, {nm('latitude', 'longitude', *CHENNAI)} AS x FROM p) WHERE x <= 80")
def _(spark, d):
    return proximity.ships_in_range(positions(spark, d), *CHENNAI, 80).select("event_id", "mmsi", F.round("distance_nm", 4).alias("distance_nm"))


ZONES = [("Z1", 15.5, 73.0, 60.0), ("Z2", 12.0, 75.0, 80.0)]


@query("j5_zone_violations", f"""WITH {P} SELECT event_id, zone, round(x, 2) AS distance_nm FROM (
  SELECT event_id, zone, r, {nm('latitude', 'longitude', 'zlat', 'zlon')} AS x FROM p CROSS JOIN {values(ZONES, 'zone, zlat, zlon, r')}) WHERE x < r""")
def _(spark, d):
    zones = spark.createDataFrame(ZONES, "zone string, latitude double, longitude double, radius_nm double")
    return proximity.zone_violations(positions(spark, d), zones).select("event_id", "zone", "distance_nm")


@query("j6_radar_coverage", f"""WITH {P} SELECT event_id, station_id, round(x, 4) AS distance_nm,
    round(0.85 * greatest(0.0, 1 - power(x / r, 2)) * least(1.5, 0.5 + 0.5 * vessel_length_m / 100), 6) AS probability FROM (
  SELECT event_id, vessel_length_m, station_id, r, {nm('latitude', 'longitude', 'slat', 'slon')} AS x FROM p CROSS JOIN {values(config.RADAR_STATIONS, 'station_id, name, slat, slon, r')}) WHERE x <= r""")
def _(spark, d):
    seen = proximity.radar_coverage(positions(spark, d).withColumn("rcs_m2", F.col("vessel_length_m") / 100), config.radar_stations(spark))
    return seen.select("event_id", "station_id", F.round("distance_nm", 4).alias("distance_nm"), F.round("probability", 6).alias("probability"))


PASSES = [("P1", "SAR", 0.3, 8.0, 20.0, 70.0, 72.5), ("P2", "optical", 0.4, 10.0, 12.0, 66.0, 99.0)]


@query("j7_swath_coverage", f"""WITH {P} SELECT event_id, pass_id, CASE WHEN kind = 'SAR' THEN 0.95 ELSE round(0.85 * (1 - cloud), 4) END::DOUBLE AS probability
  FROM p JOIN {values(PASSES, 'pass_id, kind, cloud, a, b, c, e')} ON latitude BETWEEN a AND b AND longitude BETWEEN c AND e""")
def _(spark, d):
    passes = spark.createDataFrame(PASSES, "pass_id string, sensor_type string, cloud_cover double, lat_min double, lat_max double, lon_min double, lon_max double")
    return proximity.swath_coverage(positions(spark, d), passes).select("event_id", "pass_id", F.round("probability", 4).alias("probability"))


@query("j8_patrol_coverage", f"""WITH {P} SELECT event_id, zone_id, round(x, 4) AS distance_nm FROM (
  SELECT event_id, zone_id, r, {nm('latitude', 'longitude', 'zlat', 'zlon')} AS x FROM p CROSS JOIN {values(config.PATROL_ZONES, 'zone_id, name, zlat, zlon, r')}) WHERE x <= r""")
def _(spark, d):
    found = proximity.patrol_coverage(positions(spark, d), config.patrol_zones(spark))
    return found.select("event_id", "zone_id", F.round("distance_nm", 4).alias("distance_nm"))


REGION_SQL = values(config.REGIONS, "region, lat_min, lat_max, lon_min, lon_max")


@query("j9_regions", f"WITH {P} SELECT event_id, region FROM p JOIN {REGION_SQL} ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max")
def _(spark, d):
    return proximity.assign_regions(positions(spark, d), config.regions(spark)).select("event_id", "region")


# Aggregates

@query("a1_traffic_over_time", f"""WITH {P}, b AS (SELECT unnest(generate_series(cast(floor(epoch(min(ts)) / 21600) AS BIGINT), cast(floor(epoch(max(ts)) / 21600) AS BIGINT))) AS bin FROM p)
  SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(bin * 21600) AS interval_start, count(DISTINCT mmsi) AS vessels, count(mmsi) AS positions
  FROM b LEFT JOIN p ON cast(floor(epoch(ts) / 21600) AS BIGINT) = bin GROUP BY bin""")
def _(spark, d):
    return history.traffic_over_time(positions(spark, d), 6)


@query("a2_speed_stats", f"""WITH {P} SELECT vessel_type, round(avg(speed_knots), 2) AS mean_speed, round(stddev_samp(speed_knots), 2) AS std_speed, round(min(speed_knots), 2) AS min_speed,
  round(max(speed_knots), 2) AS max_speed, count(speed_knots) AS n FROM p GROUP BY vessel_type""")
def _(spark, d):
    return history.speed_stats_by_type(positions(spark, d))


@query("a3_vessels_by_type", f"WITH {P} SELECT vessel_type, count(DISTINCT mmsi) AS vessels FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 10000) GROUP BY vessel_type")
def _(spark, d):
    return history.vessels_by_type(positions(spark, d))


@query("a4_vessels_by_region", f"""WITH {P} SELECT region, count(DISTINCT mmsi) AS vessels FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 10000)
  JOIN {REGION_SQL} ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max GROUP BY region""")
def _(spark, d):
    return history.vessels_by_region(positions(spark, d), config.regions(spark))


@query("a5_tracks_by_type", f"WITH {T} SELECT vessel_type, count(*) AS n FROM t WHERE track_status = 'confirmed' GROUP BY vessel_type")
def _(spark, d):
    return history.tracks_by_type(tracks(spark, d))


@query("a6_stream_counts", f"WITH {P} SELECT sensor, count(*) AS messages FROM p GROUP BY sensor")
def _(spark, d):
    return history.stream_counts(positions(spark, d))


@query("a7_fleet_summary", f"""WITH {T} SELECT count(*) AS ships, count(*) FILTER (is_dark_ship) AS dark_ships, round(count(*) FILTER (is_dark_ship) * 100.0 / count(*), 1)::DOUBLE AS dark_percent,
  min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude FROM t""")
def _(spark, d):
    return history.fleet_summary(tracks(spark, d))


@query("a8_vessel_master", f"""WITH {P} SELECT mmsi, ship_name, vessel_type, last_seen, total_positions FROM (
  SELECT mmsi, min(ship_name) AS ship_name, min(vessel_type) AS vessel_type, max(ts) AS last_seen, count(*) AS total_positions FROM p GROUP BY mmsi)""")
def _(spark, d):
    return history.vessel_master(positions(spark, d))


SATELLITE_SQL = values(config.SATELLITES, "satellite, sensor_type, resolution_m, swath_km")


@query("a9_pass_summary", f"""WITH {P}, s AS (SELECT *, 'PASS-' || strftime(ts, '%Y%m%d') AS pass_id, CASE WHEN day(ts) % 2 = 0 THEN 'Sentinel-1A' ELSE 'Sentinel-2A' END AS satellite FROM p WHERE sensor = 'satellite'),
  g AS (SELECT pass_id, min(satellite) AS satellite, min(ts) AS acquisition_time, count(*) AS detections, count(*) FILTER (is_dark_ship) AS dark_detections FROM s GROUP BY pass_id)
  SELECT pass_id, satellite, sensor_type, swath_km, acquisition_time, detections, dark_detections FROM g LEFT JOIN {SATELLITE_SQL} USING (satellite)""")
def _(spark, d):
    seen = positions(spark, d).where("sensor = 'satellite'").withColumns({
        "pass_id": F.concat(F.lit("PASS-"), F.date_format("ts", "yyyyMMdd")), "detection_id": F.col("event_id"),
        "satellite": F.when(F.dayofmonth("ts") % 2 == 0, "Sentinel-1A").otherwise("Sentinel-2A")})
    found = history.pass_summary(seen, config.satellites(spark))
    return found.select("pass_id", "satellite", "sensor_type", "swath_km", "acquisition_time", "detections", "dark_detections")


@query("a10_sensor_contributions", f"""WITH {P}, g AS (SELECT mmsi, sensor, count(*) AS n, max(ts) AS last_update, max(confidence) AS confidence, min(ts) AS first_ts FROM p GROUP BY mmsi, sensor)
  SELECT mmsi AS track_id, sensor, n AS measurement_count, last_update, confidence FROM g""")
def _(spark, d):
    assigned = positions(spark, d).withColumns({"track_id": F.col("mmsi"), "sensor_id": F.upper("sensor")})
    found = history.sensor_contributions(assigned).select("track_id", F.explode("sensor_contributions").alias("sensor", "c"))
    return found.select("track_id", "sensor", "c.measurement_count", "c.last_update", "c.confidence")


@query("a14_dataset_summary", f"""WITH {P}, w AS (SELECT count(*) AS rows, count(DISTINCT mmsi) AS ships, min(ts) AS first_ts, max(ts) AS last_ts FROM p)
  SELECT w.*, vessel_type, n FROM w, (SELECT vessel_type, count(*) AS n FROM p GROUP BY vessel_type)""")
def _(spark, d):
    return history.dataset_summary(positions(spark, d)).select("rows", "ships", "first_ts", "last_ts", F.explode("by_type").alias("vessel_type", "n"))


# Windows and top-k

@query("w1_latest_positions", f"WITH {P} SELECT mmsi, event_id, ts, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS rn FROM p) WHERE rn = 1")
def _(spark, d):
    return history.latest_positions(positions(spark, d)).select("mmsi", "event_id", "ts", "latitude", "longitude")


@query("w2_latest_tracks", f"WITH {T} SELECT mmsi, track_id, updated_at FROM t WHERE track_status <> 'dropped'")
def _(spark, d):
    return history.latest_tracks(tracks(spark, d)).select("mmsi", "track_id", "updated_at")


@query("w3_ais_gaps", f"""WITH {P}, l AS (SELECT mmsi, ts, latitude, longitude, lag(ts) OVER w AS last_ts, lag(latitude) OVER w AS last_latitude, lag(longitude) OVER w AS last_longitude
    FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))
  SELECT mmsi, last_ts, ts AS next_ts, round((epoch_us(ts) - epoch_us(last_ts)) / 1e6 / 3600.0, 2) AS gap_hours, round({nm('last_latitude', 'last_longitude', 'latitude', 'longitude')}, 2) AS jump_nm
  FROM l WHERE (epoch_us(ts) - epoch_us(last_ts)) / 1e6 / 3600.0 > 6""")
def _(spark, d):
    return history.ais_gaps(positions(spark, d), 6).select("mmsi", "last_ts", "next_ts", "gap_hours", "jump_nm")


@query("w6_track_segments", f"""WITH {P}, l AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 86400 THEN 1 ELSE 0 END AS opens FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))
  SELECT event_id, mmsi, cast(sum(opens) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS BIGINT) AS segment FROM l""")
def _(spark, d):
    return history.segment_tracks(positions(spark, d), 86_400).select("event_id", "mmsi", "segment")


@query("k1_latest_messages", f"WITH {P} SELECT event_id, mmsi, ts FROM p ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, d):
    return history.latest_n(positions(spark, d), 50).select("event_id", "mmsi", "ts")


ALERTS_SQL = "e AS (SELECT 'TRK-' || mmsi AS track_id, ts AS event_timestamp, event_id FROM p WHERE is_dark_ship)"


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).where("is_dark_ship").select(F.concat(F.lit("TRK-"), "mmsi").alias("track_id"), F.col("ts").alias("event_timestamp"), "event_id")


@query("k4_latest_alerts", f"WITH {P}, {ALERTS_SQL} SELECT * FROM e ORDER BY event_timestamp DESC, track_id LIMIT 100")
def _(spark, d):
    return history.latest_alerts(alerts(spark, d))


@query("f9_dark_events_today", f"WITH {P}, {ALERTS_SQL} SELECT * FROM e WHERE event_timestamp >= TIMESTAMP '2024-01-17 00:00:00'")
def _(spark, d):
    return filters.dark_events_today(alerts(spark, d), NOW.replace(day=17, hour=15))


@query("s15_retained", f"WITH {P} SELECT event_id, ts FROM p ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    return sinks.retain_latest(positions(spark, d).select("event_id", "ts"), 1000, "ts", "event_id")


@query("k2_recent_anomalies", f"WITH {P} SELECT event_id, speed_knots FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 50000) WHERE speed_knots > 15 ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return history.recent_speed_anomalies(positions(spark, d), knots=15).select("event_id", "speed_knots")


@query("k3_track_ends", f"""WITH {P}, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY ts, event_id) AS a, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS b FROM p WHERE mmsi = '200000003')
  SELECT event_id, CASE WHEN b <= 5 THEN 'last' ELSE 'first' END AS "end" FROM r WHERE b <= 5 OR (a <= 5 AND n > 10)""")
def _(spark, d):
    return history.track_ends(positions(spark, d), "200000003").select("event_id", "end")


@query("j17_ais_gap_asof", f"""WITH {P}, g AS (SELECT event_id, ts, max(CASE WHEN sensor = 'ais' THEN ts END) OVER w AS seen, max(CASE WHEN sensor <> 'ais' THEN ts END) OVER w AS other
    FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, seen AS ais_last_seen, (epoch_us(ts) - epoch_us(seen)) / 1e6 AS ais_gap_seconds, coalesce((epoch_us(ts) - epoch_us(other)) / 1e6 < 21600, false) AS recent_non_ais FROM g""")
def _(spark, d):
    return history.ais_gap_asof(positions(spark, d), 21_600).select("event_id", "ais_last_seen", "ais_gap_seconds", "recent_non_ais")
