"""Registered queries of correlation, tracks, documents, retrieval and extras."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions import casts, geo
from vesselspark.functions.text_filters import extract_filters, extract_time_range
from vesselspark.operators import correlate, documents, extras, filters, proximity, sinks, vectors
from vesselspark.plans.adapter import positions, table, tracks
from vesselspark.plans.queries import NOW, P, REGION_SQL, T, ZONES, km, nm, query, values
from vesselspark.sources.unify import FIELDS, unify


def detections(spark: SparkSession, d: str) -> DataFrame:
    """The adapter's positions as detections: AIS ones name their vessel, the others have a number of their sensor's."""
    p = positions(spark, d)
    named = F.col("sensor") == "ais"
    columns = {
        "detection_id": F.lpad(F.col("event_id").cast("string"), 12, "0"), "sensor_id": F.upper("sensor"), "ts": F.col("ts").cast("timestamp"), "mmsi": F.when(named, F.col("mmsi")), "ship_name": F.when(named, F.col("ship_name")),
        "object_class": F.when(F.col("sensor") == "drone", F.lower("vessel_type")), "quality": F.lit(None).cast("int"), "local_track_id": F.when(~named, F.col("mmsi"))}
    return p.withColumns(columns).select(*(F.col(c).cast(kind).alias(c) for c, kind in FIELDS.items()))


def unified(spark: SparkSession, d: str) -> DataFrame:
    """The adapter's positions as the records of four feeds, united by ``unify``."""
    p = positions(spark, d).withColumn("detection_id", F.col("event_id").cast("string"))
    of = lambda sensor: p.where(F.col("sensor") == sensor).drop("sensor")
    ais = of("ais").select("ts", "latitude", "longitude", "mmsi", "ship_name", F.col("vessel_type").alias("ship_type"), "speed_knots", "course")
    radar = of("radar").select("ts", "latitude", "longitude", F.col("mmsi").alias("track_id"), F.lit("RAD-1").alias("station_id"), "speed_knots", "course", (F.col("event_id") % 101).cast("string").alias("quality"))
    satellite = of("satellite").select("ts", "latitude", "longitude", "detection_id", F.lit("").alias("satellite"), "vessel_length_m", "confidence", F.col("is_dark_ship").cast("string").alias("is_dark_ship"))
    drone = of("drone").select("ts", "latitude", "longitude", "detection_id", F.lower("vessel_type").alias("object_class"), F.col("mmsi").alias("tracking_id"), F.col("vessel_length_m").alias("estimated_length_m"), "confidence")
    return unify(ais, radar, satellite, drone)


def moving_tracks(spark: SparkSession, d: str) -> DataFrame:
    north, east = geo.velocity("speed_knots", "course")
    return tracks(spark, d).withColumns({"velocity_north_ms": north, "velocity_east_ms": east, "position_uncertainty_m": F.lit(100.0), "updated_at": F.col("updated_at").cast("timestamp")})


# Casts and columns

@query("d18_unified_detections", f"""WITH {P} SELECT CASE WHEN sensor IN ('satellite', 'drone') THEN event_id::STRING END AS detection_id, sensor, CASE sensor WHEN 'ais' THEN 'AIS' WHEN 'radar' THEN 'RAD-1' WHEN 'satellite' THEN 'SAT' ELSE 'DRONE' END AS sensor_id,
  ts, latitude, longitude, CASE WHEN sensor = 'ais' THEN mmsi END AS mmsi, CASE WHEN sensor = 'ais' THEN ship_name END AS ship_name, CASE WHEN sensor = 'ais' THEN vessel_type END AS vessel_type,
  CASE WHEN sensor IN ('ais', 'radar') THEN nullif(speed_knots, 0) END AS speed_knots, CASE WHEN sensor IN ('ais', 'radar') THEN nullif(course, 0) END AS course, CASE WHEN sensor IN ('satellite', 'drone') THEN nullif(confidence, 0) END AS confidence,
  CASE WHEN sensor IN ('satellite', 'drone') THEN vessel_length_m END AS vessel_length_m, CASE WHEN sensor = 'drone' THEN lower(vessel_type) END AS object_class, CASE WHEN sensor = 'satellite' THEN is_dark_ship END AS is_dark_ship,
  CASE WHEN sensor = 'radar' THEN cast(event_id % 101 AS INT) END AS quality, CASE WHEN sensor IN ('radar', 'drone') THEN mmsi END AS local_track_id FROM p""")
def _(spark, d):
    return unified(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("u1_union_counts", f"WITH {P} SELECT sensor, count(*) AS n, count(DISTINCT CASE WHEN sensor = 'ais' THEN mmsi END) AS named FROM p GROUP BY sensor")
def _(spark, d):
    return unified(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("named"))


@query("d24_vessel_class", f"""WITH {P} SELECT event_id, CASE vessel_type WHEN 'CARGO' THEN 'cargo_ship' WHEN 'TANKER' THEN 'tanker' WHEN 'CONTAINER' THEN 'container_ship' WHEN 'FISHING' THEN 'fishing_boat' ELSE 'vessel' END AS vessel_class FROM p""")
def _(spark, d):
    return positions(spark, d).select("event_id", casts.vessel_class(F.lower("vessel_type")).alias("vessel_class"))


@query("g5_dead_reckoned", f"""WITH {P} SELECT event_id, round(latitude + speed_knots * 907 / 3600.0 / 60.0 * cos(radians(course)), 9) AS latitude,
  round(longitude + speed_knots * 907 / 3600.0 / 60.0 * sin(radians(course)) / cos(radians(latitude)), 9) AS longitude, round(((cast(event_id % 360 AS DOUBLE) - course + 180) % 360 + 360) % 360 - 180, 6) AS turn FROM p""")
def _(spark, d):
    lat, lon = geo.dead_reckon("latitude", "longitude", "speed_knots", "course", 907)
    return positions(spark, d).select("event_id", F.round(lat, 9).alias("latitude"), F.round(lon, 9).alias("longitude"), F.round(geo.turn("course", (F.col("event_id") % 360).cast("double")), 6).alias("turn"))


@query("g7_match_scores", f"""WITH {P} SELECT event_id, round(coalesce(CASE WHEN speed_knots <> 0 AND b <> 0 THEN abs(speed_knots - b) / 15 END, 0) + coalesce(CASE WHEN course <> 0 AND c <> 0 THEN least(abs(course - c), 360 - abs(course - c)) / 120 END, 0), 7) AS kinematic,
  round(least(1.0, greatest(0.0, 1 - speed_knots / 10)), 7) AS confidence, round(least(10000.0, greatest(500.0, 4 * sqrt(power(vessel_length_m * 10, 2) + 2500))), 4) AS gate
  FROM (SELECT *, cast(event_id % 20 AS DOUBLE) AS b, cast(event_id % 360 AS DOUBLE) AS c FROM p)""")
def _(spark, d):
    i, p = F.col("event_id"), positions(spark, d)
    score = geo.kinematic_score("speed_knots", "course", (i % 20).cast("double"), (i % 360).cast("double"))
    return p.select("event_id", F.round(score, 7).alias("kinematic"), F.round(geo.match_confidence("speed_knots"), 7).alias("confidence"), F.round(geo.gate_size(F.col("vessel_length_m") * 10, 50), 4).alias("gate"))


@query("d22_dark_events_from_text", f"""WITH {P} SELECT 'TRK-' || mmsi AS track_id, date_trunc('second', ts) AS event_timestamp, latitude, longitude, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE confidence END::DOUBLE AS dark_ship_confidence,
  CASE WHEN event_id % 3 = 0 THEN 'gap ' || event_id END AS alert_reason, 'radar|' || sensor AS sensors FROM p WHERE is_dark_ship""")
def _(spark, d):
    i = F.col("event_id")
    text = positions(spark, d).where("is_dark_ship").select(
        F.concat(F.lit("TRK-"), "mmsi").alias("track_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude"),
        F.when(i % 5 == 0, "none").otherwise(F.col("confidence").cast("string")).alias("confidence"), F.when(i % 3 == 0, F.concat(F.lit("gap "), i.cast("string"))).otherwise(" ").alias("reason"), F.concat(F.lit(" radar,, "), "sensor").alias("contributing_sensors"))
    found = sinks.parse_dark_events(text)
    return found.select("track_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "latitude", "longitude", "dark_ship_confidence", "alert_reason", F.array_join("detecting_sensors", "|").alias("sensors"))


@query("d19_casts", "SELECT event_id, try_cast(props AS DOUBLE) AS as_float, nullif(value, 0) AS nonzero, event_type IN ('true', '1', 'yes') AS as_bool FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", casts.safe_float("props").alias("as_float"), casts.nonzero_float("value").alias("nonzero"), casts.to_bool("event_type").alias("as_bool"))


@query("g2_bearing_and_distance", f"""WITH {P} SELECT event_id, round({km('latitude', 'longitude', 18.9388, 72.8354)}, 4) AS km, round(((degrees(atan2(sin(radians(72.8354) - radians(longitude)) * cos(radians(18.9388)),
  cos(radians(latitude)) * sin(radians(18.9388)) - sin(radians(latitude)) * cos(radians(18.9388)) * cos(radians(72.8354) - radians(longitude)))) + 360) % 360 + 360) % 360, 4) AS bearing FROM p""")
def _(spark, d):
    p = positions(spark, d)
    return p.select("event_id", F.round(geo.haversine("latitude", "longitude", 18.9388, 72.8354), 4).alias("km"), F.round(geo.bearing("latitude", "longitude", 18.9388, 72.8354), 4).alias("bearing"))


@query("g3_predicted", f"""WITH {P} SELECT event_id, round(latitude + speed_knots * 0.5144 * cos(radians(course)) * 60 / 111000, 6) AS latitude,
  round(longitude + speed_knots * 0.5144 * sin(radians(course)) * 60 / (111000 * greatest(0.1, cos(radians(latitude)))), 6) AS longitude FROM p""")
def _(spark, d):
    p = positions(spark, d)
    lat, lon = geo.predict_position("latitude", "longitude", *geo.velocity("speed_knots", "course"), 60)
    return p.select("event_id", F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"))


# Correlation

@query("j10_identity", f"WITH {T} SELECT lpad(cast(p.event_id AS STRING), 12, '0') AS detection_id, track_id, 1.0::DOUBLE AS confidence FROM p JOIN t USING (mmsi) WHERE p.sensor = 'ais' AND track_status <> 'dropped'")
def _(spark, d):
    return correlate.correlate_identity(detections(spark, d), tracks(spark, d))


GATED_SQL = f"""WITH {T}, m AS (SELECT track_id, latitude AS a, longitude AS b, speed_knots AS s, course AS c, ts AS u, speed_knots * 0.5144 * cos(radians(course)) AS vn, speed_knots * 0.5144 * sin(radians(course)) AS ve FROM t WHERE track_status <> 'dropped'),
  x AS (SELECT lpad(cast(event_id AS STRING), 12, '0') AS detection_id, track_id, latitude, longitude, speed_knots, course, s, c, CASE sensor WHEN 'ais' THEN 10 WHEN 'radar' THEN 500 WHEN 'satellite' THEN 2000 ELSE 50 END AS e,
    a + vn * least((epoch_us(ts) - epoch_us(u)) / 1e6, 120) / 111000 AS pa, b + ve * least((epoch_us(ts) - epoch_us(u)) / 1e6, 120) / (111000 * greatest(0.1, cos(radians(a)))) AS pb
    FROM p JOIN m ON abs(epoch_us(ts) - epoch_us(u)) <= 120000000),
  y AS (SELECT *, {km('pa', 'pb', 'latitude', 'longitude', 6371000.0)} AS dist FROM x)
  SELECT detection_id, track_id, round(dist, 3) AS distance_m FROM y WHERE dist < least(10000.0, greatest(500.0, 4 * sqrt(10000.0 + e * e)))"""


@query("j11_gated_candidates", GATED_SQL)
def _(spark, d):
    return correlate.gated(detections(spark, d), moving_tracks(spark, d)).select("detection_id", "track_id", F.round("distance_m", 3).alias("distance_m"))


EVENTS_SQL = "e AS (SELECT 'TRK-' || mmsi AS track_id, ts AS event_timestamp, event_id, confidence FROM p WHERE is_dark_ship)"


def dark_events(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).where("is_dark_ship").select(F.concat(F.lit("TRK-"), "mmsi").alias("track_id"), F.col("ts").alias("event_timestamp"), "event_id", "confidence")


@query("j15_recent_dark_events", f"WITH {T}, {EVENTS_SQL} SELECT e.event_id, e.track_id, event_timestamp, mmsi FROM e JOIN t USING (track_id) WHERE event_timestamp >= TIMESTAMP '2024-01-26 00:00:00'")
def _(spark, d):
    return sinks.recent_dark_events(dark_events(spark, d), tracks(spark, d), NOW, 120).select("event_id", "track_id", "event_timestamp", "mmsi")


@query("j16_orphan_events", f"WITH {T}, {EVENTS_SQL} SELECT event_id, track_id FROM e WHERE track_id NOT IN (SELECT track_id FROM t WHERE track_status <> 'dropped')")
def _(spark, d):
    return sinks.orphan_events(dark_events(spark, d), filters.active_tracks(tracks(spark, d))).select("event_id", "track_id")


@query("s14_append_events", f"WITH {T}, {EVENTS_SQL} SELECT track_id, event_timestamp, min(event_id) AS event_id FROM e WHERE track_id IN (SELECT track_id FROM t WHERE track_status <> 'dropped') GROUP BY track_id, event_timestamp")
def _(spark, d):
    return sinks.append_dark_events(dark_events(spark, d).drop("confidence"), filters.active_tracks(tracks(spark, d))).select("track_id", "event_timestamp", "event_id")


@query("s13_upsert_tracks", f"""WITH {T}, c AS (SELECT track_id, 'old' AS identity_source, 1.0 AS latitude, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM t WHERE substr(track_id, 13, 1) IN ('0', '1', '2'))
  SELECT track_id, coalesce(c.identity_source, 'ais') AS identity_source, t.latitude::DOUBLE AS latitude, t.updated_at FROM t LEFT JOIN c USING (track_id)""")
def _(spark, d):
    now = tracks(spark, d).select("track_id", F.lit("ais").alias("identity_source"), "latitude", "updated_at")
    old = now.where(F.substring("track_id", 13, 1).isin("0", "1", "2")).select(
        "track_id", F.lit("old").alias("identity_source"), F.lit(1.0).alias("latitude"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    return sinks.upsert_tracks(now, old)


@query("d20_track_rows_as_text", f"WITH {T} SELECT track_id, latitude, vessel_type, is_dark_ship, track_status FROM t")
def _(spark, d):
    typed = tracks(spark, d).select("track_id", "latitude", "vessel_type", "is_dark_ship", "track_status")
    return sinks.parse_track_rows(sinks.format_track_rows(typed), NOW).select("track_id", "latitude", "vessel_type", "is_dark_ship", "track_status")


# Reports and questions

@query("r1_ship_reports", f"""WITH {P}, g AS (SELECT ship_name, min(mmsi) AS mmsi, min(vessel_type) AS vessel_type, arg_min((latitude, longitude, ts), (ts, event_id)) AS a, arg_max((latitude, longitude, ts), (ts, event_id)) AS b, avg(speed_knots) AS speed, count(*) AS n,
    min(event_id) FILTER (speed_knots > 25) AS odd FROM p GROUP BY ship_name)
  SELECT concat_ws(chr(10), 'Ship Report: ' || ship_name, 'MMSI: ' || mmsi, 'Type: ' || vessel_type, 'Route: Unknown to Unknown', printf('First Position: %.4fN, %.4fE at ', a[1], a[2]) || strftime(a[3], '%Y-%m-%d %H:%M:%S'),
    printf('Last Position: %.4fN, %.4fE at ', b[1], b[2]) || strftime(b[3], '%Y-%m-%d %H:%M:%S'), 'Average Speed: ' || printf('%.1f', round(speed, 1)) || ' knots', 'Total Positions Recorded: ' || n, 'Current Status: Unknown',
    CASE WHEN odd IS NOT NULL THEN chr(10) || 'ANOMALY DETECTED: SPEED' END) AS content, 'ship_report' AS document_type, mmsi FROM g""")
def _(spark, d):
    flagged = positions(spark, d).withColumns({"anomaly_flag": F.col("speed_knots") > 25, "anomaly_type": F.lit("SPEED")})
    return documents.ship_reports(flagged).select("content", "document_type", F.col("metadata")["mmsi"].alias("mmsi"))


@query("r2_port_reports", f"""WITH {P}, n AS (SELECT name, plat, plon, ship_name FROM p JOIN {values(config.PORTS, 'name, country, plat, plon')} ON abs(latitude - plat) < 1 AND abs(longitude - plon) < 1)
  SELECT concat_ws(chr(10), 'Port Activity Report: ' || name, printf('Location: %.4fN, %.4fE', plat, plon), 'Ships in vicinity: ' || count(DISTINCT ship_name), 'Ship names: ' || string_agg(DISTINCT ship_name, ', ' ORDER BY ship_name), 'Total position records: ' || count(*)) AS content,
    name AS port_name FROM n GROUP BY name, plat, plon""")
def _(spark, d):
    return documents.port_reports(positions(spark, d), config.ports(spark)).select("content", F.col("metadata")["port_name"].alias("port_name"))


@query("r3_anomaly_reports", f"""WITH {P} SELECT concat_ws(chr(10), 'ANOMALY ALERT', 'Ship: ' || ship_name, 'MMSI: ' || mmsi, 'Type: Unknown', printf('Location: %.4fN, %.4fE', latitude, longitude), 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Speed: ' || speed_knots || ' knots',
  'This vessel has exhibited suspicious behavior requiring investigation.') AS content, ship_name FROM p WHERE speed_knots > 25""")
def _(spark, d):
    flagged = positions(spark, d).withColumn("anomaly_flag", F.col("speed_knots") > 25)
    return documents.anomaly_reports(flagged).select("content", F.col("metadata")["ship_name"].alias("ship_name"))


@query("r2_port_activity", f"""WITH {P}, n AS (SELECT name AS port_name, ship_name FROM p JOIN {values(config.PORTS, 'name, country, plat, plon')} ON abs(latitude - plat) < 1 AND abs(longitude - plon) < 1)
  SELECT port_name, count(DISTINCT ship_name) AS ships, string_agg(DISTINCT ship_name, ', ' ORDER BY ship_name) AS names, count(*) AS n FROM n GROUP BY port_name""")
def _(spark, d):
    return documents.port_activity(positions(spark, d), config.ports(spark)).select("port_name", "ships", "names", "n")


@query("r4_documents_by_type", f"""WITH {P} SELECT 'ship_report' AS document_type, count(DISTINCT ship_name) AS n FROM p UNION ALL SELECT 'anomaly_alert', count(*) FROM p WHERE speed_knots > 25
  UNION ALL SELECT 'port_report', count(DISTINCT name) FROM p JOIN {values(config.PORTS, 'name, country, plat, plon')} ON abs(latitude - plat) < 1 AND abs(longitude - plon) < 1""")
def _(spark, d):
    flagged = positions(spark, d).withColumn("anomaly_flag", F.col("speed_knots") > 25)
    return documents.build_documents(flagged, config.ports(spark)).groupBy("document_type").agg(F.count("*").alias("n"))


def _case(words, shown) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{shown(w)}'" for w in words) + " END"


@query("v9_question_filters", f"""WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), k AS (SELECT *, try_cast(nullif(regexp_extract(t, '(\\d+)\\s*knots?', 1), '') AS INT) AS n,
    contains(t, 'faster') OR contains(t, 'greater') OR contains(t, '>') AS over, contains(t, 'slower') OR contains(t, 'less') OR contains(t, '<') AS under FROM q)
  SELECT conv_id, turn, {_case(['tanker', 'cargo', 'container', 'passenger', 'fishing', 'bulk'], str.upper)} AS vessel_type, CASE WHEN over THEN n END AS speed_gt, CASE WHEN under AND NOT over THEN n END AS speed_lt,
    {_case(['mumbai', 'chennai', 'kochi', 'singapore', 'dubai', 'colombo', 'kandla'], str.capitalize)} AS port FROM k""")
def _(spark, d):
    asked = table(spark, d, "conversations").withColumn("f", extract_filters("text"))
    return asked.select("conv_id", "turn", "f.vessel_type", "f.speed_gt", "f.speed_lt", "f.port")


@query("v10_question_times", """SELECT conv_id, turn, CASE WHEN contains(t, 'last hour') OR contains(t, 'past hour') THEN '1 hour' WHEN contains(t, 'last 2 hour') THEN '2 hours' WHEN contains(t, 'today') THEN 'today'
  WHEN contains(t, 'yesterday') THEN 'yesterday' WHEN contains(t, '24 hour') OR contains(t, 'last day') THEN '24 hours' WHEN contains(t, 'this week') OR contains(t, 'last week') THEN '7 days' END AS time_range
  FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", extract_time_range("text").alias("time_range"))


# Vectors

def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("string").alias("document_type"))


def one_query(spark: SparkSession, d: str, k: int) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == k).first().embedding]


def similarity_sql(k: int) -> str:
    return f"s AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {k}) q)"


@query("v2_document_search", f"WITH {similarity_sql(0)} SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE label = 3 AND similarity >= 0 ORDER BY similarity DESC, vec_id::STRING LIMIT 10")
def _(spark, d):
    found = vectors.search_documents(vector_rows(spark, d), one_query(spark, d, 0), "3", 0.0)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v4_anomaly_search", f"WITH {similarity_sql(1)} SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id::STRING LIMIT 5")
def _(spark, d):
    found = vectors.search_anomalies(vector_rows(spark, d).withColumn("source_type", F.col("document_type")), one_query(spark, d, 1), None, 0.1, 5)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v8_batch_search", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS similarity FROM v, v q WHERE q.vec_id % 20 = 0)
  SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s) WHERE rn <= 5""")
def _(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_search(table(spark, d, "embeddings"), asked, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("v6_rank_fusion", f"""WITH {T}, a AS (SELECT mmsi, row_number() OVER (ORDER BY speed_knots DESC, mmsi) - 1 AS r FROM t ORDER BY speed_knots DESC, mmsi LIMIT 30), b AS (SELECT mmsi, row_number() OVER (ORDER BY vessel_length_m DESC, mmsi) - 1 AS r FROM t ORDER BY vessel_length_m DESC, mmsi LIMIT 30)
  SELECT 'TRK-' || mmsi AS item_id, round(sum(w), 9) AS fusion_score FROM (SELECT mmsi, 1.0 / (60 + r) AS w FROM a UNION ALL SELECT mmsi, 0.8 / (60 + r) FROM b) GROUP BY mmsi""")
def _(spark, d):
    top = lambda c: tracks(spark, d).orderBy(F.desc(c), "mmsi").limit(30).select("track_id", F.struct(-F.col(c), "mmsi").alias("position"))
    return vectors.rrf_fuse({"structured": top("speed_knots"), "semantic": top("vessel_length_m")}).select("item_id", F.round("fusion_score", 9).alias("fusion_score"))


@query("v7_hybrid_search", f"""WITH {T}, {similarity_sql(0)}, a AS (SELECT track_id AS item_id, row_number() OVER (ORDER BY mmsi) - 1 AS r FROM t WHERE vessel_type = 'TANKER' ORDER BY mmsi LIMIT 50),
  b AS (SELECT vec_id::STRING AS item_id, row_number() OVER (ORDER BY similarity DESC, vec_id::STRING) - 1 AS r FROM s WHERE similarity >= 0.1 ORDER BY r LIMIT 10),
  c AS (SELECT track_id AS item_id, row_number() OVER (ORDER BY mmsi) - 1 AS r FROM (SELECT * FROM t ORDER BY mmsi LIMIT 50) WHERE vessel_type = 'TANKER')
  SELECT item_id, round(sum(w), 9) AS fusion_score FROM (SELECT item_id, 1.0 / (60 + r) AS w FROM a UNION ALL SELECT item_id, 0.8 / (60 + r) FROM b UNION ALL SELECT item_id, 1.2 / (60 + r) FROM c) GROUP BY item_id""")
def _(spark, d):
    t = tracks(spark, d)
    structured = filters.tracks_where(t, "TANKER").select("track_id", F.col("mmsi").alias("position")).orderBy("position").limit(50)
    semantic = vectors.search_documents(vector_rows(spark, d), one_query(spark, d, 0), None, 0.1, 10).select("id", F.struct(-F.col("similarity"), "id").alias("position"))
    live = t.select("track_id", "vessel_type", "speed_knots", F.col("mmsi").alias("position"))
    return vectors.hybrid_search(structured, semantic, live, {"vessel_type": "tanker"}).select("item_id", F.round("fusion_score", 9).alias("fusion_score"))


def counting_embedder(texts: list[str]) -> np.ndarray:
    """Vectors that SQL can make too: characters, blanks and letters e."""
    return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], dtype=np.float32).reshape(len(texts), 3)


@query("v1_embedded_texts", "SELECT conv_id, turn, length(coalesce(text, ''))::DOUBLE AS e0, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS e1, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS e2 FROM conversations")
def _(spark, d):
    found = vectors.embed(table(spark, d, "conversations"), counting_embedder, "text", 3)
    return found.select("conv_id", "turn", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(3)))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as windows of a day that begin ever earlier."""
    start = F.timestamp_add("HOUR", -F.col("vec_id"), F.lit(NOW).cast("timestamp_ntz"))
    return vector_rows(spark, d).withColumns({"window_start": start, "window_end": F.timestamp_add("HOUR", F.lit(24), start), "content": F.col("document_type"), "source_type": F.col("document_type")})


@query("v3_history_search", f"""WITH {similarity_sql(3)} SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.05 AND TIMESTAMP '2024-01-31 00:00:00' - to_hours(vec_id) >= TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00' - to_hours(vec_id) + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-30 00:00:00'
  ORDER BY similarity DESC, vec_id::STRING LIMIT 20""")
def _(spark, d):
    found = vectors.search_track_history(windows(spark, d), one_query(spark, d, 3), NOW.replace(day=21), NOW.replace(day=30), 0.05, 20)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v5_search_all", f"""WITH {similarity_sql(4)}, n AS (SELECT vec_id::STRING AS id, label::STRING AS content, similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 4),
  u AS (SELECT 'documents' AS source, * FROM n UNION ALL SELECT 'track_history', * FROM n UNION ALL SELECT 'anomalies', * FROM n)
  SELECT source, id, content, round(similarity, 6) AS similarity FROM u ORDER BY similarity DESC, source, id LIMIT 12""")
def _(spark, d):
    rows = windows(spark, d)
    found = vectors.search_all(rows, rows, rows, one_query(spark, d, 4), 12, 0.1)
    return found.select("source", "id", "content", F.round("similarity", 6).alias("similarity"))


# Extras

@query("x1_recency_rank", f"""WITH {similarity_sql(2)}, n AS (SELECT * FROM s ORDER BY similarity DESC, vec_id::STRING LIMIT 30) SELECT vec_id, round(similarity * power(0.5, vec_id / 24.0), 6) AS score FROM n
  ORDER BY similarity * power(0.5, vec_id / 24.0) DESC, vec_id::STRING LIMIT 10""")
def _(spark, d):
    dated = vector_rows(spark, d).withColumn("ts", F.timestamp_add("HOUR", -F.col("vec_id"), F.lit(NOW).cast("timestamp_ntz")))
    return extras.recency_rank(dated, one_query(spark, d, 2), NOW).select("vec_id", F.round("score", 6).alias("score"))


@query("x2_encounters", f"""WITH {P} SELECT a.mmsi, b.mmsi AS other, count(*) AS meetings, min(least(a.ts, b.ts)) AS first_ts, round(min({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}), 4) AS least_km
  FROM p a JOIN p b ON a.mmsi < b.mmsi AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 50 GROUP BY a.mmsi, b.mmsi""")
def _(spark, d):
    return extras.encounters(positions(spark, d), 50).withColumn("least_km", F.round("least_km", 4))


@query("x3_shared_ports", f"""WITH {P}, v AS (SELECT DISTINCT mmsi, name FROM p JOIN {values(config.PORTS, 'name, country, plat, plon')} ON {nm('latitude', 'longitude', 'plat', 'plon')} < 300)
  SELECT mmsi, count(*) AS ports FROM v WHERE mmsi <> '200000003' AND name IN (SELECT name FROM v WHERE mmsi = '200000003') GROUP BY mmsi""")
def _(spark, d):
    return extras.ships_sharing_ports(positions(spark, d), config.ports(spark), "200000003", 300)


@query("x4_uncorrelated", f"""WITH {P} SELECT s.event_id AS detection_id FROM p s WHERE s.sensor = 'satellite' AND NOT EXISTS (SELECT 1 FROM p a WHERE a.sensor = 'ais' AND abs(epoch_us(a.ts) - epoch_us(s.ts)) <= 21600000000
  AND {km('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')} <= 50)""")
def _(spark, d):
    p = positions(spark, d)
    seen = p.where("sensor = 'satellite'").withColumn("detection_id", F.col("event_id"))
    return extras.uncorrelated_detections(seen, p.where("sensor = 'ais'"), 50, 21_600).select("detection_id")


@query("x5_weather", f"""WITH {P}, st AS (SELECT * FROM {values(config.RADAR_STATIONS, 'station_id, name, slat, slon, r')}),
  n AS (SELECT event_id, ts, station_id FROM (SELECT event_id, ts, station_id, row_number() OVER (PARTITION BY event_id ORDER BY {km('latitude', 'longitude', 'slat', 'slon')}, station_id) AS rn FROM p CROSS JOIN st WHERE sensor = 'ais') WHERE rn = 1),
  w AS (SELECT station_id, ts AS observed_at, max(speed_knots) AS wind FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS k FROM p WHERE sensor = 'drone') CROSS JOIN st WHERE event_id % 7 = cast(right(cast(ascii(station_id[5]) AS STRING), 1) AS INT) % 7 GROUP BY station_id, ts)
  SELECT n.event_id, n.station_id, max(w.observed_at) AS observed_at, round(arg_max(w.wind, w.observed_at), 6) AS wind_speed_knots FROM n LEFT JOIN w ON n.station_id = w.station_id AND w.observed_at <= n.ts GROUP BY n.event_id, n.station_id""")
def _(spark, d):
    p = positions(spark, d)
    stations = config.radar_stations(spark)
    digit = (F.ascii(F.substring("station_id", 5, 1)) % 10) % 7
    weather = p.where("sensor = 'drone'").join(F.broadcast(stations.select("station_id")), F.col("event_id") % 7 == digit)  # seven rows
    weather = weather.select("station_id", "ts", F.col("speed_knots").alias("wind_speed_knots"), F.lit(25.0).alias("temperature_c"))
    return extras.weather_at_ships(p.where("sensor = 'ais'"), stations, weather).select("event_id", "station_id", "observed_at", F.round("wind_speed_knots", 6).alias("wind_speed_knots"))


@query("x6_window_summary", f"""WITH {P}, l AS (SELECT *, epoch_us(ts) // 86400000000 AS bin, lag(epoch_us(ts) // 86400000000) OVER w AS pb, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))
  SELECT mmsi, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(bin * 86400) AS window_start, round(avg(speed_knots), 8) AS avg_speed, max(speed_knots) AS max_speed,
    round(coalesce(sum(CASE WHEN pb = bin THEN {nm('a', 'b', 'latitude', 'longitude')} END), 0.0), 3) AS distance_nm, count(*) FILTER (is_dark_ship) AS dark_events, count(*) AS n FROM l GROUP BY mmsi, bin""")
def _(spark, d):
    found = extras.window_summary(positions(spark, d))
    return found.select("mmsi", "window_start", F.round("avg_speed", 8).alias("avg_speed"), "max_speed", F.round("distance_nm", 3).alias("distance_nm"), "dark_events", "n")


@query("x7_alert_table", f"""WITH {P}, l AS (SELECT *, lag(ts) OVER w AS b, lag(latitude) OVER w AS blat, lag(longitude) OVER w AS blon FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))
  SELECT 'speed_anomaly' AS alert_type, 'medium' AS severity, mmsi, ts, latitude, longitude, speed_knots::DOUBLE AS speed_knots, NULL::DOUBLE AS gap_hours, NULL::STRING AS zone, NULL::DOUBLE AS distance_nm FROM p WHERE speed_knots > 25
  UNION ALL SELECT 'ais_gap', 'high', mmsi, ts, latitude, longitude, NULL, round((epoch_us(ts) - epoch_us(b)) / 1e6 / 3600.0, 2), NULL, NULL FROM l WHERE (epoch_us(ts) - epoch_us(b)) / 1e6 / 3600.0 > 24
  UNION ALL SELECT 'zone_violation', 'high', mmsi, ts, latitude, longitude, NULL, NULL, zone, round({nm('latitude', 'longitude', 'zlat', 'zlon')}, 2) FROM p CROSS JOIN {values(ZONES, 'zone, zlat, zlon, r')} WHERE {nm('latitude', 'longitude', 'zlat', 'zlon')} < r
  UNION ALL SELECT 'dark_ship', 'critical', mmsi, ts, latitude, longitude, NULL, NULL, NULL, NULL FROM p WHERE is_dark_ship""")
def _(spark, d):
    p = positions(spark, d)
    zones = proximity.zone_violations(p, spark.createDataFrame(ZONES, "zone string, latitude double, longitude double, radius_nm double"))
    dark = p.where("is_dark_ship").select("mmsi", F.col("ts").alias("event_timestamp"), "latitude", "longitude", F.lit("seen").alias("alert_reason"))
    found, of = extras.alert_table(p, zones, dark, 25, 24), F.col("evidence")
    return found.select("alert_type", "severity", "mmsi", "ts", "latitude", "longitude", *(of[c].try_cast("double").alias(c) for c in ("speed_knots", "gap_hours")), of["zone"].alias("zone"), of["distance_nm"].try_cast("double").alias("distance_nm"))


@query("x8_vessel_history", f"WITH {P} SELECT event_id, ts FROM p WHERE mmsi = '200000005' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def _(spark, d):
    return filters.vessel_history(positions(spark, d), "200000005", NOW.replace(day=10), NOW.replace(day=20)).select("event_id", "ts")


@query("a13_result_breakdown", f"WITH {P} SELECT region AS source, count(*) AS n FROM p JOIN {REGION_SQL} ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max GROUP BY region")
def _(spark, d):
    return proximity.assign_regions(positions(spark, d), config.regions(spark)).groupBy(F.col("region").alias("source")).agg(F.count("*").alias("n"))
