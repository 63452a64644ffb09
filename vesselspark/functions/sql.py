"""Table functions for SQL over views of tracks, ports, documents and track history."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vesselspark.functions.geo import register_sql_functions

SHIPS = "track_id STRING, mmsi STRING, ship_name STRING, vessel_type STRING, latitude DOUBLE, longitude DOUBLE, speed_knots DOUBLE, distance_km DOUBLE"
#: The cosine of an embedding with the one asked for; null for a vector of zeros, whose distance is not defined.
DOT = "aggregate(zip_with(cast({a} as array<double>), cast({b} as array<double>), (x, y) -> x * y), cast(0.0 as double), (s, x) -> s + x)"


def _cosine(a: str, b: str) -> str:
    norm = f"sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})"
    return f"({DOT.format(a=a, b=b)}) / nullif({norm}, 0.0)"


def register_table_functions(spark: SparkSession, tracks: str = "unified_tracks", ports: str = "ports", documents: str | None = None, history: str | None = None) -> None:
    """``find_ships_near_point(lat, lon, km[, n])``, ``find_ships_near_port(port[, km[, n]])``, and, if their views are named,
    ``search_documents_by_similarity`` and ``search_track_history_by_similarity``, as temporary functions that return
    tables, nearest first; rows that tie are in the order of their ids. A port that isn't there is an error."""
    register_sql_functions(spark)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION find_ships_near_point(center_lat DOUBLE, center_lon DOUBLE, radius_km DOUBLE, max_results INT DEFAULT 100)
        RETURNS TABLE ({SHIPS})
        RETURN SELECT track_id, mmsi, ship_name, vessel_type, latitude, longitude, speed_knots, distance_km FROM (
          SELECT *, row_number() OVER (ORDER BY distance_km, track_id) AS place FROM (
            SELECT t.track_id, t.mmsi, t.ship_name, t.vessel_type, t.latitude, t.longitude, t.speed_knots,
              haversine_distance(center_lat, center_lon, t.latitude, t.longitude) AS distance_km
            FROM {tracks} t WHERE t.track_status <> 'dropped' AND abs(t.latitude - center_lat) <= radius_km / 111.0)
          WHERE distance_km <= radius_km) WHERE place <= max_results ORDER BY distance_km, track_id""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION find_ships_near_port(port_name STRING, radius_km DOUBLE DEFAULT 50.0, max_results INT DEFAULT 100)
        RETURNS TABLE ({SHIPS}, port STRING)
        RETURN WITH p AS (SELECT coalesce(max(struct(latitude, longitude)), raise_error(concat('Port not found: ', port_name))) AS at FROM {ports} WHERE lower(name) = lower(port_name)),
          near AS (SELECT t.track_id, t.mmsi, t.ship_name, t.vessel_type, t.latitude, t.longitude, t.speed_knots, haversine_distance(p.at.latitude, p.at.longitude, t.latitude, t.longitude) AS distance_km
            FROM {tracks} t JOIN p ON abs(t.latitude - p.at.latitude) <= radius_km / 111.0 WHERE t.track_status <> 'dropped')
        SELECT track_id, mmsi, ship_name, vessel_type, latitude, longitude, speed_knots, distance_km, port_name AS port
        FROM (SELECT *, row_number() OVER (ORDER BY distance_km, track_id) AS place FROM near WHERE distance_km <= radius_km) WHERE place <= max_results ORDER BY distance_km, track_id""")
    if documents:
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION search_documents_by_similarity(query ARRAY<DOUBLE>, match_count INT DEFAULT 5, doc_type STRING DEFAULT NULL, threshold DOUBLE DEFAULT 0.5)
            RETURNS TABLE (id STRING, content STRING, document_type STRING, similarity DOUBLE)
            RETURN SELECT id, content, document_type, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
              SELECT cast(d.id AS STRING) AS id, d.content, d.document_type, {_cosine('d.embedding', 'query')} AS similarity FROM {documents} d WHERE doc_type IS NULL OR d.document_type = doc_type)
              WHERE similarity >= threshold) WHERE place <= match_count ORDER BY similarity DESC, id""")
    if history:
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION search_track_history_by_similarity(query ARRAY<DOUBLE>, match_count INT DEFAULT 5, time_start TIMESTAMP DEFAULT NULL, time_end TIMESTAMP DEFAULT NULL)
            RETURNS TABLE (id STRING, track_id STRING, description STRING, window_start TIMESTAMP, window_end TIMESTAMP, similarity DOUBLE)
            RETURN SELECT id, track_id, description, window_start, window_end, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC NULLS LAST, id) AS place FROM (
              SELECT cast(h.id AS STRING) AS id, h.track_id, h.description, h.window_start, h.window_end, {_cosine('h.embedding', 'query')} AS similarity FROM {history} h
              WHERE (time_start IS NULL OR h.window_start >= time_start) AND (time_end IS NULL OR h.window_end <= time_end))) WHERE place <= match_count ORDER BY similarity DESC NULLS LAST, id""")
