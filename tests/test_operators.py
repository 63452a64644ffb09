from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions import casts, geo
from vesselspark.functions.text_filters import extract_filters, extract_time_range
from vesselspark.operators import documents, extras, filters, history, proximity, sinks, vectors

NOW = datetime(2025, 1, 2, 12)


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_geo(spark):
    a, b = (18.9388, 72.8354), (13.0827, 80.2707)
    got = value(spark, geo.haversine(*a, *b), geo.haversine(*a, *b, "nm"), geo.bearing(*a, *b), geo.gate_size(100, 500), geo.gate_size(100, 2000), geo.gate_size(10, 10), geo.gate_size(5000, 5000))
    assert got == pytest.approx((1027.0398058, 554.5571637, 128.2511743, 2039.6078, 8009.9938, 500, 10000), rel=1e-7)
    north, east = geo.velocity(12, 45)
    near, far = geo.predict_position(15, 72, north, east, 60), geo.predict_position(15, 72, north, east, 600)
    assert value(spark, *near) == pytest.approx((15.0023594, 72.0024426), abs=1e-7)
    assert value(spark, *far) == pytest.approx(value(spark, *geo.predict_position(15, 72, north, east, 120)))
    assert value(spark, geo.kinematic_score(10, 350, 25, 20), geo.kinematic_score(0, 350, 25, 20), geo.kinematic_score(F.lit(None), 0, 25, 20)) == pytest.approx((1.25, 0.25, 0))
    assert value(spark, geo.turn(350, 10), geo.turn(10, 350), geo.match_confidence(2), geo.match_confidence(20)) == (20, -20, 0.8, 0)
    assert value(spark, geo.radar_probability(30, 60, 1), geo.radar_probability(61, 60, 1), geo.radar_quality(F.lit(0.379)), geo.satellite_probability(F.lit("SAR"), 0.5), geo.satellite_probability(F.lit("optical"), 0.5)) == pytest.approx((0.6375, 0, 37, 0.95, 0.425))
    assert value(spark, *geo.pixel_to_geo(10, 70, 1000, 0, 90, 960, 540)) == pytest.approx((10, 70)) and value(spark, geo.pixel_size(192, 1000, 90)) == pytest.approx(200)
    assert value(spark, *geo.dead_reckon(0, 70, 60, 0, 3600)) == pytest.approx((1, 70))
    geo.register_sql_functions(spark)
    assert spark.sql("SELECT haversine_distance(18.9388, 72.8354, 13.0827, 80.2707)").first()[0] == pytest.approx(1027.0398058)


def test_casts(spark):
    got = value(spark, casts.safe_float(F.lit("x"), 1.5), casts.nonzero_float(F.lit("0.0")), casts.safe_int(F.lit("7.9")), casts.to_bool(F.lit("True")), casts.to_bool(F.lit("no")), casts.split_list(F.lit(" a, ,b")), casts.vessel_class(F.lit("cargo")), casts.vessel_class(F.lit("x")))
    assert got == (1.5, None, 7, True, False, ["a", "b"], "cargo_ship", "vessel")
    assert value(spark, casts.iso_ts(F.lit("2025-01-01T10:00:00Z")), casts.iso_ts(F.lit("junk")))[1] is None


def test_questions(spark):
    rows = [("Show me TANKERS faster than 20 knots near Mumbai in the last hour", ("TANKER", 20, None, None, "Mumbai", None), "1 hour"),
            ("dark ships slower than 5 knot today", (None, None, 5, None, None, True), "today"), ("cargo at 12 knots, last 2 hours", ("CARGO", None, None, 12, None, None), "2 hours"), ("hello", (None,) * 6, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(extract_filters("t").alias("f"), extract_time_range("t").alias("w"))
    assert [(tuple(r.f), r.w) for r in df.collect()] == [r[1:] for r in rows]


def test_filter_edges(spark):
    rows = [("A", "BULK_CARRIER", 10.0, 315.0, "confirmed", True, NOW), ("B", None, None, 46.0, "dropped", False, NOW - timedelta(days=1)), ("C", "TANKER", 35.0, 45.0, "tentative", None, NOW - timedelta(hours=2))]
    df = spark.createDataFrame(rows, "track_id string, vessel_type string, speed_knots double, course double, track_status string, is_dark_ship boolean, updated_at timestamp").withColumns({"latitude": F.lit(9.9), "longitude": F.lit(76.3)})
    ids = lambda d: sorted(r.track_id for r in d.collect())
    assert ids(filters.match_filters(df, {"vessel_type": "bulk"})) == ["A", "B"] and ids(filters.match_filters(df, {"speed_gt": 10})) == ["C"] and ids(filters.match_filters(df, {"speed_lt": 10})) == ["B"]
    assert ids(filters.match_filters(df, {"is_dark_ship": False, "limit": 3})) == ["B", "C"] and ids(filters.match_filters(df, {"port": "Nowhere"})) == ["A", "B", "C"] and ids(filters.match_filters(df, {"port": "mumbai"})) == []
    assert ids(filters.heading_sector(df, "north")) == ["A", "C"] and ids(filters.speed_anomalies(df)) == [] and ids(filters.active_tracks(df, confirmed=True)) == ["A"]
    assert ids(filters.time_filter(df, "yesterday", NOW)) == ["B"] and ids(filters.time_filter(df, "2 hours", NOW)) == ["A", "C"] and ids(filters.time_filter(df, "junk", NOW)) == ["A", "B", "C"]
    assert ids(filters.track_by_id(df, "B")) == ["B"] and ids(filters.recently_updated(df, NOW)) == ["A"]
    with pytest.raises(ValueError):
        proximity.ships_near_port(df, config.ports(spark), "Atlantis")


def test_grid_loses_nothing(spark):
    rng = np.random.default_rng(1)
    lat = np.r_[rng.uniform(-90, 90, 300), rng.uniform(85, 90, 200), rng.uniform(-1, 1, 200)]
    lon = np.r_[rng.uniform(-180, 180, 300), rng.uniform(-180, 180, 200), rng.choice([-179.9, 179.9], 200) + rng.uniform(-0.1, 0.1, 200)]
    df = spark.createDataFrame([(k, float(a), float((b + 180) % 360 - 180)) for k, (a, b) in enumerate(zip(lat, lon))], "i int, latitude double, longitude double").cache()
    other = df.select(F.col("i").alias("j"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    close = geo.haversine("latitude", "longitude", "lat", "lon") <= 50
    left = proximity.on_grid(df, "latitude", "longitude", 50)
    right = proximity.around_grid(other, "lat", "lon", 50)
    got = left.join(right, ["cell_row", "cell_column"]).where(close).select("i", "j").collect()
    want = df.join(other, close).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 1000


def test_many_places_meet_on_grids(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-89, 89, 400), rng.uniform(-180, 180, 400)))], "event_id int, latitude double, longitude double").cache()
    places = [(f"Z{k}", float(a), float(b), float(r)) for k, (a, b, r) in enumerate(zip(rng.uniform(-89, 89, 60), rng.uniform(-180, 180, 60), rng.choice([1.0, 30.0, 300.0, 3000.0, 9000.0, 20_000.0], 60)))]
    zones = spark.createDataFrame(places, "zone string, latitude double, longitude double, radius_nm double")
    found = lambda: sorted((r.event_id, r.zone, r.distance_nm) for r in proximity.zone_violations(df, zones).collect())
    few = found()
    monkeypatch.setattr(proximity, "NESTED_ROWS", 5)
    plan = proximity.zone_violations(df, zones)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found() == few and len(few) > 2000


def test_batch_search_against_all(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)] + [(900, None), (None, [1.0] * 8)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for block in (8192, 37):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in vectors.batch_search(df, asked, 4, block=block).collect()}
        assert len(got) == 4 * 43
        for q in range(0, 300, 7):
            order = np.lexsort((np.arange(300), -(unit @ unit[q])))[:4]
            assert [got[q, k + 1][0] for k in range(4)] == order.tolist() and got[q, 1][1] == pytest.approx(1)
    assert vectors.batch_search(df.limit(0), asked, 4).collect() == [] and vectors.batch_search(df, asked.limit(0), 4).collect() == []


def test_histories_in_parts(spark, monkeypatch):
    """Parts of any length give what windows over whole vessels give."""
    from pyspark.sql import Window

    from vesselspark.operators import history

    rng = np.random.default_rng(6)
    rows = [(k, [None, "a", "b"][int(rng.integers(3))], NOW + timedelta(seconds=int(rng.integers(0, 5000))), ["ais", "radar"][int(rng.integers(2))], float(k), 1.0) for k in range(400)]
    rows += [(400 + k, [None, "a", "b"][k % 3], None, ["ais", "radar"][k % 2], 0.0, 0.0) for k in range(7)]
    df = spark.createDataFrame(rows, "event_id long, mmsi string, ts timestamp_ntz, sensor string, latitude double, longitude double").cache()
    order = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    opens = F.coalesce((history.seconds_between(before, F.col("ts")) > 60).cast("int"), F.lit(0))
    whole = df.withColumn("opens", opens).withColumn("segment", F.sum("opens").over(order))
    seen = F.last(F.when(F.col("sensor") == "ais", F.col("ts")), ignorenulls=True).over(order)
    wanted = {r.event_id: (r.segment, r.before, r.seen) for r in whole.withColumns({"before": before, "seen": seen}).collect()}
    most = df.groupBy("mmsi").count().agg(F.max("count")).first()[0]
    for part, split in ((50, 0), (700, most - 1), (30 * 86_400, 0), (50, most)):
        monkeypatch.setattr(history, "PART_S", part)
        segments = {r.event_id: r.segment for r in history.segment_tracks(df, 60, split=split).collect()}
        previous = {r.event_id: r.previous and r.previous.ts for r in history.with_previous(df, "mmsi", "ts", split=split).collect()}
        asof = {r.event_id: r.ais_last_seen for r in history.ais_gap_asof(df, split=split).collect()}
        assert {k: (segments[k], previous[k], asof[k]) for k in segments} == wanted and len(segments) == 407


def test_vectors(spark):
    texts = [("d1", "cargo ship near mumbai", "ship_report"), ("d2", "port activity mumbai", "port_report"), ("d3", None, "ship_report")]
    docs = vectors.embed(spark.createDataFrame(texts, "id string, content string, document_type string"), vectors.hashing_embedder()).cache()
    query = vectors.hashing_embedder()(["cargo ship near mumbai"])[0].tolist()
    best = vectors.search_documents(docs, query, threshold=0.0).collect()
    assert best[0].id == "d1" and best[0].similarity == pytest.approx(1) and "d3" not in [r.id for r in best]
    assert [r.id for r in vectors.search_documents(docs, query, "port_report", 0.0).collect()] == ["d2"] and vectors.search_documents(docs, query, k=0).count() == 0

    def broken(_):
        raise RuntimeError("model down")

    assert set(vectors.embed(docs.drop("embedding"), broken, dim=4).first().embedding) == {0.0}
    windows = docs.withColumns({"window_start": F.lit(NOW), "window_end": F.lit(NOW + timedelta(hours=1)), "source_type": F.lit("gap")})
    assert vectors.search_track_history(windows, query, end=NOW, threshold=0.0).count() == 0 and vectors.search_track_history(windows, query, start=NOW, threshold=0.0).count() == 2
    assert vectors.search_anomalies(windows, query, "speed", 0.0).count() == 0
    assert [r.similarity for r in vectors.search_all(docs, windows, windows, query, 3, 0.0).collect()] == pytest.approx([1, 1, 1])
    asked = docs.where("id = 'd1'").select(F.lit(7).cast("long").alias("query_id"), "embedding")
    numbered = docs.withColumn("vec_id", F.substring("id", 2, 1).cast("long"))
    assert [(r.vec_id, r["rank"]) for r in vectors.batch_search(numbered, asked, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_fusion(spark):
    make = lambda *ids: spark.createDataFrame([(k, i, f"{i}{k}") for k, i in enumerate(ids)], "position int, track_id string, note string")
    rows = vectors.rrf_fuse({"structured": make("a", "b", "a"), "semantic": make("c", "a")}).collect()
    assert [r.item_id for r in rows] == ["a", "b", "c"]
    assert rows[0].fusion_score == pytest.approx(1 / 60 + 1 / 62 + 0.8 / 61) and '"a2"' in rows[0].payload and '"c0"' in rows[2].payload
    live = make("b", "z").withColumns({"vessel_type": F.lit("TANKER"), "speed_knots": F.lit(5.0)})
    assert {r.item_id for r in vectors.hybrid_search(make("a"), make("c"), live, {"speed_gt": 9}).collect()} == {"a", "c"}


def test_reports(spark):
    start = datetime(2025, 1, 1)
    rows = [(k, "999111222", "SHADOW VESSEL", "cargo", start + timedelta(hours=k), 18.0 + k, 72.0, 10.0 + k, "moving", k == 2, "AIS gap") for k in range(4)]
    df = spark.createDataFrame(rows, "event_id int, mmsi string, ship_name string, vessel_type string, ts timestamp_ntz, latitude double, longitude double, speed_knots double, status string, anomaly_flag boolean, anomaly_type string")
    found = {r.document_type: r for r in documents.build_documents(df, config.ports(spark)).collect()}
    assert found["ship_report"].content == (
        "Ship Report: SHADOW VESSEL\nMMSI: 999111222\nType: cargo\nRoute: Unknown to Unknown\nFirst Position: 18.0000N, 72.0000E at 2025-01-01 00:00:00\n"
        "Last Position: 21.0000N, 72.0000E at 2025-01-01 03:00:00\nAverage Speed: 11.5 knots\nTotal Positions Recorded: 4\nCurrent Status: moving\n\nANOMALY DETECTED: AIS gap")
    assert found["port_report"].content.splitlines()[0] == "Port Activity Report: Mumbai" and "Ships in vicinity: 1" in found["port_report"].content
    assert "Speed: 12.0 knots" in found["anomaly_alert"].content and found["anomaly_alert"].metadata["anomaly_type"] == "AIS gap"


def test_planted_history(spark):
    start = datetime(2025, 1, 1)
    shadow = [(k, "999111222", "SHADOW VESSEL", start + timedelta(hours=h), 15.0, 73.0 + h / 100, 12.0) for k, h in enumerate([*range(10), *range(22, 30)])]
    runner = [(100 + k, "999333444", "PHANTOM RUNNER", start + timedelta(hours=k), 12.0, 75.0, 85.0 if k == 10 else 15.0) for k in range(20)]
    df = spark.createDataFrame(shadow + runner, "event_id int, mmsi string, ship_name string, ts timestamp_ntz, latitude double, longitude double, speed_knots double")
    gaps = history.ais_gaps(df, 6).collect()
    assert [(r.mmsi, r.gap_hours, r.jump_nm) for r in gaps] == [("999111222", 13.0, pytest.approx(7.54, abs=0.01))] and history.ais_gaps(df, 13).count() == 0
    assert history.ais_gaps(df, 6, "ship_name").first().ship_name == "SHADOW VESSEL"
    assert [r.event_id for r in filters.speed_anomalies(df).collect()] == [110]
    traffic = history.traffic_over_time(df.where("mmsi = '999111222'"), 6).orderBy("interval_start").collect()
    assert [(r.vessels, r.positions) for r in traffic] == [(1, 6), (1, 4), (0, 0), (1, 2), (1, 6)]
    assert history.traffic_over_time(df.limit(0)).count() == 0 and history.fleet_summary(df.limit(0).withColumn("is_dark_ship", F.lit(True))).first().dark_percent == 0.0
    assert [r.end for r in history.track_ends(df, "999333444").collect()].count("first") == 5 and history.track_ends(df.where("event_id < 108"), "999333444").count() == 5


def test_sinks(spark, tmp_path):
    schema = "track_id string, latitude double, identity_source string, vessel_length_m double, created_at timestamp, updated_at timestamp, tags array<string>"
    old = spark.createDataFrame([("A", 1.0, "ais", 50.0, NOW, NOW, ["x"]), ("C", 9.0, None, None, NOW, NOW, None)], schema)
    later = NOW + timedelta(hours=1)
    new = spark.createDataFrame([("A", 2.0, "drone", 60.0, later, later, None), ("A", 3.0, "x", 70.0, later, later + timedelta(1), None), ("B", 4.0, "unknown", None, later, later, ["y"])], schema)
    rows = {r.track_id: r for r in sinks.upsert_tracks(new, old).collect()}
    assert (rows["A"].latitude, rows["A"].identity_source, rows["A"].vessel_length_m, rows["A"].created_at, rows["A"].tags) == (3.0, "ais", 50.0, NOW, None)
    assert rows["B"].latitude == 4.0 and rows["C"].latitude == 9.0 and len(rows) == 3
    events = spark.createDataFrame([("A", NOW, 1), ("A", NOW, 1), ("Z", NOW, 2), ("B", NOW - timedelta(days=2), 3)], "track_id string, event_timestamp timestamp, n int")
    tracks = new.withColumns({"mmsi": F.lit("1"), "ship_name": F.lit("S"), "longitude": F.lit(0.0)}).dropDuplicates(["track_id"])
    assert sorted(r.n for r in sinks.append_dark_events(events, tracks).collect()) == [1, 3] and [r.n for r in sinks.append_dark_events(events, tracks, events.where("n = 3")).collect()] == [1]
    assert [r.n for r in sinks.orphan_events(events, tracks).collect()] == [2] and [r.n for r in sinks.recent_dark_events(events, tracks, NOW).collect()] == [1, 1]
    assert [r.track_id for r in sinks.retain_latest(events, 1, "track_id").collect()] == ["Z"]
    wire = spark.createDataFrame([("T", "1.5", "0", "bad", "True", "", "ais, radar,", "", "confirmed", "2025-01-01T00:00:00Z")], "track_id string, latitude string, speed_knots string, course string, is_dark_ship string, mmsi string, contributing_sensors string, status string, track_status string, updated_at string")
    row = sinks.parse_track_rows(wire, NOW).first()
    assert (row.latitude, row.speed_knots, row.course, row.is_dark_ship, row.mmsi, row.contributing_sensors, row.track_status, row.position_uncertainty_m, row.identity_source) == (1.5, 0.0, None, True, None, ["ais", "radar"], "confirmed", 1000.0, "unknown")
    text = sinks.format_track_rows(sinks.parse_track_rows(wire, NOW)).first()
    assert (text.course, text.mmsi, text.is_dark_ship, text.contributing_sensors, text.status, text.ais_last_seen) == ("0", "", "True", "ais,radar", "confirmed", "")
    alert = spark.createDataFrame([("T", "2025-01-01T00:00:00Z", "1", "2", "0.7", "", "gap", "radar")], "track_id string, timestamp string, latitude string, longitude string, confidence string, alert_reason string, reason string, contributing_sensors string")
    assert sinks.parse_dark_events(alert).first().alert_reason == "gap"
    seen = spark.createDataFrame([("P1", "S", "SAR", "D1", NOW, 1.0, 2.0, 0.5, 10.0, None, None, True, "cv")], "pass_id string, satellite string, sensor_type string, detection_id string, ts timestamp, latitude double, longitude double, confidence double, vessel_length_m double, vessel_width_m double, orientation_deg double, is_dark_ship boolean, detection_method string")
    from vesselspark.sources import satellite

    sinks.write_detections_csv(seen, str(tmp_path / "csv"))
    sinks.write_detections_geojson(seen, str(tmp_path / "geo"))
    again = satellite.read_satellite_csv(spark, str(tmp_path / "csv")).first()
    assert (again.detection_id, again.ts, again.latitude, again.vessel_width_m, again.is_dark_ship) == ("D1", NOW, 1.0, None, True)
    back = satellite.geojson_features(satellite.read_passes(spark, str(tmp_path / "geo/pass_id=P1"), "*.txt")).first()
    assert (back.detection_id, back.ts, back.longitude, back.satellite, back.is_dark_ship) == ("D1", NOW, 2.0, "S", True)


def test_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKED", 3)
    rng = np.random.default_rng(8)
    data = [rng.integers(-2, 3, size=[3, 7, 0][k % 3] if k % 11 else 7).astype(float) for k in range(120)]
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(500, [1.0, None, 2.0]), (501, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.batch_search(df, df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 6, block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.similarity, 9)))
    unit = [v / max(float(np.linalg.norm(v)), 1e-300) for v in data]
    for q in range(0, 120, 5):
        near = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k in range(120) if len(data[k]) == len(data[q]))[:6]
        assert [s for _, s in got[q]] == [-s for s, _ in near]
    assert set(got) == set(range(0, 120, 5))


def test_long_lists_are_ranked_whole(spark):
    lists = {"structured": [f"s{(k * 7919) % 12_000}" for k in range(12_000)], "semantic": [f"s{k}" for k in range(300)]}
    frames = {name: spark.createDataFrame([(k, x) for k, x in enumerate(items)], "position long, id string").repartition(5) for name, items in lists.items()}
    want = {}
    for name, items in lists.items():
        for at, item in enumerate(items):
            want[item] = want.get(item, 0) + vectors.config.RRF_WEIGHTS[name] / (vectors.config.RRF_K + at)
    for short in (10, 10_000, 20_000):
        got = {r.item_id: r.fusion_score for r in vectors.rrf_fuse(frames, short=short).collect()}
        assert got == pytest.approx(want) and len(got) == 12_000


def test_many_rectangles(spark):
    """50,000 of all sizes against trying all of them; no nested loops."""
    rng = np.random.default_rng(12)
    n = 50_000
    size = np.where(rng.random(n) < 0.0005, 90.0, 10 ** rng.uniform(-4, 0.3, n))
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    boxes = np.c_[lat, lat + size * rng.random(n), lon, lon + size * rng.random(n)]
    boxes[:50] = np.round(boxes[:50])
    rows = [(k, *map(float, b)) for k, b in enumerate(boxes)] + [(n, 5.0, 4.0, 1.0, 2.0), (n + 1, None, 4.0, 1.0, 2.0), (n + 2, float("-inf"), float("inf"), -180.0, 180.0)]
    places = np.r_[np.c_[rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)], boxes[:60, [0, 2]], boxes[60:90, [1, 3]]]
    rect = spark.createDataFrame(rows, "region long, lat_min double, lat_max double, lon_min double, lon_max double")
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(places)] + [(9000, None, 1.0)], "event_id long, latitude double, longitude double")
    found = proximity.assign_regions(df, rect)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = sorted((r.event_id, r.region) for r in found.collect())
    want = [(k, n + 2) for k in range(len(places))]
    for k, (a, b) in enumerate(places):
        inside = (boxes[:, 0] <= a) & (a <= boxes[:, 1]) & (boxes[:, 2] <= b) & (b <= boxes[:, 3])
        want += [(k, int(r)) for r in np.flatnonzero(inside)]
    assert len(got) == len(set(got)) and not set(got) ^ set(want) and len(want) > 700


@pytest.mark.parametrize("n", [20, 20_000])
def test_nearest_of_many_stations(spark, n):
    from vesselspark.operators import extras

    rng = np.random.default_rng(n)
    dense = np.c_[rng.uniform(10, 12, n // 2), rng.uniform(70, 72, n // 2)]
    places = np.r_[dense, np.c_[rng.uniform(-60, 60, n - len(dense) - 6), rng.uniform(-180, 180, n - len(dense) - 6)], [(90, 0), (-89.99, 10), (0, 179.99), (0, -179.99), (45, 180), (45, -180)]]
    stations = spark.createDataFrame([(f"S{k:05d}", float(a), float(b)) for k, (a, b) in enumerate(places)] + [("A", None, 1.0), ("S99999", *map(float, places[0]))], "station_id string, latitude double, longitude double")
    rows = np.r_[np.c_[rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)], np.c_[rng.uniform(9, 13, 40), rng.uniform(69, 73, 40)],
                 [(89.9, 120), (90, 50), (-90, 0), (0.5, 180), (0.1, -180), (45, 179.999), (45.01, -179.9), places[0], places[-1]]]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rows)] + [(9000, None, 2.0)], "event_id long, latitude double, longitude double")
    got = {r.event_id: r.station_id for r in extras.nearest_stations(df, stations).collect()}
    assert len(got) == len(rows) + 1 and got.pop(9000) is None
    la, lo = np.radians(places[:, 0]), np.radians(places[:, 1])
    for k, (a, b) in enumerate(np.radians(rows)):
        h = np.sin((la - a) / 2) ** 2 + np.cos(la) * np.cos(a) * np.sin((lo - b) / 2) ** 2
        assert h[int(got[k][1:]) if got[k] != "S99999" else 0] <= h.min() + 1e-15
    assert got[len(rows) - 2] == "S00000"
    assert extras.nearest_stations(df, stations.limit(0)).where("station_id is not null").count() == 0


def test_long_keys_by_parts_of_a_hash(spark):
    """Salts depend on the row alone, so a rerun deals rows to the same ones."""
    from vesselspark.operators import extras

    rows = [(f"m{k % 50}", NOW + timedelta(seconds=k), 10.0 + k * 1e-6, 70.0) for k in range(500)]
    df = spark.createDataFrame(rows, "mmsi string, ts timestamp_ntz, latitude double, longitude double").withColumns({"cell_row": F.lit(1), "cell_column": F.lit(1), "period": F.lit(1)})
    old, extras.CROWDED = extras.CROWDED, 100
    try:
        deals = [{(r.mmsi, r.ts): r.salt for r in extras._salted(df.repartition(parts), df)[0].collect()} for parts in (1, 3)]
    finally:
        extras.CROWDED = old
    assert deals[0] == deals[1] and len(set(deals[0].values())) == 5


def test_embedding_tells_what_failed(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BATCH", 2)

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return np.ones((len(texts), 3))

    df = spark.createDataFrame([(k, "bad" if k == 3 else "fine") for k in range(6)], "id long, content string").coalesce(1)
    got = {r.id: (r.embedding, r.failed) for r in vectors.embed(df, model, dim=3, failed_col="failed").collect()}
    assert {k for k, (_, failed) in got.items() if failed} == {2, 3} and got[2][0] == [0.0] * 3 and got[4][0] == [1.0] * 3
    assert vectors.embed(df, model, dim=3).columns == ["id", "content", "embedding"]


def test_encounters_send_no_copies_of_fixes_through_the_driver(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"{200 + k % 40}", start + timedelta(minutes=k), 10.0 + k % 7 * 0.1, 70.0 + k % 5 * 0.1) for k in range(400)]
    spark.createDataFrame(rows, "mmsi string, ts timestamp_ntz, latitude double, longitude double").write.parquet(str(tmp_path / "fixes"))
    found = extras.encounters(spark.read.parquet(str(tmp_path / "fixes")), 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "salt#" in line.split("], [")[0]]
    pairs = [(a, b) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[0] != b[0] and b[1] - a[1] <= timedelta(hours=1)]
    near = {}
    places = sorted({(a[2:], b[2:]) for a, b in pairs})
    away = dict(zip(places, (r.km for r in spark.createDataFrame([(*a, *b) for a, b in places], "a double, b double, c double, e double").select(geo.haversine("a", "b", "c", "e").alias("km")).collect())))
    for a, b in pairs:
        if away[a[2:], b[2:]] <= 50:
            near.setdefault((min(a[0], b[0]), max(a[0], b[0])), []).append(min(a[1], b[1]))
    assert {(r.mmsi, r.other): (r.meetings, r.first_ts) for r in found.collect()} == {k: (len(v), min(v)) for k, v in near.items()}


def test_ships_that_share_a_name_share_a_report(spark):
    rows = [("ONE", "300", "TANKER", datetime(2024, 1, 1), 1, 10.0), ("ONE", "200", "CARGO", datetime(2024, 1, 2), 2, 12.0), ("TWO", "400", None, datetime(2024, 1, 1), 3, 1.0)]
    df = spark.createDataFrame(rows, "ship_name string, mmsi string, vessel_type string, ts timestamp_ntz, event_id long, speed_knots double").withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    got = {r.metadata["ship_name"]: (r.metadata["mmsi"], r.content.split("\n")[1:3]) for r in documents.ship_reports(df).collect()}
    assert got == {"ONE": ("200", ["MMSI: 200", "Type: CARGO"]), "TWO": ("400", ["MMSI: 400", "Type: Unknown"])}
    assert {r.content.split("\n")[2] for r in documents.ship_reports(df.drop("vessel_type")).collect()} == {"Type: Unknown"}
