from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_tracks import DET, det

from vesselspark.functions.sql import register_table_functions
from vesselspark.operators import history, proximity, sinks
from vesselspark.operators.vectors import search_documents
from vesselspark.streaming.feeds import stream_files
from vesselspark.streaming.incremental import FusionStats, VesselMaster, observe_detections, sessions, track_table, upsert_batch

NOW = datetime(2025, 1, 1, 12)
POSITION = "event_id long, mmsi string, ts timestamp_ntz, ship_name string, vessel_type string"


def positions(seed, n):
    rnd = random.Random(seed)
    return [(seed * 1000 + k, rnd.choice(["a", "b", "c", "d", None]), NOW + timedelta(seconds=rnd.randint(0, 5000)), rnd.choice(["X", "Y", None]), rnd.choice(["CARGO", None])) for k in range(n)]


def test_master_from_batches_that_run_again(spark, tmp_path):
    master, every = VesselMaster(spark, str(tmp_path / "m"), 4), []
    batches = [positions(k, 60) for k in range(4)]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, POSITION)
        for again in (number, number, max(0, number - 2)):  # run twice, and an old one once more
            master.apply(df if again == number else spark.createDataFrame(batches[again], POSITION), again)
        every += rows
        want = history.vessel_master(spark.createDataFrame(every, POSITION)).collect()
        assert sorted(map(repr, master.read().collect())) == sorted(map(repr, want)) and len(want) == 5


def test_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    schema = "track_id string, latitude double, updated_at timestamp, identity_source string, vessel_length_m double, created_at timestamp"
    row = lambda k, at, lat: (f"T{k:05d}", lat, NOW + timedelta(seconds=at), f"s{at}", float(at), NOW + timedelta(seconds=at))
    current = spark.createDataFrame([row(k, 0, 1.0) for k in range(20_000)], schema)
    table = track_table(spark, str(tmp_path / "t"), schema, 64)
    upsert_batch(table, current, 0)
    updates = spark.createDataFrame([row(7 * k, 10 + k, 2.0) for k in range(10)] + [row(0, 99, 3.0), row(90_000, 5, 4.0)], schema)
    for _ in range(2):
        upsert_batch(table, updates, 1)
    written = [f for f in (tmp_path / "t/data/1").iterdir() if f.name.startswith("bucket=")]
    assert 1 <= len(written) <= 11
    assert sum(len(list(f.glob("*.parquet"))) for f in written) == len(written)
    want = sinks.upsert_tracks(updates, current)
    assert table.read().exceptAll(want).isEmpty() and want.exceptAll(table.read()).isEmpty() and want.count() == 20_001
    upsert_batch(table, spark.createDataFrame([row(0, 200, 5.0)], schema), 2)
    assert max(len(v) for v in table.versions().values()) == 2 and table.read().where("latitude = 5").count() == 1


def test_sessions_of_a_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, rnd.choice("ab"), NOW + timedelta(seconds=rnd.randint(0, 6000))) for k in range(120)]
    rows += [(500, "c", NOW), (501, "c", NOW + timedelta(seconds=120)), (502, "c", NOW + timedelta(seconds=241)), (503, "c", NOW + timedelta(seconds=241, milliseconds=120_001))]
    rows.sort(key=lambda r: r[2])
    schema = "event_id long, mmsi string, ts timestamp"
    for k in range(0, len(rows), 25):
        spark.createDataFrame(rows[k : k + 25], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(999, "z", NOW + timedelta(days=1))]  # moves the watermark past all others
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), "parquet", schema, 1).withWatermark("ts", "2 minutes")
    query = sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = sorted(tuple(r) for r in spark.table("closed").collect())
    cut = history.segment_tracks(spark.createDataFrame(rows, schema), 120.0)
    want = cut.groupBy("mmsi", "segment").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).select("mmsi", "a", "b", "n").collect()
    assert got == sorted(tuple(r) for r in want) and [r[3] for r in got if r[0] == "c"] == [2, 1, 1]


def test_observed_sums(spark, tmp_path):
    rows = [det(k, ["ais", "radar", "drone", "satellite", "ais"][k % 5], k, 10.0, 70.0) for k in range(53)]
    for k in range(0, 53, 13):
        spark.createDataFrame(rows[k : k + 13], DET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stats = FusionStats()
    spark.streams.addListener(stats)
    try:
        stream = observe_detections(stream_files(spark, str(tmp_path / "in"), "parquet", DET, 1))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        want = {r.sensor: r.messages for r in history.stream_counts(spark.createDataFrame(rows, DET)).collect()}
        assert stats.sums == {"detections": want}, stats
    finally:
        spark.streams.removeListener(stats)


def test_table_functions(spark):
    rnd = random.Random(6)
    rows = [(f"T{k:03d}", str(k), f"S{k}", "CARGO", 18.9 + rnd.uniform(-1, 1), 72.8 + rnd.uniform(-1, 1), 5.0, rnd.choice(["confirmed", "dropped"])) for k in range(300)]
    tracks = spark.createDataFrame(rows, "track_id string, mmsi string, ship_name string, vessel_type string, latitude double, longitude double, speed_knots double, track_status string")
    ports = spark.createDataFrame([("Mumbai", 18.9388, 72.8354), ("Kochi", 9.93, 76.27)], "name string, latitude double, longitude double")
    docs = spark.createDataFrame([(f"d{k}", f"text {k}", ["a", "b"][k % 2], [rnd.uniform(-1, 1) for _ in range(4)]) for k in range(40)] + [("zero", "", "a", [0.0] * 4)], "id string, content string, document_type string, embedding array<double>")
    tracks.createOrReplaceTempView("unified_tracks")
    ports.createOrReplaceTempView("ports")
    docs.createOrReplaceTempView("docs")
    docs.selectExpr("id", "document_type as track_id", "content as description", "timestamp '2025-01-01' as window_start", "timestamp '2025-01-02' as window_end", "embedding").createOrReplaceTempView("hist")
    register_table_functions(spark, documents="docs", history="hist")
    got = spark.sql("SELECT * FROM find_ships_near_point(18.9, 72.8, 60.0)").collect()
    want = proximity.ships_near_point(tracks, 18.9, 72.8, 60.0).collect()
    assert [r.track_id for r in got] == [r.track_id for r in want] and [r.distance_km for r in got] == pytest.approx([r.distance_km for r in want]) and len(got) > 20
    got = spark.sql("SELECT * FROM find_ships_near_port('mumbai', 40.0, 7)").collect()
    want = proximity.ships_near_port(tracks, ports, "mumbai", 40.0, 7).collect()
    assert [r.track_id for r in got] == [r.track_id for r in want] and len(got) == 7 and got[0].port == "mumbai"
    joined = spark.sql("SELECT p.name, count(*) AS n FROM ports p, LATERAL find_ships_near_point(p.latitude, p.longitude, 60.0) GROUP BY p.name").collect()
    assert [r.name for r in joined] == ["Mumbai"]
    with pytest.raises(Exception, match="Port not found"):
        spark.sql("SELECT * FROM find_ships_near_port('nowhere')").collect()
    query = [0.3, -0.2, 0.9, 0.1]
    got = spark.sql("SELECT * FROM search_documents_by_similarity(array(0.3D, -0.2D, 0.9D, 0.1D), 6, 'a', 0.2D)").collect()
    want = search_documents(docs, query, "a", 0.2, 6).collect()
    assert [r.id for r in got] == [r.id for r in want] and [r.similarity for r in got] == pytest.approx([r.similarity for r in want]) and got
    assert spark.sql("SELECT * FROM search_track_history_by_similarity(array(0.3D, -0.2D, 0.9D, 0.1D), 50)").count() == 41
    assert spark.sql("SELECT * FROM search_track_history_by_similarity(array(0.3D, -0.2D, 0.9D, 0.1D), time_start => timestamp '2025-01-03')").count() == 0
