from __future__ import annotations

import itertools
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vesselspark.operators import correlate, tracks
from vesselspark.operators.graph import component_labels
from vesselspark.plans.fusion import build_tracks

NOW = datetime(2025, 1, 1, 12)
DET = "detection_id string, sensor string, sensor_id string, ts timestamp, latitude double, longitude double, mmsi string, ship_name string, vessel_type string, speed_knots double, course double, confidence double, vessel_length_m double, object_class string, is_dark_ship boolean, quality int, local_track_id string"


def det(k, sensor, seconds, lat, lon, **more):
    row = dict.fromkeys(f.split()[0] for f in DET.split(", ")) | {"detection_id": f"{k:04d}", "sensor": sensor, "sensor_id": sensor.upper(), "ts": NOW + timedelta(seconds=seconds), "latitude": lat, "longitude": lon}
    return tuple((row | more).values())


def test_hungarian_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(rng.integers(1, 6)), int(rng.integers(0, 3))
        cost = rng.choice([0.1, 0.5, 0.95, 1e6, 2.0], (n, n + m)) + rng.random((n, n + m)) * (rng.random() < 0.5)
        got = correlate.hungarian(cost)
        assert len(set(got.tolist())) == n
        best = min(sum(cost[k, c] for k, c in enumerate(p)) for p in itertools.permutations(range(n + m), n))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)


def test_a_component_of_two_thousand():
    """Chains and bunches of one component against the dense solver."""
    rng, n = np.random.default_rng(9), 2000
    own = [{r, *(int(c) for c in rng.integers(max(0, r - 4), min(n, r + 5), 4))} for r in range(n)]
    candidates = [[(c, float(rng.random())) for c in sorted(cs)] for cs in own]
    got = correlate.cheapest(candidates, 0.95)
    used = [c for c in got if c >= 0]
    assert len(set(used)) == len(used)
    # the dense matrix of the whole, by blocks that the optimum's prices prove apart, would be large: a check by duality
    total = sum(0.95 if c < 0 else dict(candidates[r])[c] for r, c in enumerate(got))
    assert total == pytest.approx(dual_bound(candidates, got), abs=1e-6)


def dual_bound(candidates, chosen, alone=0.95):
    """A lower bound of any assignment's cost: prices u of rows and v <= 0 of columns with u + v <= cost and u <= alone, by
    shortest paths over the exchanges that an assignment allows. It equals the cost where the assignment is optimal."""
    columns = sorted({c for own in candidates for c, _ in own})
    v = dict.fromkeys(columns, 0.0)
    cost_of = [alone if c < 0 else dict(candidates[r])[c] for r, c in enumerate(chosen)]
    for _ in range(len(columns) + 1):
        moved = False
        for r, own in enumerate(candidates):
            u = min(alone, cost_of[r] - (v[chosen[r]] if chosen[r] >= 0 else 0.0))
            if chosen[r] >= 0 and cost_of[r] - v[chosen[r]] > alone + 1e-12:
                raise AssertionError("an exchange with staying alone is cheaper")
            for c, x in own:
                if c != chosen[r] and u + v[c] > x + 1e-12:
                    v[c], moved = x - u, True
        if not moved:
            break
    free = set(columns) - set(chosen)
    assert all(v[c] > -1e-9 for c in free), "a free column would be cheaper"
    rows = [min([alone, *(x - v[c] for c, x in own)]) for own in candidates]
    return sum(rows) + sum(v.values())


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    for n, m, share in [(int(rng.integers(1, 9)), int(rng.integers(1, 9)), float(rng.random())) for _ in range(400)] + [(120, 90, 0.05), (90, 120, 0.3)]:
        cost = np.where(rng.random((n, m)) < share, np.round(rng.random((n, m)) * 1.1, 1) if n % 2 else rng.random((n, m)), 1e6)
        whole = np.full((n, m + n), 1e6)
        whole[:, :m] = cost
        whole[np.arange(n), m + np.arange(n)] = 0.95
        got = correlate.cheapest([[(c, cost[r, c]) for c in range(m) if cost[r, c] < 1e6] for r in range(n)], 0.95)
        used = [c for c in got if c >= 0]
        assert len(set(used)) == len(used)
        assert sum(0.95 if c < 0 else cost[r, c] for r, c in enumerate(got)) == pytest.approx(whole[np.arange(n), correlate.hungarian(whole)].sum())
    # a chain: each detection's best track is the best of the one before too, and the next track is free
    n = 500
    pairs = [(f"d{k:04d}", f"t{k:04d}", 0.9 - 1e-5 * k) for k in range(n)] + [(f"d{k:04d}", f"t{k - 1:04d}", 0.9001 - 1e-5 * k) for k in range(1, n)]
    out = correlate.solve(pd.DataFrame(pairs, columns=["detection_id", "track_id", "confidence"]))
    assert (out.track_id != "NEW").all() and out.track_id.is_unique and out.exact.all()


def test_labels(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("x", "y"), ("z", "y"), ("q", "q")]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x", "q"} and got["n060"] == "n000" and got["z"] == "x"


def batch(spark, n=40):
    rng = np.random.default_rng(3)
    t = [(f"T{k:02d}", 10 + rng.random() * 0.2, 70 + rng.random() * 0.2, float(rng.normal()), float(rng.normal()), 100.0, float(rng.random() * 20), float(rng.random() * 360), "dropped" if k == 7 else "confirmed", None if k % 3 else str(k), NOW) for k in range(n)]
    t += [("EDGE", 10.0, 179.999, 0.0, 0.0, 100.0, None, None, "confirmed", None, NOW)]
    frame = spark.createDataFrame(t, "track_id string, latitude double, longitude double, velocity_north_ms double, velocity_east_ms double, position_uncertainty_m double, speed_knots double, course double, track_status string, mmsi string, updated_at timestamp")
    rows = [det(k, ["radar", "satellite", "drone"][k % 3], int(rng.integers(-100, 200)), 10 + rng.random() * 0.2, 70 + rng.random() * 0.2, speed_knots=float(rng.random() * 20)) for k in range(n)]
    rows += [det(900, "radar", 10, 10.0, -179.999), det(901, "ais", 0, 50.0, 50.0, mmsi="3"), det(902, "drone", 0, -60.0, 0.0)]
    return spark.createDataFrame(rows, DET), frame


def test_gates_and_assignment(spark):
    d, t = batch(spark)
    got = {(r.detection_id, r.track_id): r for r in correlate.gated(d, t).collect()}
    from vesselspark.functions.geo import gate_size, haversine, predict_position
    from vesselspark.operators.history import seconds_between

    every = d.alias("d").crossJoin(t.where("track_status <> 'dropped'").withColumnsRenamed({"latitude": "a", "longitude": "b", "speed_knots": "s", "course": "c", "mmsi": "m"}).alias("t"))
    seconds = seconds_between(F.col("updated_at"), F.col("ts"))
    at = predict_position("a", "b", "velocity_north_ms", "velocity_east_ms", seconds)
    want = every.where((F.abs(seconds) <= 120) & (haversine(*at, "latitude", "longitude", "m") < gate_size("position_uncertainty_m", correlate.sensor_sigma(F.col("sensor"))))).select("detection_id", "track_id").collect()
    assert got.keys() == set(map(tuple, want)) and ("0900", "EDGE") in got
    best = {r.detection_id: r.track_id for r in correlate.correlate_nearest(d, t).collect()}
    assert all(best[k] == min((r.score, r.track_id) for (i, _), r in got.items() if i == k)[1] for k in best)
    out = {r.detection_id: r for r in correlate.assign(d, t).collect()}
    assert out["0901"].track_id == "T03" and out["0901"].confidence == 1 and out["0902"].track_id == "NEW" and len(out) == 43
    used = [r.track_id for r in out.values() if r.track_id != "NEW"]
    assert len(set(used)) == len(used) and all(r.exact for r in out.values())
    ids = sorted(k for k in out if k not in ("0901", "0902"))
    names = sorted({j for _, j in got})
    cost = np.full((len(ids), len(names) + len(ids)), 1e6)
    for (i, j), r in got.items():
        cost[ids.index(i), names.index(j)] = 1 - r.confidence
    cost[np.arange(len(ids)), len(names) + np.arange(len(ids))] = 0.95
    whole = cost[np.arange(len(ids)), correlate.hungarian(cost)].sum()
    assert sum(0.95 if out[k].track_id == "NEW" else 1 - out[k].confidence for k in ids) == pytest.approx(whole)


def test_names_come_before_assignment(spark):
    _, t = batch(spark)
    t = t.where("track_id = 'T03'").unionByName(t.where("track_id = 'T03'").withColumns({"track_id": F.lit("T90"), "latitude": F.lit(60.0), "updated_at": F.col("updated_at") - F.expr("interval 1 hour")}))
    at = t.where("track_id = 'T03'").first()
    rows = [det(k, "ais", k, 50.0, 50.0 + k, mmsi="3") for k in range(4)] + [det(10, "radar", 0, at.latitude, at.longitude), det(11, "ais", 0, -50.0, 0.0, mmsi="unknown")]
    got = sorted((r.detection_id, r.track_id, r.confidence == 1, r.exact) for r in correlate.assign(spark.createDataFrame(rows, DET), t).collect())
    assert [g[:2] for g in got] == [*((f"{k:04d}", "T03") for k in range(4)), ("0010", "T03"), ("0011", "NEW")]
    assert all(g[2] for g in got[:4]) and all(g[3] for g in got)


def test_merge(spark):
    def part(n, confidence=1.0):
        return (None, NOW, n, 1.0, 2.0, confidence)

    def track(name, mmsi, source, lat, sensors, quality, dark, sure, status):
        row = dict.fromkeys(tracks.NAMES) | {
            "track_id": name, "mmsi": mmsi, "identity_source": source, "latitude": lat, "longitude": 70.0, "sensor_contributions": {k: part(n) for k, n in sensors.items()},
            "contributing_sensors": list(sensors), "update_count": sum(sensors.values()), "track_quality": quality, "is_dark_ship": dark, "dark_ship_confidence": sure, "track_status": status}
        return tuple(row[c] for c in tracks.NAMES)

    rows = [track("A", "1", "ais", 10.0, {"ais": 4}, 50, False, 0.0, "confirmed"), track("B", "1", "ais", 10.0, {"drone": 1, "ais": 1, "radar": 2}, 60, True, 0.7, "confirmed"),
            track("C", None, "unknown", 10.04, {"radar": 5, "satellite": 1}, 20, True, 0.6, "tentative"), track("D", None, "unknown", 10.05, {"radar": 1}, 0, False, 0.0, "tentative"),
            track("E", None, "unknown", 10.01, {"radar": 9}, 99, True, 0.9, "dropped")]
    merged = correlate.merge_duplicates(spark.createDataFrame(rows, tracks.SCHEMA))
    got = {r.track_id: r for r in merged.collect()}
    assert {k: (r.track_status, r.merged_into) for k, r in got.items()} == {"A": ("confirmed", None), "B": ("dropped", "A"), "C": ("dropped", "A"), "D": ("tentative", None), "E": ("dropped", None)}
    a = got["A"]
    assert {k: c.measurement_count for k, c in a.sensor_contributions.items()} == {"ais": 5, "drone": 1, "radar": 7, "satellite": 1} and a.contributing_sensors == ["ais", "drone", "radar", "satellite"]
    assert (a.update_count, a.track_quality, a.is_dark_ship, a.dark_ship_confidence) == (14, 60, True, 0.7)
    assert got["D"].contributing_sensors == ["radar"] and got["D"].update_count == 1
    empty = spark.createDataFrame([], DET).withColumn("track_id", F.lit("x"))
    stats = tracks.fusion_stats(merged, empty).first()
    assert (stats.tracks_created, stats.tracks_merged, stats.tracks_dropped, stats.active_tracks, stats.dark_ships) == (5, 2, 1, 2, 1)


def test_fold_by_hand():
    first = {"sensor": "radar", "sensor_id": "R", "ts": NOW, "latitude": 10.0, "longitude": 70.0, "speed_knots": 10.0, "course": 90.0}
    track = tracks.opened("T", first)
    assert (track["position_uncertainty_m"], track["velocity_east_ms"], track["speed_knots"], track["track_status"], track["track_quality"]) == (500, 0, 10, "tentative", 0)
    track = tracks.updated(track, {"sensor": "satellite", "sensor_id": "S", "ts": NOW, "latitude": 11.0, "longitude": 70.0, "vessel_length_m": 90.0, "is_dark_ship": True}, 0.5)
    assert track["latitude"] == pytest.approx(10 + 1 / 17) and track["is_dark_ship"] and track["dark_ship_confidence"] == 0.6 and not track["flagged_for_review"]
    track = tracks.updated(track, {"sensor": "ais", "sensor_id": "AIS", "ts": NOW, "latitude": 10.0, "longitude": 70.0, "mmsi": "5", "ship_name": "X", "speed_knots": 10.0, "course": 90.0}, 0.9)
    assert track["position_uncertainty_m"] == 100 and not track["is_dark_ship"] and track["mmsi"] == "5" and track["velocity_east_ms"] == pytest.approx(5.144)
    assert track["track_status"] == "confirmed" and track["track_quality"] == 30 + 15 + 20 and track["vessel_length_m"] == 90.0 and track["correlation_confidence"] == 0.9
    assert tracks.quality(3, 8, 100) == 80


@pytest.mark.parametrize("part_s", [3.0, 40.0, 21_600.0])
def test_fold_of_parts_is_the_fold(spark, part_s):
    """Sums over parts of tracks against the step by step fold, with repeated times and missing values."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        sensor = ["radar", "satellite", "drone", "ais"][int(rng.choice(4, p=[0.4, 0.2, 0.2, 0.2] if k % 6 else [0.4, 0.4, 0.2, 0.0]))]
        maybe = lambda value: value if rng.random() < 0.6 else [None, 0.0][int(rng.integers(2))]
        rows.append(det(k, sensor, int(rng.integers(0, 100)), 10 + rng.random(), 70 + rng.random(), mmsi=[None, "", "5"][int(rng.integers(3))] if sensor == "ais" else None,
                        ship_name=f"N{k}", vessel_type=[None, "CARGO"][int(rng.integers(2))], speed_knots=maybe(rng.random() * 20), course=maybe(rng.random() * 360),
                        vessel_length_m=maybe(80.0 + k), object_class=[None, "", "tug"][int(rng.integers(3))], is_dark_ship=[None, False, True][int(rng.integers(3))]))
    sure = {f"{k:04d}": [None, 0.0, 0.25, 0.75][int(rng.integers(4))] for k in range(300)}
    frame = spark.createDataFrame(rows, DET).withColumn("track_id", F.concat(F.lit("V"), (F.col("detection_id").cast("int") % 12).cast("string")))
    known = spark.createDataFrame(list(sure.items()), "detection_id string, match_confidence double")
    folded = tracks.fold_tracks(frame.join(known, "detection_id"), part_s)
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString() and folded.columns == tracks.NAMES
    got = {r.track_id: r.asDict(recursive=True) for r in folded.collect()}
    names = [c.split()[0] for c in DET.split(", ")]
    for k in range(12):
        own = sorted((dict(zip(names, r)) | {"match_confidence": sure[r[0]]} for r in rows if int(r[0]) % 12 == k), key=lambda d: (d["ts"], d["detection_id"]))
        want = tracks.fold(f"V{k}", own)
        for name in tracks.NAMES:
            a, b = got[f"V{k}"][name], want[name]
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b), (k, name)
    assert len(got) == 12
    alone = tracks.fold_tracks(spark.createDataFrame(rows[:1], DET).withColumn("track_id", F.lit("x"))).first()
    assert alone.update_count == 1 and alone.track_quality == 0 and alone.correlation_confidence == 0 and alone.latitude == rows[0][4]
    assert tracks.fold_tracks(frame.limit(0), part_s).collect() == []


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_dark_rules(spark):
    sensors = lambda *s: F.array(*map(F.lit, s))
    assert value(spark, tracks.dark_confidence(sensors("radar", "satellite"), F.lit(3)), tracks.dark_confidence(sensors("radar", "drone"), F.lit(2)), tracks.dark_confidence(sensors("radar", "satellite"), F.lit(2)),
                 tracks.track_quality(3, 8, 100)) == pytest.approx((0.8, 0.8, 0.6, 80))
    rows, names = [], {}
    for k, (ais, other) in enumerate([(900, 10), (901, 10), (3600, 119), (3600, 120), (8000, 10)]):
        rows += [det(10 * k, "ais", -ais, 10.0, 60.0 + k, mmsi=f"{k}"), det(10 * k + 1, "radar", -other, 10.0, 60.0 + k)]
        names[f"{10 * k:04d}"] = k
    one = spark.createDataFrame(rows, DET).withColumn("track_id", F.concat(F.lit("V"), F.floor(F.col("detection_id").cast("int") / 10).cast("string")))
    folded = tracks.fold_tracks(one).withColumn("track_status", F.lit("confirmed"))
    got = {r.track_id: r for r in tracks.dark_by_gap(folded, NOW).collect()}
    assert [got[f"V{k}"].is_dark_ship for k in range(5)] == [False, True, True, False, True]
    assert [round(got[f"V{k}"].dark_ship_confidence, 4) for k in (1, 2, 4)] == [0.2503, 1, 1] and got["V1"].alert_reason == "AIS gap: 15 minutes" and got["V4"].alert_reason == "AIS gap: 133 minutes"
    plain = [det(0, "radar", 0, 1.0, 1.0), det(1, "satellite", 1, 1.0, 1.0), det(10, "drone", 0, 2.0, 2.0), det(20, "radar", 0, 3.0, 3.0), det(30, "satellite", 0, 4.0, 4.0, is_dark_ship=True), det(31, "radar", 1, 4.0, 4.0), det(40, "ais", 0, 5.0, 5.0, mmsi="9"), det(41, "drone", 1, 5.0, 5.0)]
    two = spark.createDataFrame(plain, DET).withColumn("track_id", F.concat(F.lit("V"), F.floor(F.col("detection_id").cast("int") / 10).cast("string")))
    out = tracks.dark_by_sensors(tracks.fold_tracks(two)).cache()
    got = {r.track_id: (r.is_dark_ship, r.flagged_for_review, round(r.dark_ship_confidence, 6), r.alert_reason) for r in out.collect()}
    assert got == {"V0": (True, True, 0.6, "Dark ship (sensors: radar, satellite)"), "V1": (True, True, 0.8, "Dark ship (sensors: drone)"), "V2": (False, False, 0, None), "V3": (True, False, 0.6, None), "V4": (False, False, 0, None)}
    alerts = tracks.dark_alerts(out)
    assert sorted(r.track_id for r in alerts.collect()) == ["V0", "V1"] and [r.track_id for r in tracks.dark_alerts(out, alerts.where("track_id = 'V0'")).collect()] == ["V1"]
    stats = tracks.fusion_stats(out, two).first()
    assert (stats.tracks_created, stats.dark_ships_flagged, stats.dark_ships, stats.correlations["radar"]) == (5, 2, 3, 3)


def test_ageing(spark):
    rows = [(k, "confirmed" if k else "coasting", 4000.0, NOW - timedelta(seconds=s)) for k, s in enumerate([61, 60, 61, 120, 121])]
    df = spark.createDataFrame(rows, "k int, track_status string, position_uncertainty_m double, updated_at timestamp")
    got = [(r.track_status, r.position_uncertainty_m) for r in tracks.age_tracks(df, NOW).orderBy("k").collect()]
    assert got == [("coasting", 4000), ("confirmed", 4000), ("coasting", 5000), ("coasting", 5000), ("dropped", 4000)]


def test_whole_job(spark):
    rows = [det(k, "ais", 10 * k, 10 + k * 1e-4, 70.0, mmsi="111", ship_name="A", speed_knots=2.0, course=0.001) for k in range(12)]
    rows += [det(100 + k, "radar", 10 * k + 1, 10 + k * 1e-4, 70.0005, local_track_id="L1") for k in range(12)]  # the same vessel
    rows += [det(200 + k, "radar", 10 * k, 15.0, 75.0, local_track_id="L2") for k in range(8)] + [det(300, "drone", 65, 15.0001, 75.0)]  # one without a name
    rows += [det(400, "ais", 500, 10.0, 70.0, mmsi="111")]  # after a silence: a new track
    frame = spark.createDataFrame(rows, DET)
    later = {(r.mmsi, r.update_count, r.track_status, r.merged_into) for r in build_tracks(frame, NOW + timedelta(seconds=510)).collect()}
    assert later == {("111", 24, "dropped", None), ("111", 1, "tentative", None), (None, 9, "dropped", None)}
    out = build_tracks(frame, NOW + timedelta(seconds=115)).collect()
    assert len(out) == 2
    a = next(r for r in out if r.mmsi == "111" and r.update_count > 1)
    b = next(r for r in out if r.mmsi is None)
    assert a.update_count == 24 and a.contributing_sensors == ["ais", "radar"] and not a.is_dark_ship and a.track_status == "confirmed"
    assert b.update_count == 9 and b.contributing_sensors == ["radar", "drone"] and b.flagged_for_review and b.dark_ship_confidence == pytest.approx(1.0)
    near = [det(500 + k, "radar", 10 * k + 2, 10.03, 70.0, local_track_id="S1") for k in range(4)]  # 3 km off: merged
    merged = {r.merged_into is not None: r for r in build_tracks(spark.createDataFrame(rows[:12] + near, DET), NOW + timedelta(seconds=115)).collect()}
    assert merged[False].update_count == 16 and merged[False].contributing_sensors == ["ais", "radar"] and merged[True].track_status == "dropped"
    assert b.sensor_contributions["radar"].measurement_count == 8 and a.track_id.startswith("TRK-") and len(a.track_id) == 12
