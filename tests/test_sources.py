from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from vesselspark.sources import feeds, nmea, radar, satellite, unify

ARMOUR = "0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVW`abcdefghijklmnopqrstuvw"


def sentence(payload, fill=0, total=1, number=1, seq="", channel="A"):
    body = f"AIVDM,{total},{number},{seq},{channel},{payload},{fill}"
    check = 0
    for c in body:
        check ^= ord(c)
    return f"!{body}*{check:02X}"


def armour(bits):
    fill = -len(bits) % 6
    bits += "0" * fill
    return "".join(ARMOUR[int(bits[k : k + 6], 2)] for k in range(0, len(bits), 6)), fill


def field(value, n):
    return f"{value & (1 << n) - 1:0{n}b}"


def position(mmsi, rot, sog, lon, lat, cog, heading, kind=1):
    return field(kind, 6) + "00" + field(mmsi, 30) + field(5, 4) + field(rot, 8) + field(sog, 10) + "1" + field(lon, 28) + field(lat, 27) + field(cog, 12) + field(heading, 9) + field(30, 6) + "0" * 25


def text(value, n):
    return "".join(field(ord(c) % 64, 6) for c in value.ljust(n, "@"))


def static(mmsi, name, code):
    return (field(5, 6) + "00" + field(mmsi, 30) + "00" + field(9123456, 30) + text("CALL", 7) + text(name, 20) + field(code, 8) + field(100, 9) + field(50, 9) + field(10, 6) + field(12, 6)
            + "0000" + field(7, 4) + field(15, 5) + field(8, 5) + field(30, 6) + field(85, 8) + text("MUMBAI", 20) + "00")


def decode(spark, tmp_path, lines):
    (tmp_path / "a.nmea").write_text("\n".join(lines))
    return nmea.nmea_messages(spark, str(tmp_path)).collect()


def test_known_sentences(spark, tmp_path):
    lines = ["!AIVDM,1,1,,A,16?Ug>hP1uU=JOh:mSl9TWVt2000,0*19", "!AIVDM,1,1,,B,B6?UhR00B?rAjPOnn40pCwWWh000,0*22", "!AIVDM,1,1,,A,15N4cJ`005Jrek0H@9n`DW5608EP,0*13", "", "noise", "!AIVDM,1,1*00"]
    one, two = sorted(decode(spark, tmp_path, lines), key=lambda r: r.message_type)
    assert (one.mmsi, one.nav_status_text, one.rate_of_turn, one.speed_over_ground, one.position_accuracy) == ("419000123", "Under way using engine", None, 12.5, True)
    assert (one.longitude, one.latitude, one.course_over_ground, one.true_heading, one.timestamp_seconds) == (72.8354, 18.9388, 245.0, 243, 30)
    assert (two.message_type, two.mmsi, two.speed_over_ground, two.longitude, two.latitude, two.course_over_ground, two.true_heading) == (18, "419000456", 7.2, -5.0, -1.0, 90.0, None)


def test_positions_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    lines, want = [], {}
    for k in range(60):
        mmsi, rot, sog, cog, heading = 200_000_000 + k, rnd.randint(-128, 127), rnd.randint(0, 1023), rnd.randint(0, 3700), rnd.randint(0, 511)
        lon, lat = rnd.randint(-108_000_000, 108_000_000), rnd.randint(-54_000_000, 54_000_000)
        payload, fill = armour(position(mmsi, rot, sog, lon, lat, cog, heading, rnd.choice([1, 2, 3])))
        lines.append(sentence(payload, fill))
        turn = None if rot == -128 else (rot / 4.733) ** 2 * (-1 if rot < 0 else 1)
        want[str(mmsi)] = (turn, sog / 10 if sog < 1022 else None, lon / 600000, lat / 600000, cog / 10 if cog < 3600 else None, heading if heading < 511 else None)
    for r in decode(spark, tmp_path, lines):
        got = (r.rate_of_turn, r.speed_over_ground, r.longitude, r.latitude, r.course_over_ground, r.true_heading)
        assert got == pytest.approx(want.pop(r.mmsi)) and not r.truncated
    assert not want


def test_parts_and_other_messages(spark, tmp_path):
    whole, fill = armour(static(419000001, "OCEAN STAR", 74))
    other, other_fill = armour(static(419000002, "SECOND", 37))
    lines = [
        sentence(whole[:40], 0, 2, 1, "3"), sentence(other[40:], other_fill, 2, 2, "4"), sentence(whole[40:], fill, 2, 2, "3"), sentence(other[:40], 0, 2, 1, "4"),
        sentence(whole[:40], 0, 2, 1, "3"),  # never completed
        sentence(armour(field(4, 6) + "0" * 162)[0]), sentence(armour(position(1, 0, 0, 0, 0, 0, 0)[:60])[0]), sentence("1~6")]
    rows = decode(spark, tmp_path, lines)
    first, second = sorted((r for r in rows if r.message_type == 5), key=lambda r: r.mmsi)
    assert (first.ship_name, first.ship_type_text, first.length, first.width, first.draught, first.destination, first.imo, first.callsign) == ("OCEAN STAR", "Cargo", 150, 22, 8.5, "MUMBAI", 9123456, "CALL")
    assert (first.eta_month, first.eta_day, first.eta_hour, first.eta_minute, first.error) == (7, 15, 8, 30, None)
    assert second.ship_name == "SECOND" and second.ship_type_text == "Fishing"
    assert sum(r.message_type == 4 and r.mmsi is None for r in rows) == 1 and sum(bool(r.truncated) for r in rows) == 2
    short = nmea.decode_nmea(spark.createDataFrame([("s", 1, armour(static(1, "X", 0)[:300])[0], 0, "raw")], "source string, at long, payload string, fill_bits int, raw_sentence string")).first()
    assert short.error == "incomplete" and short.mmsi is None


def buffered(rows):
    """One buffer a lane, part by part."""
    buffers, found = {}, []
    for source, at, number, total, seq, payload in sorted(rows, key=lambda r: r[1]):
        own = buffers.setdefault((source, seq, total), [""] * total)
        own[number - 1] = payload
        if all(own):
            found.append((source, at, "".join(own)))
            del buffers[source, seq, total]
    return sorted(found)


def lossy(seed, n, totals=(2, 3, 5)):
    """Messages in parts, of which some get lost, come twice or change places."""
    rnd = random.Random(seed)
    sent = []
    for k in range(n):
        total, seq, source = rnd.choice(totals), str(rnd.randint(0, 3)), rnd.choice("xy")
        sent += [(source, number, total, seq, f"{number}m{k}.") for number in range(1, total + 1)]
    kept = [s for s in sent for _ in range(rnd.choice([0, 1, 1, 1, 1, 1, 1, 1, 2]))]
    for k in range(0, len(kept) - 1, 7):
        kept[k], kept[k + 1] = kept[k + 1], kept[k]
    return [(source, at, number, total, seq, payload) for at, (source, number, total, seq, payload) in enumerate(kept)]


def test_block_effects_against_a_buffer():
    rnd = random.Random(3)
    for _ in range(2000):
        total = rnd.randint(2, 5)
        numbers = [rnd.randint(1, total) for _ in range(rnd.randint(1, 14))]
        held = rnd.sample(range(1, total + 1), rnd.randint(0, total - 1))
        now = set(held)
        for number in numbers:
            now.add(number)
            now = set() if len(now) == total else now
        assert nmea.after_block(held, total, *nmea.block_effect(numbers, total)) == sorted(now)


@pytest.mark.parametrize("seed, n, bits", [(1, 3500, 16), (1, 3500, 9), (2, 300, 3), (3, 120, 1), (4, 120, 0)])
def test_lossy_lanes_equal_a_buffer(spark, seed, n, bits):
    rows = lossy(seed, n)
    more = [("x", 10**6, 7, 5, "0", "beyond"), ("x", 10**6 + 1, 0, 2, "0", "below"), ("x", 10**6 + 2, 1, 2, "0", "")]
    df = spark.createDataFrame([(s, a, f"line {a}", t, k, q, "A", p, a % 6) for s, a, k, t, q, p in rows + more], "source string, at long, line string, total int, number int, seq_id string, channel string, payload string, fill_bits int")
    got = nmea.assemble_nmea(df.repartition(4), bits).collect()
    assert sorted((r.source, r.at, r.payload) for r in got) == buffered(rows)
    assert all(r.raw_sentence == f"line {r.at}" and r.fill_bits == r.at % 6 for r in got)


def test_lost_sentences(spark):
    parts = [(1, "1a"), (1, "1b"), (2, "2b"), (2, "2c"), (1, "1d"), (2, "2d")]
    df = spark.createDataFrame([("s", k, "l", 2, n, "3", None, p, 0) for k, (n, p) in enumerate(parts)], "source string, at long, line string, total int, number int, seq_id string, channel string, payload string, fill_bits int")
    assert [r.payload for r in nmea.assemble_nmea(df).orderBy("at").collect()] == ["1b2b", "1d2c"]


def update(track=12345, at=1765809000):
    return struct.pack(">HHIIiiHHfHHBB", 0x0100, 34, at, track, 18938800, 72835400, 125, 2450, 25.5, 153, 900, 85, 0)


def test_radar(spark, tmp_path):
    assert update().hex() == "0100002269401b68000030390120fbb004576148007d099241cc0000009903845500"
    lost = struct.pack(">HHIIiiB3x", 0x0101, 24, 7, 9, -5_000_000, -1, 3)
    status = struct.pack(">HHI8sBHf5x", 0x0200, 28, 8, b"RAD-MUM\0", 1, 42, 12.5)
    beat = struct.pack(">HHI", 0x0300, 8, 9)
    zero = struct.pack(">HHI", 0x0100, 0, 9)
    (tmp_path / "a.bin").write_bytes(update() + b"\x7f" + lost + zero + status + beat + update(7) + update()[:20])
    frames = radar.read_radar(spark, str(tmp_path))
    one, two = radar.decode_track_update(frames).orderBy("at").collect()
    assert (one.track_id, one.latitude, one.longitude, one.speed_knots, one.course, one.rcs_dbsm, one.range_nm, one.bearing, one.quality) == ("TRK-00012345", 18.9388, 72.8354, 12.5, 245.0, 25.5, 15.3, 90.0, 85)
    assert one.ts.timestamp() == 1765809000 and two.track_id == "TRK-00000007"
    gone = radar.decode_track_lost(frames).first()
    assert (gone.track_id, gone.last_latitude, gone.last_longitude, gone.reason_text) == ("TRK-00000009", -5.0, -1e-6, "Out of range")
    station = radar.decode_system_status(frames).first()
    assert (station.station_id, station.operational, station.tracks_active, station.rotation_rpm) == ("RAD-MUM", True, 42, 12.5)
    assert radar.decode_heartbeat(frames).count() == 1


def stream_of_frames(rnd, n):
    """Frames of all types with junk, broken headers and long frames between, and text that a reader may trip over."""
    out = [rnd.choice([b"", b"\xef\xbb\xbf"])]
    for k in range(n):
        long = rnd.choice([34, 34, 34, 60, 400, 3000, 65_535 if k % 97 == 0 else 90])
        out.append(rnd.choice([
            struct.pack(">HHIIiiHHfHHBB", 0x0100, long, k, k, 10 * k, 256 * 10, 125, 2450, 25.5, 153, 900, 85, 0) + bytes(rnd.choices([10, 13, 1, 0, 255], k=long - 34)),
            struct.pack(">HHIIiiB3x", 0x0101, 24, k, 9, -5, 10, 3), struct.pack(">HHI", 0x0300, 8, 0x0A0A0A0A), struct.pack(">HHI", 0x0100, 20, k), struct.pack(">HHI", 0x0100, 3, k),
            b"\n\n", b"\r\n", bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 30))), b"\x01\x00", b"\x00" * 9]))
    return b"".join(out)


def test_block_exits_against_a_scan():
    rnd = random.Random(5)
    for _ in range(60):
        data = stream_of_frames(rnd, 12)[:700]
        size = rnd.randint(1, len(data))
        found = radar.block_exits(data, size, True)
        for entry in range(len(found)):
            at, ended = entry, False
            while at < size and not ended:
                kind, length = struct.unpack_from(">HH", data, at) if at + 8 <= len(data) else (None, 0)
                least = radar.LEAST.get(kind)
                if kind is None or (least and length >= 8 and at + length > len(data)):
                    ended = True
                else:
                    at += length if least and length >= max(8, least) else 1
            assert found[entry] == (radar.ENDED if ended else at - size)


@pytest.mark.parametrize("block", [70_000, 1 << 20])
def test_radar_files_in_splits(spark, tmp_path, block):
    rnd = random.Random(block)
    contents = {name: stream_of_frames(rnd, n) for name, n in (("a.bin", 1500), ("b c.bin", 700), ("tail.bin", 300))}
    contents["tail.bin"] += struct.pack(">HHI", 0x0100, 400, 1) + b"\n\n"
    contents["feeds.bin"] = b"\n" * 90_000 + update() + b"\n"
    contents["small.bin"] = update() + update(7)
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = radar.read_radar(spark, str(tmp_path), 1000, block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    from urllib.parse import unquote

    found = {}
    for r in got:
        found.setdefault(unquote(r.source).rsplit("/", 1)[-1], []).append((r.at, r.message_type, r.epoch, bytes(r.frame), repr(r.float_value)))
    for name, data in contents.items():
        want = [(at, kind, epoch, frame, repr(None if x != x else x)) for at, kind, epoch, frame, x in radar.find_frames(data)]  # no number is null
        assert sorted(found.get(name, [])) == want, name


def test_satellite(spark, tmp_path):
    properties = {"detection_id": "D1", "timestamp": "2025-01-01T10:00:00Z", "confidence": 0.9, "vessel_length_m": 120.0, "is_dark_ship": True}
    features = [{"type": "Feature", "id": "F1", "geometry": {"type": "Point", "coordinates": [72.5, 18.5]}, "properties": properties},
                {"type": "Feature", "id": "F2", "geometry": {"coordinates": [72.5, 18.5]}, "properties": {"timestamp": "2025-01-01T10:00:00+00:00"}},
                {"type": "Feature", "id": "F3", "geometry": {"coordinates": [72.5]}, "properties": properties}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "metadata": {"pass_id": "P1", "satellite": "Sentinel-1A", "sensor_type": "SAR"}, "features": features}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"type": "Other", "features": features}))
    head = "pass_id,satellite,detection_id,timestamp,latitude,longitude,confidence,length_m,width_m,orientation,is_dark_ship,detection_method\n"
    (tmp_path / "c.csv").write_text(head + "P2,S2,C1,2025-01-01T11:00:00Z,10,70,0.5,,12.5,,Yes,cv\nP2,S2,C2,2025-01-01T11:00:00Z,10,70,,1,1,1,no,cv\nP2,S2,C3,2025-01-01T11:00:00Z,10,70,0.4,x,1,1,no,cv\n")
    rows = {r.detection_id: r for r in satellite.read_satellite(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"D1", "F2", "C1"}
    assert (rows["D1"].latitude, rows["D1"].longitude, rows["D1"].is_dark_ship, rows["D1"].pass_id, rows["D1"].sensor_type) == (18.5, 72.5, True, "P1", "SAR")
    assert (rows["F2"].confidence, rows["F2"].is_dark_ship) == (0.5, False) and rows["D1"].ts == rows["F2"].ts
    assert (rows["C1"].vessel_length_m, rows["C1"].vessel_width_m, rows["C1"].is_dark_ship) == (None, 12.5, True)
    assert [r.type for r in satellite.rejected_passes(satellite.read_passes(spark, str(tmp_path))).collect()] == ["Other"]
    with pytest.raises(ValueError):
        satellite.read_satellite(spark, "x.txt")


def test_feeds_and_union(spark, tmp_path):
    frame = {"frame_id": "F", "timestamp": "2025-01-01T00:00:00Z", "drone": {"drone_id": "DRN-001", "position": {"latitude": 1.0, "longitude": 2.0}}, "detections": [
        {"detection_id": "X", "class": "tanker", "confidence": 0.8, "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "geo_position": {"latitude": 1.5, "longitude": 2.5}, "estimated_dimensions": {"length_m": 0.0}}, {"detection_id": "Y"}]}
    for name, content in (("drone/a.json", json.dumps(frame)), ("drone/b.json", "{not json"), ("ais/a.json", "\n".join(map(json.dumps, [
            {"MessageType": "PositionReport", "Message": {"PositionReport": {"UserID": 5, "Latitude": 3.0, "Longitude": 4.0, "Sog": 0.0, "Cog": 90.0}}, "MetaData": {"ShipName": "A", "time_utc": "2025-01-01T00:00:00Z"}},
            {"MessageType": "ShipStaticData", "Message": {"ShipStaticData": {"Name": "B", "ImoNumber": 7, "Type": 70, "Dimension": {"A": 10, "B": 20}}}, "MetaData": {"MMSI": 6}},
            {"MessageType": "Unknown"}]))), ("w/a.json", json.dumps({"location": {"name": "Mumbai", "lat": 1, "lon": 2}, "current_weather": {"time": "2025-01-01T00:00", "temperature": 30.5, "windspeed": 8}})),
            ("docs/a.json", json.dumps([{"content": "text", "metadata": {"type": "ship_report"}}, {"content": "other"}])), ("h/a.csv", "mmsi,ship_name,ship_type,timestamp,latitude,longitude,speed_knots,heading,origin_port,destination_port,status,anomaly_flag,anomaly_type\n1,A,cargo,2025-01-01 05:00:00,1,2,3,4,X,Y,ok,True,gap\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    drone = feeds.read_drone(spark, str(tmp_path / "drone"))
    assert {(r.detection_id, r.object_class, r.confidence, r.latitude) for r in drone.collect()} == {("X", "tanker", 0.8, 1.5), ("Y", "unknown", 0.0, 0.0)}
    ais = feeds.read_ais_json(spark, str(tmp_path / "ais"))
    assert {(r.mmsi, r.ship_name, r.vessel_length_m, r.ship_type) for r in ais.collect()} == {("5", "A", None, None), ("6", "B", 30.0, "70")}
    assert feeds.read_weather(spark, str(tmp_path / "w")).first().source == "open-meteo:Mumbai"
    assert [r.document_type for r in feeds.read_documents(spark, str(tmp_path / "docs")).collect()] == ["ship_report", "unknown"]
    assert feeds.read_ais_history(spark, str(tmp_path / "h")).first().anomaly_flag is True
    contacts = spark.createDataFrame([("T1", 5, 1.0, 2.0, 3.0, 0.0)], "track_id string, quality int, latitude double, longitude double, speed_knots double, course double").withColumn("ts", F.current_timestamp())
    rows = {(r.sensor, r.detection_id): r for r in unify.unify(ais=ais, radar=contacts, drone=drone).collect()}
    assert rows["radar", None].sensor_id == "RADAR" and rows["radar", None].local_track_id == "T1" and rows["radar", None].course is None
    assert rows["drone", "X"].sensor_id == "DRN-001" and rows["drone", "X"].vessel_length_m is None and rows["drone", "Y"].confidence is None
    assert len(rows) == 4


def test_each_line_is_made_at_most_twice(spark):
    """Once for the parts and once for whole sentences, however many types and checks look at it."""
    made = spark.sparkContext.accumulator(0)
    texts = [sentence(armour(static(n, "NAME", 70))[0], 2) if n % 3 == 0 else sentence(armour(position(n, 0, 10, 0, 0, 0, 0, 18 if n % 3 == 1 else 1))[0]) for n in range(90)]

    @F.udf("string")
    def line(n):
        made.add(1)
        return texts[n]

    lines = spark.range(90, numPartitions=2).select(F.lit("f").alias("source"), F.col("id").alias("at"), line("id").alias("line"))
    found = nmea.decode_nmea(nmea.assemble_nmea(nmea.split_nmea(lines))).groupBy("message_type").count().collect()
    assert {r.message_type: r["count"] for r in found} == {1: 30, 5: 30, 18: 30}
    assert made.value <= 180


def test_split_reads_odd_lines(spark):
    good = "!AIVDM,1,1,,A,16?Ug>hP1uU=JOh:mSl9TWVt2000,0"

    def checked(body, tail=""):
        check = 0
        for c in body[1:]:
            check ^= ord(c)
        return f"{body}*{check & 255:02x}{tail}"

    lines = [checked(good, " \t"), checked(good.replace(",1,1,", ", +1 ,01,")), checked(good.replace(",1,1,", ",9999999999,1,")), checked(good.replace(",1,1,", ",1.0,1,")), checked(good[:-2]), checked(good.replace("A", "Å", 1)),
             None, "", "!*00", "!", good, checked(good.replace(",,", ",7,")), checked(good + ",more")]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "source string, at long, line string")
    got = {r["at"]: (r.total, r.number, r.seq_id, r.channel, r.fill_bits) for r in nmea.split_nmea(df).collect()}
    assert got == {0: (1, 1, "default", "A", 0), 1: (1, 1, "default", "A", 0), 5: (1, 1, "default", "A", 0), 11: (1, 1, "7", "A", 0), 12: (1, 1, "default", "A", 0)}
    assert {r["at"] for r in df.where(nmea.nmea_checksum_ok(F.col("line"))).collect()} >= set(got)
