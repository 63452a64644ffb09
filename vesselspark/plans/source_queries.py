"""Registered queries of the sources: the adapter's positions are written in each wire form by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions import geo
from vesselspark.operators import sinks
from vesselspark.plans.adapter import positions
from vesselspark.plans.queries import P, query
from vesselspark.sources import feeds, nmea, radar, satellite, unify

BEGIN = "1970-01-01 00:00:00"


def let(value: Column, make) -> Column:
    """What ``make`` makes of a value that is worked out once."""
    return F.transform(F.array(value), make)[0]


def field(value: Column, width: int) -> Column:
    """A number that is not negative as so many bits."""
    return F.lpad(F.bin(value.cast("long")), width, "0")


def armoured(bits: Column, chars: int) -> Column:
    """Binary digits as six-bit characters, which are those of base 64 in another alphabet; by words of eight characters."""
    word = lambda k: F.lpad(F.conv(F.rpad(F.substring(bits, k * 48 + 1, 48), 48, "0"), 2, 16), 12, "0")
    coded = F.base64(F.unhex(F.concat(*(word(k) for k in range(-(-chars // 8))))))
    return F.translate(F.substring(coded, 1, chars), nmea.BASE64, nmea.ARMOUR)


def sentence(body: Column) -> Column:
    check = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a.bitwiseXOR(x))
    return F.concat(F.lit("!"), body, F.lit("*"), F.lpad(F.hex(check), 2, "0"))


def nmea_lines(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    i = F.col("event_id")
    bits = F.concat(
        field(F.lit(1), 6), F.lit("00"), field(F.col("mmsi"), 30), field(i % 16, 4), field(i % 256, 8), field(F.round(F.col("speed_knots") * 10), 10), field(i % 2, 1), field(F.round(F.col("longitude") * 600000), 28),
        field(F.round(F.col("latitude") * 600000), 27), field(F.col("course") * 10, 12), field(i % 512, 9), field(i % 60, 6), F.repeat(F.lit("0"), F.lit(25)))
    whole = p.withColumn("bits", bits).withColumn("payload", armoured(F.col("bits"), 28))
    # half of the messages come in two parts; of the others one in eleven has a wrong check digit and is to be left out
    two = i % 2 == 0
    bodies = F.when(two, F.array(
        F.concat(F.lit("AIVDM,2,1,"), (i % 10).cast("string"), F.lit(",A,"), F.substring("payload", 1, 15), F.lit(",0")),
        F.concat(F.lit("AIVDM,2,2,"), (i % 10).cast("string"), F.lit(",A,"), F.substring("payload", 16, 13), F.lit(",0"))
    )).otherwise(F.array(F.concat(F.lit("AIVDM,1,1,,B,"), "payload", F.lit(",0"))))
    parts = whole.select("event_id", F.posexplode(bodies).alias("n", "body")).withColumn("line", let(F.col("body"), sentence))
    wrong = (i % 11 == 0) & (i % 2 == 1)
    line = F.when(wrong, F.concat(F.expr("substring(line, 1, length(line) - 2)"), F.lit("ZZ"))).otherwise(F.col("line"))
    return parts.select(F.concat(F.lit("f"), (i % 7).cast("string")).alias("source"), (i * 2 + F.col("n")).alias("at"), line.alias("line"))


#: Rate of turn: the number sent is 4.733 times the root of degrees a minute, signed; 128 stands for none.
TURN_SQL = "CASE WHEN event_id % 256 < 128 THEN power((event_id % 256) / 4.733, 2) WHEN event_id % 256 > 128 THEN -power((event_id % 256 - 256) / 4.733, 2) END"
STATUS_SQL = "CASE event_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in config.NAV_STATUS.items()) + " ELSE 'Unknown' END"


@query("d5_nmea_positions", f"""WITH {P} SELECT mmsi, cast(event_id % 16 AS INT) AS nav_status, {STATUS_SQL} AS nav_status_text, round({TURN_SQL}, 9) AS rate_of_turn, round(speed_knots * 10) / 10 AS speed_over_ground, event_id % 2 = 1 AS position_accuracy,
  round(longitude * 600000) / 600000 AS longitude, round(latitude * 600000) / 600000 AS latitude, course AS course_over_ground, cast(CASE WHEN event_id % 512 < 511 THEN event_id % 512 END AS INT) AS true_heading,
  cast(event_id % 60 AS INT) AS timestamp_seconds FROM p WHERE event_id % 22 <> 11""")
def _(spark, d):
    return position_columns(nmea.decode_nmea(nmea.assemble_nmea(nmea.split_nmea(nmea_lines(spark, d)))))


def position_columns(found: DataFrame) -> DataFrame:
    return found.select("mmsi", "nav_status", "nav_status_text", F.round("rate_of_turn", 9).alias("rate_of_turn"), "speed_over_ground", "position_accuracy", "longitude", "latitude", "course_over_ground", "true_heading", "timestamp_seconds")


#: Of the parts in two, one in seven is lost and one in thirteen comes twice. A run is the same number again and again; the
#: first of a run completes a message if the buffer holds the other number, which it does after a run of several, and in
#: every other one of a row of runs of one.
LOSSY = f"""WITH {P},
half AS (SELECT event_id, unnest([1, 2]) AS n FROM p WHERE event_id % 2 = 0),
sent AS (SELECT event_id, n, unnest(generate_series(1, CASE WHEN (event_id * 2 + n) % 7 = 3 THEN 0 WHEN (event_id * 2 + n) % 13 = 5 THEN 2 ELSE 1 END)) AS again FROM half),
lane AS (SELECT event_id % 7 AS source, event_id % 10 AS seq, n, event_id, event_id * 4 + n * 2 + again AS pos FROM sent),
run AS (SELECT *, sum(new) OVER (PARTITION BY source, seq ORDER BY pos) AS run
  FROM (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY source, seq ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lane)),
each AS (SELECT source, seq, run, any_value(n) AS n, count(*) AS size, min_by(event_id, pos) AS first_event, max_by(event_id, pos) AS last_event, min(pos) AS pos FROM run GROUP BY source, seq, run),
held AS (SELECT *, lag(size, 1, 1) OVER w AS before_size, lag(last_event) OVER w AS other FROM each WINDOW w AS (PARTITION BY source, seq ORDER BY run)),
since AS (SELECT *, max(CASE WHEN before_size > 1 OR run = 1 THEN run END) OVER (PARTITION BY source, seq ORDER BY run) AS start FROM held),
whole AS (SELECT *, CASE WHEN start = 1 THEN (run - start) % 2 = 1 ELSE (run - start) % 2 = 0 END AS done FROM since)
SELECT 'f' || source AS source, pos, CASE n WHEN 1 THEN first_event ELSE other END AS first_part, CASE n WHEN 2 THEN first_event ELSE other END AS second_part FROM whole WHERE done"""


@query("d3_lossy_lanes", LOSSY)
def _(spark, d):
    """Parts carry their event's number in place of a payload, so the result tells which parts were joined."""
    i, n = F.col("event_id"), F.col("n")
    half = positions(spark, d).where("event_id % 2 = 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    copies = F.when((i * 2 + n) % 7 == 3, 0).when((i * 2 + n) % 13 == 5, 2).otherwise(1)
    sent = half.select("event_id", "n", F.explode(F.filter(F.sequence(F.lit(0), copies), lambda k: k > 0)).alias("again"))
    body = F.concat(F.lit("AIVDM,2,"), n.cast("string"), F.lit(","), (i % 10).cast("string"), F.lit(",A,"), F.lpad(i.cast("string"), 12, "0"), F.lit(",0"))
    lines = sent.select(F.concat(F.lit("f"), (i % 7).cast("string")).alias("source"), (i * 4 + n * 2 + F.col("again")).alias("at"), let(body, sentence).alias("line"))
    found = nmea.assemble_nmea(nmea.split_nmea(lines), 12)
    return found.select("source", F.col("at").alias("pos"), F.substring("payload", 1, 12).cast("long").alias("first_part"), F.substring("payload", 13, 12).cast("long").alias("second_part"))


@query("d1_nmea_checksums", f"WITH {P} SELECT event_id % 22 <> 11 AS ok, sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM p GROUP BY ALL")
def _(spark, d):
    return nmea_lines(spark, d).groupBy(nmea.nmea_checksum_ok(F.col("line")).alias("ok")).agg(F.count("*").alias("n"))


def text_field(value: Column, chars: int) -> Column:
    """Capitals, digits and blanks as six-bit characters, filled up."""
    coded = F.translate(F.rpad(value, -(-chars // 8) * 8, "@"), nmea.TEXT, nmea.BASE64)
    word = lambda k: field(F.conv(F.hex(F.unbase64(F.substring(coded, k * 8 + 1, 8))), 16, 10), 48)
    return F.substring(F.concat(*(word(k) for k in range(-(-chars // 8)))), 1, chars * 6)


def whole_sentences(spark: SparkSession, d: str, bits: Column, chars: int, fill: int) -> DataFrame:
    body = F.concat(F.lit("AIVDM,1,1,,A,"), armoured(F.col("bits"), chars), F.lit(f",{fill}"))
    return positions(spark, d).withColumn("bits", bits).select(F.lit("f").alias("source"), F.col("event_id").alias("at"), let(body, sentence).alias("line"))


@query("d6_static_messages", f"""WITH {P} SELECT mmsi, cast(9000000 + event_id % 1000000 AS INT) AS imo, 'C' || event_id % 1000 AS callsign, ship_name, cast(event_id % 100 AS INT) AS ship_type, cast(event_id % 400 + event_id % 100 AS INT) AS length, cast(event_id % 30 + 7 AS INT) AS width,
  cast(event_id % 12 + 1 AS INT) AS eta_month, cast(event_id % 60 AS INT) AS eta_minute, (event_id % 256) / 10 AS draught, 'PORT ' || event_id % 77 AS destination FROM p""")
def _(spark, d):
    i = F.col("event_id")
    bits = F.concat(
        field(F.lit(5), 6), F.lit("00"), field(F.col("mmsi"), 30), F.lit("00"), field(9000000 + i % 1000000, 30), text_field(F.concat(F.lit("C"), (i % 1000).cast("string")), 7), text_field(F.col("ship_name"), 20), field(i % 100, 8),
        field(i % 400, 9), field(i % 100, 9), field(i % 30, 6), field(F.lit(7), 6), F.lit("0001"), field(i % 12 + 1, 4), field(i % 28 + 1, 5), field(i % 24, 5), field(i % 60, 6), field(i % 256, 8),
        text_field(F.concat(F.lit("PORT "), (i % 77).cast("string")), 20), F.lit("0000"))
    found = nmea.decode_nmea(nmea.assemble_nmea(nmea.split_nmea(whole_sentences(spark, d, bits, 71, 2))))
    return found.select("mmsi", "imo", "callsign", "ship_name", "ship_type", "length", "width", "eta_month", "eta_minute", "draught", "destination")


@query("d7_class_b_messages", f"""WITH {P} SELECT mmsi, round(speed_knots * 10) / 10 AS speed_over_ground, round(longitude * 600000) / 600000 AS longitude, round(latitude * 600000) / 600000 AS latitude, course AS course_over_ground,
  cast(CASE WHEN event_id % 512 < 511 THEN event_id % 512 END AS INT) AS true_heading FROM p""")
def _(spark, d):
    i = F.col("event_id")
    bits = F.concat(
        field(F.lit(18), 6), F.lit("00"), field(F.col("mmsi"), 30), F.lit("00000000"), field(F.round(F.col("speed_knots") * 10), 10), F.lit("1"), field(F.round(F.col("longitude") * 600000), 28), field(F.round(F.col("latitude") * 600000), 27),
        field(F.col("course") * 10, 12), field(i % 512, 9), F.repeat(F.lit("0"), F.lit(35)))
    found = nmea.decode_nmea(nmea.assemble_nmea(nmea.split_nmea(whole_sentences(spark, d, bits, 28, 0))))
    return found.select("mmsi", "speed_over_ground", "longitude", "latitude", "course_over_ground", "true_heading")


def number(value: Column, digits: int) -> Column:
    """Hex of a whole number that is not negative."""
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def radar_files(spark: SparkSession, d: str) -> DataFrame:
    """A hundred frames a file: updates, for every seventh detection a lost track, and a byte of noise between."""
    p = positions(spark, d).where("sensor = 'radar'")
    i = F.col("event_id")
    seconds = F.timestamp_diff("SECOND", F.lit(BEGIN).cast("timestamp_ntz"), F.col("ts"))
    place = F.concat(number(F.round(F.col("latitude") * 1e6), 8), number(F.round(F.col("longitude") * 1e6), 8))
    update = F.concat(F.lit("01000022"), number(seconds, 8), number(i, 8), place, number(F.round(F.col("speed_knots") * 10), 4), number(F.col("course") * 10, 4), F.lit("41CC0000"), number(i % 600, 4), number(i % 3600, 4), number(i % 101, 2), F.lit("00"))
    lost = F.when(i % 7 == 0, F.concat(F.lit("01010018"), number(seconds, 8), number(i, 8), place, number(i % 5, 2), F.lit("000000"))).otherwise("")
    noise = F.when(i % 3 == 0, "7F").otherwise("")
    frames = p.select(F.floor(i / 100).alias("file"), i, F.concat(update, noise, lost).alias("frame"))
    files = frames.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "").alias("hex"))
    return files.select(F.concat(F.lit("radar-"), F.col("file").cast("string")).alias("path"), F.unhex("hex").alias("content"))


@query("d10_radar_updates", f"""WITH {P} SELECT 'TRK-' || lpad(cast(event_id AS STRING), 8, '0') AS track_id, round(latitude * 1e6) / 1e6 AS latitude, round(longitude * 1e6) / 1e6 AS longitude, round(speed_knots * 10) / 10 AS speed_knots,
  course, 25.5::DOUBLE AS rcs_dbsm, (event_id % 600) / 10 AS range_nm, (event_id % 3600) / 10 AS bearing, cast(event_id % 101 AS INT) AS quality FROM p WHERE sensor = 'radar'""")
def _(spark, d):
    found = radar.decode_track_update(radar.split_radar_frames(radar_files(spark, d)))
    return unify.to_contacts(found).select("track_id", "latitude", "longitude", "speed_knots", "course", "rcs_dbsm", "range_nm", "bearing", "quality")


@query("d11_radar_lost", f"""WITH {P} SELECT 'TRK-' || lpad(cast(event_id AS STRING), 8, '0') AS track_id, cast(event_id % 5 AS INT) AS reason,
  CASE event_id % 5 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'Merged with another track' WHEN 2 THEN 'Manual deletion' WHEN 3 THEN 'Out of range' ELSE 'Unknown' END AS reason_text FROM p WHERE sensor = 'radar' AND event_id % 7 = 0""")
def _(spark, d):
    return radar.decode_track_lost(radar.split_radar_frames(radar_files(spark, d))).select("track_id", "reason", "reason_text")


def station_files(spark: SparkSession, d: str) -> DataFrame:
    """A hundred frames a file: a status or, for every third detection, a heartbeat."""
    p, i = positions(spark, d).where("sensor = 'radar'"), F.col("event_id")
    seconds = F.timestamp_diff("SECOND", F.lit(BEGIN).cast("timestamp_ntz"), F.col("ts"))
    station = F.rpad(F.hex(F.concat(F.lit("RAD-"), (i % 100).cast("string"))), 16, "0")
    status = F.concat(F.lit("0200001C"), number(seconds, 8), station, number(i % 2, 2), number(i % 500, 4), F.lit("41480000"), F.lit("0000000000"))
    frame = F.when(i % 3 == 0, F.concat(F.lit("03000008"), number(seconds, 8))).otherwise(status)
    files = p.select(F.floor(i / 100).alias("file"), i, frame.alias("frame")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "").alias("hex"))
    return files.select(F.concat(F.lit("station-"), F.col("file").cast("string")).alias("path"), F.unhex("hex").alias("content"))


@query("d12_station_status", f"""WITH {P} SELECT date_trunc('second', ts) AS ts, 'RAD-' || event_id % 100 AS station_id, event_id % 2 = 1 AS operational, cast(event_id % 500 AS INT) AS tracks_active, 12.5::DOUBLE AS rotation_rpm FROM p WHERE sensor = 'radar' AND event_id % 3 <> 0""")
def _(spark, d):
    found = radar.decode_system_status(radar.split_radar_frames(station_files(spark, d)))
    return found.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "station_id", "operational", "tracks_active", "rotation_rpm")


@query("d13_heartbeats", f"WITH {P} SELECT 'station-' || event_id // 100 AS source, date_trunc('second', ts) AS ts FROM p WHERE sensor = 'radar' AND event_id % 3 = 0")
def _(spark, d):
    found = radar.decode_heartbeat(radar.split_radar_frames(station_files(spark, d)))
    return found.select("source", F.col("ts").cast("timestamp_ntz").alias("ts"))


def sightings(spark: SparkSession, d: str) -> DataFrame:
    missing = F.lit(None).cast("double")
    return positions(spark, d).where("sensor = 'satellite'").select(
        F.concat(F.lit("D"), F.col("event_id").cast("string")).alias("detection_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), "latitude", "longitude", "confidence", "vessel_length_m",
        missing.alias("vessel_width_m"), missing.alias("orientation_deg"), F.lit("cv").alias("detection_method"), "is_dark_ship", F.concat(F.lit("P"), F.date_format("ts", "yyyyMMdd")).alias("pass_id"), F.lit("Sentinel-1A").alias("satellite"), F.lit("SAR").alias("sensor_type"))


SIGHTING_SQL = "SELECT 'D' || event_id AS detection_id, latitude, longitude, confidence, vessel_length_m, is_dark_ship, 'P' || strftime(ts, '%Y%m%d') AS pass_id FROM p WHERE sensor = 'satellite'"
SIGHTING = ["detection_id", "latitude", "longitude", "confidence", "vessel_length_m", "is_dark_ship", "pass_id"]


@query("d14_geojson", f"WITH {P} {SIGHTING_SQL}")
def _(spark, d):
    files = sinks.detections_geojson(sightings(spark, d), F.floor(F.substring("detection_id", 2, 20).cast("long") / 100).alias("frame"))
    return satellite.geojson_features(files.select(F.from_json("value", satellite.PASS_SCHEMA).alias("f")).select("f.*")).select(*SIGHTING)


@query("d15_csv_rows", f"WITH {P} {SIGHTING_SQL} AND event_id % 5 <> 0")
def _(spark, d):
    rows = sightings(spark, d).withColumnsRenamed({"vessel_length_m": "length_m", "vessel_width_m": "width_m", "orientation_deg": "orientation"})
    text = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns if c != "ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"))
    broken = F.substring("detection_id", 2, 20).cast("long") % 5 == 0
    return satellite.csv_detections(text.withColumn("confidence", F.when(broken, "n/a").otherwise(F.col("confidence")))).select(*SIGHTING)


@query("d16_drone_frames", f"""WITH {P} SELECT event_id::STRING AS detection_id, lower(vessel_type) AS object_class, latitude, longitude, confidence, vessel_length_m AS estimated_length_m, 1::INT AS x FROM p WHERE sensor = 'drone'""")
def _(spark, d):
    box = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("width"), F.lit(4).alias("height"))
    size = F.struct(F.col("vessel_length_m").alias("length_m"), F.lit(None).cast("double").alias("width_m"))
    one = F.struct(F.col("event_id").cast("string").alias("detection_id"), F.lower("vessel_type").alias("class"), "confidence", box.alias("bbox"), F.struct("latitude", "longitude").alias("geo_position"), size.alias("estimated_dimensions"), F.lit(None).cast("string").alias("tracking_id"))
    frames = positions(spark, d).where("sensor = 'drone'").groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'").alias("timestamp"), F.floor(F.col("event_id") / 100).alias("frame")).agg(F.to_json(F.struct(F.first(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'")).alias("timestamp"), F.collect_list(one).alias("detections"))).alias("value"))
    read = frames.select(F.from_json("value", feeds.DRONE_SCHEMA).alias("f")).select("f.*")
    return feeds.drone_detections(read).select("detection_id", "object_class", "latitude", "longitude", "confidence", "estimated_length_m", F.col("bounding_box.x").alias("x"))


@query("s7_ais_messages", f"""WITH {P} SELECT mmsi, ship_name, latitude, longitude, speed_knots, course, CAST(NULL AS DOUBLE) AS vessel_length_m FROM p WHERE sensor = 'ais' AND event_id % 3 = 0
  UNION ALL SELECT mmsi, ship_name, 0.0, 0.0, NULL, NULL, cast(event_id % 200 + 5 AS DOUBLE) FROM p WHERE sensor = 'ais' AND event_id % 3 = 1""")
def _(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "PositionReport").when(i % 3 == 1, "ShipStaticData").otherwise("SafetyBroadcast")
    report = F.struct(F.col("mmsi").cast("long").alias("UserID"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), F.col("speed_knots").alias("Sog"), F.col("course").alias("Cog"))
    static = F.struct(F.col("ship_name").alias("Name"), F.struct((i % 200).alias("A"), F.lit(5).alias("B")).alias("Dimension"))
    message = F.struct(F.when(i % 3 == 0, report).alias("PositionReport"), F.when(i % 3 == 1, static).alias("ShipStaticData"))
    meta = F.struct(F.col("mmsi").cast("long").alias("MMSI"), F.col("ship_name").alias("ShipName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time_utc"))
    lines = positions(spark, d).where("sensor = 'ais'").select(F.to_json(F.struct(kind.alias("MessageType"), message.alias("Message"), meta.alias("MetaData"))).alias("value"))
    found = feeds.ais_positions(lines.select(F.from_json("value", feeds.AIS_SCHEMA).alias("m")).select("m.*"))
    return found.select("mmsi", "ship_name", "latitude", "longitude", "speed_knots", "course", "vessel_length_m")


@query("d23_pixel_to_geo", f"""WITH {P}, g AS (SELECT event_id, latitude, radians(course) AS h, (cast(event_id % 1920 AS DOUBLE) / 1920 - 0.5) * 2 * 500 * tan(radians(84.0) / 2) / (111000 * cos(radians(latitude))) AS e,
    (cast(event_id % 1080 AS DOUBLE) / 1080 - 0.5) * 2 * 500 * tan(radians(84.0) / 2) * 1080 / 1920 / 111000 AS n, longitude FROM p)
  SELECT event_id, round(latitude + n * cos(h) - e * sin(h), 7) AS latitude, round(longitude + n * sin(h) + e * cos(h), 7) AS longitude FROM g""")
def _(spark, d):
    lat, lon = geo.pixel_to_geo("latitude", "longitude", 500, "course", 84, F.col("event_id") % 1920, F.col("event_id") % 1080)
    return positions(spark, d).select("event_id", F.round(lat, 7).alias("latitude"), F.round(lon, 7).alias("longitude"))
