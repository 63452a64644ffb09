"""Aggregates, windows and top-k over position history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.functions.geo import haversine
from vesselspark.operators.filters import speed_anomalies
from vesselspark.operators.proximity import assign_regions, dimension
from vesselspark.tables import write_table

NEWEST = ("ts", "event_id")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole and fractional seconds, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def traffic_over_time(df: DataFrame, hours: int = 1, approximate: bool = False) -> DataFrame:
    """Distinct vessels and positions per interval from the first to the last one; empty intervals have zeros."""
    step = hours * 3600
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    number = F.floor(seconds / step)
    vessels = F.approx_count_distinct("mmsi") if approximate else F.count_distinct("mmsi")
    counts = df.groupBy(number.alias("bin")).agg(vessels.alias("vessels"), F.count("*").alias("positions"))
    bins = df.agg(F.min(number).alias("low"), F.max(number).alias("high")).where("low is not null")
    bins = bins.select(F.explode(F.sequence("low", "high")).alias("bin"))
    start = F.timestamp_add("SECOND", F.col("bin") * step, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    zero = F.lit(0).cast("long")
    return bins.join(counts, "bin", "left").select(start.alias("interval_start"), F.coalesce("vessels", zero).alias("vessels"), F.coalesce("positions", zero).alias("positions"))


def speed_stats_by_type(df: DataFrame) -> DataFrame:
    speed = F.col("speed_knots")
    return df.groupBy("vessel_type").agg(
        F.round(F.avg(speed), 2).alias("mean_speed"), F.round(F.stddev_samp(speed), 2).alias("std_speed"),
        F.round(F.min(speed), 2).alias("min_speed"), F.round(F.max(speed), 2).alias("max_speed"), F.count(speed).alias("n"))


def latest_n(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of a stream, ties by id."""
    return df.orderBy(*(F.desc(c) for c in NEWEST)).limit(n)


def vessels_by_type(df: DataFrame, n: int = 10_000) -> DataFrame:
    return latest_n(df, n).groupBy("vessel_type").agg(F.count_distinct("mmsi").alias("vessels")).orderBy(F.desc("vessels"), "vessel_type")


def vessels_by_region(df: DataFrame, regions: DataFrame, n: int = 10_000) -> DataFrame:
    return assign_regions(latest_n(df, n), regions).groupBy("region").agg(F.count_distinct("mmsi").alias("vessels"))


def tracks_by_type(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("track_status") == "confirmed").groupBy("vessel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vessel_type")


def stream_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sensor").agg(F.count("*").alias("messages"))


def fleet_summary(tracks: DataFrame) -> DataFrame:
    """One row: ships, dark ships, their percentage to one decimal (0 when there are none), and the bounds."""
    ships, dark = F.count("*"), F.count_if(F.coalesce("is_dark_ship", F.lit(False)))
    percent = F.when(ships > 0, F.round(dark * 100.0 / ships, 1)).otherwise(0.0)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))]
    return tracks.agg(ships.alias("ships"), dark.alias("dark_ships"), percent.alias("dark_percent"), *bounds)


def vessel_master(df: DataFrame) -> DataFrame:
    """Per vessel the latest name and type that are not null, when it was last seen, and how many positions it has."""
    order = F.struct(*NEWEST)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return df.groupBy("mmsi").agg(known("ship_name"), known("vessel_type"), F.max("ts").alias("last_seen"), F.count("*").alias("total_positions"))


def pass_summary(detections: DataFrame, satellites: DataFrame) -> DataFrame:
    """Per pass: the satellite and its properties, the time of the first row, detections and dark ones."""
    first = F.struct("ts", "detection_id")
    counts = detections.groupBy("pass_id").agg(
        F.min_by("satellite", first).alias("satellite"), F.min_by("ts", first).alias("acquisition_time"),
        F.count("*").alias("detections"), F.count_if(F.coalesce("is_dark_ship", F.lit(False))).alias("dark_detections"))
    return counts.join(dimension(satellites), "satellite", "left")


def sensor_contributions(assigned: DataFrame) -> DataFrame:
    """Per track a map by sensor of (sensor_id, last_update, measurement_count, last_position, confidence), and the sensors
    in the order in which they were first seen."""
    first, last = F.min(F.struct("ts", "event_id")), F.struct("ts", "event_id")
    each = assigned.groupBy("track_id", "sensor").agg(
        first.alias("first"), F.min_by("sensor_id", last).alias("sensor_id"), F.max("ts").alias("last_update"), F.count("*").alias("measurement_count"),
        F.max_by(F.struct("latitude", "longitude"), last).alias("last_position"), F.max("confidence").alias("confidence"))
    entry = F.struct("sensor", F.struct("sensor_id", "last_update", "measurement_count", "last_position", "confidence"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("first", "sensor"))), lambda x: x["sensor"])
    return each.groupBy("track_id").agg(F.map_from_entries(F.collect_list(entry)).alias("sensor_contributions"), in_order.alias("contributing_sensors"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, ships, first and last time, and counts by type as a map."""
    types = df.groupBy("vessel_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vessel_type", "count")))).alias("by_type"))
    whole = df.agg(F.count("*").alias("rows"), F.count_distinct("mmsi").alias("ships"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return whole.join(F.broadcast(types), F.lit(True), "left")  # one row each


def latest_positions(df: DataFrame, key: str = "mmsi") -> DataFrame:
    """The newest row of each vessel, by an aggregate that combines before the shuffle."""
    order = F.struct(*NEWEST)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("p")).select(key, "p.*")


def latest_tracks(tracks: DataFrame) -> DataFrame:
    order = F.struct("updated_at", "track_id")
    live = tracks.where("mmsi is not null and track_status <> 'dropped'")
    return live.groupBy("mmsi").agg(F.max_by(F.struct(*(c for c in live.columns if c != "mmsi")), order).alias("p")).select("mmsi", "p.*")


#: Keys of more rows than this are worked on in periods of so many seconds, so that one of very many rows is spread over
#: tasks; all others by windows over the whole key. The rows are the same either way.
SPLIT_ROWS = 1_000_000
PART_S = 30 * 86_400


def _by_size(df: DataFrame, key: str, whole: Callable[[DataFrame], DataFrame], in_parts: Callable[[DataFrame], DataFrame], split: int) -> DataFrame:
    counts = df.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("n")).where(F.col("n") > split).select("hot_key")
    if counts.isEmpty():
        return whole(df)
    hot = dimension(write_table(counts))
    same = df[key].eqNullSafe(hot.hot_key)
    return whole(df.join(hot, same, "left_anti")).unionByName(in_parts(df.join(hot, same, "left_semi")))


def _parted(df: DataFrame, key: str) -> DataFrame:
    """Rows without a time are the first part of their key."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return df.withColumns({"part_key": F.col(key), "part": F.floor(seconds / PART_S)})


def _carried(df: DataFrame, name: str, of_part: Column, before: Callable[[str], Column]) -> DataFrame:
    """``df`` of ``_parted`` with ``name``: what the parts of the key before a row's own give, by ``before`` over theirs."""
    parts = df.groupBy(F.col("part_key").alias("k"), F.col("part").alias("p")).agg(of_part.alias(name))
    earlier = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("k", "p", before(name).over(earlier).alias(name))
    return df.join(parts, df.part_key.eqNullSafe(parts.k) & df.part.eqNullSafe(parts.p)).drop("k", "p")


def _order(*keys: str, running: bool = False):
    order = Window.partitionBy(*(keys or ("part_key", "part"))).orderBy(*NEWEST)
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow) if running else order


def with_previous(df: DataFrame, key: str, *columns: str, split: int = SPLIT_ROWS) -> DataFrame:
    """``df`` with ``previous``: those columns of the row before of the same key, null for the first one. Rows without a time
    come first."""
    row = F.struct(*columns)

    def in_parts(some: DataFrame) -> DataFrame:
        found = _carried(_parted(some, key), "previous", F.max_by(row, F.struct(*NEWEST)), lambda c: F.last(c))
        return found.withColumn("previous", F.coalesce(F.lag(row).over(_order()), "previous")).drop("part_key", "part")

    return _by_size(df, key, lambda some: some.withColumn("previous", F.lag(row).over(_order(key))), in_parts, split)


def ais_gaps(df: DataFrame, hours: float = 6.0, key: str = "mmsi") -> DataFrame:
    """Consecutive fixes of a vessel more than ``hours`` apart, with where it fell silent, came back, and the jump."""
    before = with_previous(df, key, "ts", "latitude", "longitude").select(
        "*", F.col("previous.ts").alias("last_ts"), F.col("previous.latitude").alias("last_latitude"), F.col("previous.longitude").alias("last_longitude"))
    gap = seconds_between(F.col("last_ts"), F.col("ts")) / 3600.0
    jump = F.round(haversine("last_latitude", "last_longitude", "latitude", "longitude", "nm"), 2)
    found = before.withColumn("gap", gap).where(F.col("gap") > hours)
    return found.select(key, "last_ts", F.col("ts").alias("next_ts"), F.round("gap", 2).alias("gap_hours"), "last_latitude", "last_longitude",
                        F.col("latitude").alias("next_latitude"), F.col("longitude").alias("next_longitude"), jump.alias("jump_nm"))


def segment_tracks(df: DataFrame, gap_s: float = 120.0, key: str = "mmsi", split: int = SPLIT_ROWS) -> DataFrame:
    """Each row with the number of its track: a vessel silent for more than ``gap_s`` opens a new one. Rows without a time
    are of the first track."""
    opens = F.coalesce((seconds_between(F.col("previous.ts"), F.col("ts")) > gap_s).cast("int"), F.lit(0))

    def whole(some: DataFrame) -> DataFrame:
        marked = some.withColumn("previous", F.lag(F.struct("ts")).over(_order(key))).withColumn("opens", opens)
        return marked.withColumn("segment", F.sum("opens").over(_order(key, running=True))).drop("opens", "previous")

    def in_parts(some: DataFrame) -> DataFrame:
        marked = _parted(with_previous(some, key, "ts", split=0).withColumn("opens", opens).drop("previous"), key)
        found = _carried(marked, "opened", F.sum("opens"), lambda c: F.sum(c))
        segment = F.coalesce("opened", F.lit(0)) + F.sum("opens").over(_order(running=True))
        return found.withColumn("segment", segment).drop("opens", "opened", "part_key", "part")

    return _by_size(df, key, whole, in_parts, split)


def recent_speed_anomalies(df: DataFrame, n: int = 50_000, shown: int = 20, knots: float = 25.0) -> DataFrame:
    return speed_anomalies(latest_n(df, n), knots).orderBy(*(F.desc(c) for c in NEWEST)).limit(shown)


def track_ends(df: DataFrame, mmsi: str, k: int = 5) -> DataFrame:
    """The newest ``k`` rows of a vessel, and the earliest ``k`` too if it has more than twice as many rows. Each end is a
    top-k of all tasks' own, so no task sorts the vessel's rows."""
    own = df.where(F.col("mmsi") == mmsi)
    last = own.orderBy(*(F.desc(c) for c in NEWEST)).limit(k).withColumn("end", F.lit("last"))
    if own.limit(2 * k + 1).count() <= 2 * k:
        return last
    return last.unionByName(own.orderBy(*NEWEST).limit(k).withColumn("end", F.lit("first")))


def latest_alerts(alerts: DataFrame, n: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("event_timestamp"), "track_id").limit(n)


def ais_gap_asof(df: DataFrame, recent_s: float = 120.0, key: str = "mmsi", split: int = SPLIT_ROWS) -> DataFrame:
    """At each row: the vessel's last AIS fix up to then, the seconds since, and whether another sensor saw it recently. Rows
    without a time come first and see nothing."""
    kinds = {"ais": F.when(F.col("sensor") == "ais", F.col("ts")), "other": F.when(F.col("sensor") != "ais", F.col("ts"))}

    def seen(found: DataFrame, last: dict[str, Column]) -> DataFrame:
        return found.withColumns({
            "ais_last_seen": last["ais"], "ais_gap_seconds": seconds_between(last["ais"], F.col("ts")),
            "recent_non_ais": F.coalesce(seconds_between(last["other"], F.col("ts")) < recent_s, F.lit(False))})

    def in_parts(some: DataFrame) -> DataFrame:
        found = _parted(some, key)
        for name, ts in kinds.items():
            found = _carried(found, f"{name}_before", F.max(ts), lambda c: F.max(c))
        last = {name: F.greatest(F.max(ts).over(_order(running=True)), f"{name}_before") for name, ts in kinds.items()}
        return seen(found, last).drop("part_key", "part", "ais_before", "other_before")

    whole = {name: F.max(ts).over(_order(key, running=True)) for name, ts in kinds.items()}
    return _by_size(df, key, lambda some: seen(some, whole), in_parts, split)
