"""Re-ranking by age, encounters, shared ports, satellite sightings without AIS, weather at ships, window summaries and the
table of all alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.functions.geo import haversine
from vesselspark.operators.history import ais_gaps, seconds_between
from vesselspark.operators.proximity import KM_A_DEGREE, around_grid, cells, dimension, near_places, on_grid, width_of
from vesselspark.operators.vectors import cosine
from vesselspark.tables import write_table

MICROS = 1_000_000


def recency_rank(docs: DataFrame, query: list[float], now: datetime, k: int = 10, half_life_h: float = 24.0, daily: float | None = None) -> DataFrame:
    """The nearest 3k, ordered by similarity times what is left after their age: a half each half life, or ``daily`` a day."""
    near = docs.withColumn("similarity", cosine("embedding", query)).orderBy(F.desc("similarity"), "id").limit(3 * k)
    hours = seconds_between(F.col("ts"), F.lit(now).cast("timestamp_ntz")) / 3600.0
    left = F.pow(F.lit(daily), hours / 24.0) if daily else F.pow(F.lit(0.5), hours / half_life_h)
    return near.withColumn("score", F.col("similarity") * left).orderBy(F.desc("score"), "id").limit(k)


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


#: A cell and period with more fixes than this is split: one side is salted, the other copied to each salt.
CROWDED = 2000


def _salted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: rows of the left dealt to as many salts as their cell needs, rows of the right in each."""
    cell = ["cell_row", "cell_column", "period"]
    crowded = left.groupBy(*cell).count().where(F.col("count") > CROWDED).select(*cell, F.ceil(F.col("count") / CROWDED).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    # by what a row is, not where it stands: a task that runs again deals its rows as before
    left = left.join(crowded, cell, "left").withColumn("salt", F.pmod(F.xxhash64("mmsi", "ts", "latitude", "longitude"), salts)).drop("salts")
    right = right.join(crowded, cell, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return left, right


def _in_cells(df: DataFrame, km: float, seconds: float) -> DataFrame:
    return on_grid(df, "latitude", "longitude", km).withColumn("period", F.floor(_micros("ts") / int(seconds * MICROS)))


def _around(df: DataFrame, km: float, seconds: float) -> DataFrame:
    """``df(b_ts, b_lat, b_lon, ...)`` in each cell and period that may hold something close."""
    periods = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(_micros("b_ts") / int(seconds * MICROS)) + k)
    return around_grid(df, "b_lat", "b_lon", km).withColumn("period", F.explode(periods))


def _is_close(km: float, seconds: float) -> Column:
    near = haversine("latitude", "longitude", "b_lat", "b_lon") <= km
    return near & (F.abs(_micros("ts") - _micros("b_ts")) <= int(seconds * MICROS))


def encounters(df: DataFrame, km: float = 10.0, hours: float = 1.0) -> DataFrame:
    """Pairs of vessels with fixes close in place and time: how many pairs of fixes, the first time, the least distance.
    A fix meets those of its own period and the next one in the cells around it, so a pair of fixes meets once: in the
    period of the earlier one or, within a period, from the side of the smaller MMSI."""
    seconds = hours * 3600
    own = df.select("mmsi", "ts", "latitude", "longitude").where("mmsi is not null")
    left = _in_cells(own, km, seconds).withColumn("at", F.col("period"))
    other = own.select(F.col("mmsi").alias("other"), F.col("ts").alias("b_ts"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"))
    other = around_grid(other, "b_lat", "b_lon", km).withColumn("at", F.floor(_micros("b_ts") / int(seconds * MICROS)))
    right = other.withColumn("period", F.explode(F.array(F.col("at"), F.col("at") - 1))).withColumnRenamed("at", "b_at")
    left, right = _salted(left, right)
    once = (F.col("mmsi") != F.col("other")) & ((F.col("b_at") != F.col("at")) | (F.col("mmsi") < F.col("other")))
    # Spark takes the copies of a fix for as few rows as there are fixes, and would send them all through the driver
    pairs = left.join(right.hint("merge"), ["cell_row", "cell_column", "period", "salt"]).where(once & _is_close(km, seconds))
    distance = haversine("latitude", "longitude", "b_lat", "b_lon")
    return pairs.groupBy(F.least("mmsi", "other").alias("mmsi"), F.greatest("mmsi", "other").alias("other")).agg(
        F.count("*").alias("meetings"), F.min(F.least("ts", "b_ts")).alias("first_ts"), F.min(distance).alias("least_km"))


def port_visits(df: DataFrame, ports: DataFrame, nm: float = 50.0) -> DataFrame:
    near = near_places(df.select("mmsi", "latitude", "longitude"), ports.select(F.col("name"), "latitude", "longitude", F.lit(float(nm)).alias("radius_nm")), "radius_nm", strict=True)
    return near.select("mmsi", F.col("place_name").alias("port")).distinct()


def ships_sharing_ports(df: DataFrame, ports: DataFrame, mmsi: str, nm: float = 50.0) -> DataFrame:
    """Other ships by the number of ports that a ship visited too."""
    visits = port_visits(df, ports, nm)
    own = visits.where(F.col("mmsi") == mmsi).select("port")
    return visits.where(F.col("mmsi") != mmsi).join(dimension(own), "port", "left_semi").groupBy("mmsi").agg(F.count("*").alias("ports"))


def uncorrelated_detections(satellite: DataFrame, ais: DataFrame, km: float = 10.0, seconds: float = 3600.0) -> DataFrame:
    """Satellite detections with no AIS fix near in place and time. The detections, the fewer, stand in their own cell, and
    fixes come to the cells around them once each; a detection goes at its first match."""
    fixes = _around(ais.select(F.col("ts").alias("b_ts"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon")), km, seconds)
    cells = _in_cells(satellite, km, seconds)
    same = [cells[c] == fixes[c] for c in ("cell_row", "cell_column", "period")]
    condition = same[0] & same[1] & same[2] & _is_close(km, seconds)
    return cells.join(fixes, condition, "left_anti").drop("cell_row", "cell_column", "period")


#: Up to so many stations are an expression of each row; more meet the rows on grids.
FEW_STATIONS = 32
CELL_KM = 20.0


def nearest_stations(df: DataFrame, stations: DataFrame) -> DataFrame:
    """``df`` with ``station_id``, the station nearest to a row's place, ties by id; null for a row without a place, or if
    there are no stations. Stations without a place take no part.

    Of many stations, those that can be the nearest anywhere in a cell are found for each cell with rows: rings grow around
    its middle until the nearest station is known, and with it all that are farther from the middle by no more than the
    cell is wide. A row then looks only at its cell's stations."""
    own = stations.select(F.col("station_id"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon")).where("s_lat is not null and s_lon is not null")
    few = own.limit(FEW_STATIONS + 1).collect()
    if len(few) <= FEW_STATIONS:
        each = [F.struct(haversine("latitude", "longitude", s.s_lat, s.s_lon).alias("km"), F.lit(s.station_id).alias("station_id")) for s in few]
        placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        nearest = F.array_min(F.array(*each))["station_id"] if few else F.lit(None).cast(stations.schema["station_id"].dataType)
        return df.withColumn("station_id", F.when(placed, nearest))
    row, column = cells(F.col("latitude"), F.col("longitude"), CELL_KM)
    marked = df.withColumns({"s_row": row, "s_column": column})
    candidates = write_table(station_candidates(marked.where("latitude is not null and longitude is not null").select("s_row", "s_column").distinct(), own))
    # one array a cell: a row meets its cell once, and takes the least of its stations
    listed = candidates.groupBy("s_row", "s_column").agg(F.collect_list(F.struct("station_id", "s_lat", "s_lon")).alias("near"))
    joined = marked.join(listed, ["s_row", "s_column"], "left")
    nearest = F.array_min(F.transform("near", lambda s: F.struct(haversine("latitude", "longitude", s["s_lat"], s["s_lon"]).alias("km"), s["station_id"].alias("station_id"))))
    return joined.withColumn("station_id", nearest["station_id"]).select(*df.columns, "station_id")


def station_candidates(occupied: DataFrame, stations: DataFrame) -> DataFrame:
    """``(s_row, s_column, station_id, s_lat, s_lon)``: of each cell the stations that may be nearest to a place in it."""
    height = CELL_KM / KM_A_DEGREE * 1.0001
    width = width_of(F.col("s_row"), height)
    low, high = F.col("s_row") * height - 90.0, (F.col("s_row") + 1) * height - 90.0
    edge = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    # from the middle to any place of the cell: along a meridian, then along a parallel
    reach = (height / 2 + width / 2 * F.cos(F.radians(F.least(edge, F.lit(90.0))))) * KM_A_DEGREE * 1.0001
    middle = {"c_lat": F.least(F.lit(90.0), low + height / 2), "c_lon": (F.col("s_column") + 0.5) * width - 180.0, "reach": reach}
    left, found, km = write_table(occupied.withColumns(middle)), None, 2 * CELL_KM
    while True:
        last = km > 20_100
        around = around_grid(stations, "s_lat", "s_lon", min(km, 20_100.0))
        met = on_grid(left, "c_lat", "c_lon", min(km, 20_100.0)).join(around, ["cell_row", "cell_column"])
        met = met.withColumn("km", haversine("c_lat", "c_lon", "s_lat", "s_lon"))
        bound = met.groupBy("s_row", "s_column").agg((F.min("km") + 2 * F.first("reach")).alias("bound"))
        # all within km of the middle were met, so a bound below it is a proof
        bound = bound if last else bound.where(F.col("bound") <= km)
        some = met.join(bound, ["s_row", "s_column"]).where(F.col("km") <= F.col("bound")).select("s_row", "s_column", "station_id", "s_lat", "s_lon")
        some = write_table(some)
        found = some if found is None else found.unionByName(some)
        if last:
            return found
        left = write_table(left.join(some.select("s_row", "s_column").distinct(), ["s_row", "s_column"], "left_anti"))
        if left.isEmpty():
            return found
        km *= 2


def weather_at_ships(df: DataFrame, stations: DataFrame, weather: DataFrame, hours: int = 1) -> DataFrame:
    """Each position with the last observation up to its time at the nearest station. Both sides are merged in time order
    within a station and a period of ``hours``; a period begins with the last observation of those before it."""
    period = F.floor(_micros("ts") / (hours * 3600 * MICROS)).alias("period")
    nearest = nearest_stations(df.select("event_id", "ts", "latitude", "longitude"), stations).select("event_id", "ts", "station_id", period)
    seen = weather.select("station_id", "ts", period, F.struct(F.col("ts").alias("observed_at"), "wind_speed_knots", "temperature_c").alias("w"))
    order = Window.partitionBy("station_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    # one row a station and period
    ends = seen.groupBy("station_id", "period").agg(F.max_by("w", "ts").alias("w"))
    wanted = nearest.select("station_id", "period").distinct().join(ends, ["station_id", "period"], "full")
    carried = wanted.select("station_id", "period", F.last("w", ignorenulls=True).over(order).alias("w")).where("w is not null")
    none = F.lit(None).cast("timestamp_ntz")
    both = nearest.select("station_id", "period", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(None).cast(seen.schema["w"].dataType).alias("w"), F.col("event_id").cast("long"))
    no_event = F.lit(None).cast("long").alias("event_id")
    both = both.unionByName(seen.select("station_id", "period", F.col("ts").cast("timestamp_ntz").alias("ts"), "w", no_event))
    both = both.unionByName(carried.select("station_id", "period", none.alias("ts"), "w", no_event))
    order = Window.partitionBy("station_id", "period").orderBy(F.asc_nulls_first("ts"), F.col("w").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("w", F.last("w", ignorenulls=True).over(order)).where("event_id is not null")
    return found.select("event_id", "ts", "station_id", "w.observed_at", "w.wind_speed_knots", "w.temperature_c")


def window_summary(df: DataFrame, hours: int = 24) -> DataFrame:
    """Per vessel and window: mean and largest speed, miles between fixes, sensors, dark fixes, and a line of text."""
    order = Window.partitionBy("mmsi", "bin").orderBy("ts", "event_id")  # legs are within a window, so a vessel's windows may part
    leg = haversine(F.lag("latitude").over(order), F.lag("longitude").over(order), "latitude", "longitude", "nm")
    legs = df.withColumn("bin", F.floor(_micros("ts") / (hours * 3600 * MICROS))).withColumn("leg", F.when(F.lag("bin").over(order).isNotNull(), leg))
    each = legs.groupBy("mmsi", "bin").agg(
        F.avg("speed_knots").alias("avg_speed"), F.max("speed_knots").alias("max_speed"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("distance_nm"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"), F.count_if("is_dark_ship").alias("dark_events"), F.count("*").alias("n"))
    begin = F.timestamp_add("SECOND", F.col("bin") * (hours * 3600), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    text = F.format_string("Vessel %s: %d positions, average %.1f knots, at most %.1f knots, %.1f nm", F.col("mmsi"), F.col("n"), F.col("avg_speed"), F.col("max_speed"), F.col("distance_nm"))
    return each.select("mmsi", begin.alias("window_start"), F.timestamp_add("HOUR", F.lit(hours), begin).alias("window_end"), "avg_speed", "max_speed", "distance_nm", "sensors", "dark_events", "n", text.alias("description"))


def alert_table(df: DataFrame, zones_hit: DataFrame, dark: DataFrame | None = None, knots: float = 35.0, gap_hours: float = 6.0, severity: dict[str, str] | None = None) -> DataFrame:
    """Speed, gap, zone and dark-ship alerts in one shape. Severities are the caller's."""
    severity = {"speed_anomaly": "medium", "ais_gap": "high", "zone_violation": "high", "dark_ship": "critical"} | (severity or {})

    def shaped(part: DataFrame, kind: str, ts: str, lat: str, lon: str, evidence: dict[str, str]) -> DataFrame:
        pairs = [x for k, c in evidence.items() for x in (F.lit(k), F.col(c).cast("string"))]
        name = F.col("mmsi") if "mmsi" in part.columns else F.lit(None).cast("string")
        return part.select(F.lit(kind).alias("alert_type"), F.lit(severity[kind]).alias("severity"), name.alias("mmsi"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude"), F.create_map(*pairs).alias("evidence"))

    found = shaped(df.where(F.col("speed_knots") > knots), "speed_anomaly", "ts", "latitude", "longitude", {"speed_knots": "speed_knots"})
    found = found.unionByName(shaped(ais_gaps(df, gap_hours), "ais_gap", "next_ts", "next_latitude", "next_longitude", {"gap_hours": "gap_hours", "jump_nm": "jump_nm"}))
    found = found.unionByName(shaped(zones_hit, "zone_violation", "ts", "latitude", "longitude", {"zone": "zone", "distance_nm": "distance_nm"}))
    return found.unionByName(shaped(dark, "dark_ship", "event_timestamp", "latitude", "longitude", {"reason": "alert_reason"})) if dark is not None else found
