"""Joins by place. Fixed small tables are broadcast after a rectangle test; large sides meet on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.functions.geo import bearing, haversine, radar_probability, radar_quality, satellite_probability
from vesselspark.operators.filters import active_tracks

#: A broadcast side has at most this many rows; more places are met on grid cells.
DIMENSION_ROWS = 10_000
#: Up to so many places or rectangles are tried at each row.
NESTED_ROWS = 500
#: Rectangles lie on cells of levels 0 to FINEST; a level's cells are half as wide as those of the one before.
WORLD, FINEST = 1024.0, 24
#: Places whose radius is below so many kilometres share a grid, from small to large.
GRIDS_KM = (5.0, 20.0, 80.0, 320.0, 1280.0, 20_100.0)
KM_A_DEGREE = 6371.0 * math.pi / 180


def is_small(df: DataFrame) -> bool:
    return df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS


def dimension(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is as small as a dimension; for joins by equal keys, which need no such side."""
    return F.broadcast(df) if is_small(df) else df


def is_few(df: DataFrame) -> bool:
    """Few enough to try all of them at each row."""
    return df.limit(NESTED_ROWS + 1).count() <= NESTED_ROWS


def _between(row: str) -> Column:
    inside = F.col("latitude").between(F.col(f"{row}lat_min"), F.col(f"{row}lat_max"))
    return inside & F.col("longitude").between(F.col(f"{row}lon_min"), F.col(f"{row}lon_max"))


def _level(extent: Column) -> Column:
    """The finest level whose cells are not smaller than a fourth of the extent; cells of level 0 are 1024 degrees wide."""
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(4.0 * WORLD) / F.greatest(extent, F.lit(1e-9)))))).cast("int")


def _clipped(degrees: Column) -> Column:
    return F.greatest(F.lit(-WORLD / 2), F.least(F.lit(WORLD / 2), degrees))


def in_rectangles(df: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Rows paired with each rectangle ``(lat_min, lat_max, lon_min, lon_max, ...)`` they lie in, edges included. A few are
    tried at each row. Of many, each is covered by cells of the level that suits its larger side, 25 at most, and rows
    look up their own cell of each level in use; an equal-key join, so neither side has to be small. A rectangle with a
    null or crossed edge holds nothing."""
    if is_few(rectangles):
        return df.join(F.broadcast(rectangles), _between(""))
    edges = [_clipped(F.col(c)) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]
    level = _level(F.greatest(edges[1] - edges[0], edges[3] - edges[2]))
    leveled = rectangles.where("lat_min <= lat_max and lon_min <= lon_max").withColumn("q_level", level)
    used = [r.q_level for r in leveled.select("q_level").distinct().collect()]  # FINEST + 1 at most
    cell = lambda degrees, level: F.floor(degrees / F.pow(F.lit(2.0), -level) / WORLD).cast("long")
    span = lambda low, high: F.sequence(cell(low, F.col("q_level")), cell(high, F.col("q_level")))
    covered = leveled.withColumn("q_row", F.explode(span(*edges[:2]))).withColumn("q_column", F.explode(span(*edges[2:])))
    levels = F.array(*[F.lit(k) for k in sorted(used)]).cast("array<int>")
    rows = df.where("latitude is not null and longitude is not null").withColumn("q_level", F.explode(levels))
    rows = rows.withColumns({"q_row": cell(_clipped(F.col("latitude")), F.col("q_level")), "q_column": cell(_clipped(F.col("longitude")), F.col("q_level"))})
    return rows.join(covered, ["q_level", "q_row", "q_column"]).where(_between("")).drop("q_level", "q_row", "q_column")


def _box(km: Column | float, lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """A rectangle that holds all places within ``km``, wrapped at 180 degrees; near the poles any longitude."""
    km = km if isinstance(km, Column) else F.lit(float(km))
    reach = km / KM_A_DEGREE * 1.0001
    scale = F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(lat), F.abs(other_lat)) + reach)))
    apart = F.abs(lon - other_lon)
    return (F.abs(lat - other_lat) <= reach) & (F.least(apart, 360.0 - apart) * scale <= reach)


def ships_near_point(tracks: DataFrame, lat: float, lon: float, km: float, n: int = 100) -> DataFrame:
    """Tracks not dropped within ``km``, nearest first."""
    here = _box(km, F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    near = active_tracks(tracks).where(here).withColumn("distance_km", haversine("latitude", "longitude", lat, lon))
    return near.where(F.col("distance_km") <= km).orderBy("distance_km", "track_id").limit(n)


def ships_near_port(tracks: DataFrame, ports: DataFrame, name: str, km: float = 50.0, n: int = 100) -> DataFrame:
    """``ships_near_point`` around a port by its name in any case; a port that isn't in the table is an error."""
    port = ports.where(F.lower("name") == name.lower()).select(F.col("name").alias("port_name"), F.col("latitude").alias("port_lat"), F.col("longitude").alias("port_lon"))
    one = port.limit(1).collect()
    if not one:
        raise ValueError(f"unknown port: {name}")
    near = ships_near_point(tracks, one[0].port_lat, one[0].port_lon, km, n)
    return near.withColumn("port_name", F.lit(one[0].port_name))


def within_range(df: DataFrame, lat: float, lon: float, nm: float, strict: bool = False) -> DataFrame:
    """All positions within ``nm`` of a point with their distance, nearest first."""
    near = df.where(_box(nm * 1.852 * 1.001, F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)))
    near = near.withColumn("distance_nm", haversine("latitude", "longitude", lat, lon, "nm"))
    return near.where(F.col("distance_nm") < nm if strict else F.col("distance_nm") <= nm).orderBy("distance_nm", "event_id")


def positions_near_port(df: DataFrame, lat: float, lon: float, nm: float = 50.0) -> DataFrame:
    return within_range(df, lat, lon, nm, strict=True)


def ships_in_range(df: DataFrame, lat: float, lon: float, nm: float) -> DataFrame:
    return within_range(df, lat, lon, nm)


def near_places(df: DataFrame, places: DataFrame, radius_nm: str, strict: bool = False) -> DataFrame:
    """Rows paired with each place whose radius they are in. Columns of ``places`` come as ``place_<name>``. A few places
    are broadcast; many meet the rows on grids of cells as wide as their radius, one grid for radii of about one size."""
    own = places.select(*(F.col(c).alias(f"place_{c}") for c in places.columns))
    lat, lon, radius = F.col("place_latitude"), F.col("place_longitude"), F.col(f"place_{radius_nm}")
    distance = haversine("latitude", "longitude", lat, lon, "nm")
    near = distance < radius if strict else distance <= radius
    if is_few(own):
        box = _box(radius * 1.852 * 1.001, F.col("latitude"), F.col("longitude"), lat, lon)
        return df.join(F.broadcast(own), box & near).withColumn("distance_nm", distance)
    km, found, low = radius * 1.852 * 1.001, None, -1.0
    for high in GRIDS_KM:
        some = own.where((km > low) & (km <= high) if high < GRIDS_KM[-1] else km > low)
        if not some.isEmpty():
            cells = around_grid(some, "place_latitude", "place_longitude", high)
            pairs = on_grid(df, "latitude", "longitude", high).join(cells, ["cell_row", "cell_column"]).where(near).drop("cell_row", "cell_column")
            found = pairs if found is None else found.unionByName(pairs)
        low = high
    return (df.join(F.broadcast(own.limit(0)), near) if found is None else found).withColumn("distance_nm", distance)


def zone_violations(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Positions strictly inside restricted zones ``(zone, latitude, longitude, radius_nm)``; distance rounded to 2."""
    found = near_places(df, zones, "radius_nm", strict=True)
    return found.withColumn("distance_nm", F.round("distance_nm", 2)).withColumnRenamed("place_zone", "zone")


def radar_coverage(df: DataFrame, stations: DataFrame, weather: float = 1.0) -> DataFrame:
    """What each station can see, with range, bearing and chance of detection. ``rcs_m2`` grows with the length."""
    found = near_places(df, stations, "range_nm").withColumnRenamed("place_station_id", "station_id")
    probability = radar_probability("distance_nm", "place_range_nm", "rcs_m2", weather)
    return found.withColumns({
        "bearing": bearing("place_latitude", "place_longitude", "latitude", "longitude"),
        "probability": probability, "quality": radar_quality(probability),
        "rcs_dbsm": 10.0 * F.log10(F.col("rcs_m2") + 0.1),
    })


def swath_coverage(df: DataFrame, passes: DataFrame) -> DataFrame:
    """Rows inside the rectangle of each pass ``(pass_id, sensor_type, cloud_cover, lat_min, lat_max, lon_min, lon_max)``."""
    return in_rectangles(df, passes).withColumn("probability", satellite_probability("sensor_type", "cloud_cover"))


def patrol_coverage(df: DataFrame, zones: DataFrame) -> DataFrame:
    return near_places(df, zones, "radius_nm").withColumnRenamed("place_zone_id", "zone_id")


def assign_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Each row with each region it lies in; regions may overlap."""
    return in_rectangles(df, regions)


def cells(lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are ``km`` high, and at least as wide at the row's latitude."""
    height = km / KM_A_DEGREE * 1.0001
    row = F.floor((lat + 90.0) / height).cast("long")
    return row, F.floor((lon + 180.0) / width_of(row, height)).cast("long")


def width_of(row: Column, height: float) -> Column:
    """The width in degrees of a grid row's cells, from the row's edge farther from the equator and one row beyond it."""
    edge = F.greatest(F.abs(row * height - 90.0), F.abs((row + 1) * height - 90.0)) + height
    count = F.greatest(F.lit(1.0), F.floor(F.lit(360.0) * F.cos(F.radians(F.least(F.lit(90.0), edge))) / height))
    return 360.0 / count


def near_cells(lat: Column, lon: Column, km: float) -> Column:
    """An array of (row, column) of all cells that may hold something within ``km``: of three rows, those that the
    longitudes within reach fall in, wrapped at 180 degrees."""
    height = km / KM_A_DEGREE * 1.0001
    own = F.floor((lat + 90.0) / height).cast("long")

    def in_row(step: Column) -> Column:
        row = own + step
        width = width_of(row, height)
        count = F.round(360.0 / width).cast("long")
        at = F.floor((lon + 180.0) / width).cast("long")
        columns = F.transform(F.sequence(at - 1, at + 1), lambda c: F.pmod(c, count))
        return F.transform(F.array_distinct(columns), lambda c: F.struct(row.alias("cell_row"), c.alias("cell_column")))

    return F.flatten(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), in_row))


def on_grid(df: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    row, column = cells(F.col(lat), F.col(lon), km)
    height = km / KM_A_DEGREE * 1.0001
    count = F.round(360.0 / width_of(row, height)).cast("long")
    return df.withColumns({"cell_row": row, "cell_column": F.pmod(column, count)})


def around_grid(df: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """``df`` once for each cell near it; meant for the smaller side."""
    return df.withColumn("__cell", F.explode(near_cells(F.col(lat), F.col(lon), km))).select("*", "__cell.*").drop("__cell")
