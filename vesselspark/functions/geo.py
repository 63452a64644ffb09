"""Geographic and kinematic column functions. All are built-in expressions; nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vesselspark import config

RADIUS = {"km": 6371.0, "m": 6371000.0, "nm": 3440.065}
KNOT_MS = 0.5144
METRES_A_DEGREE = 111000.0


def col(value: Column | str | float) -> Column:
    """A column as given or by name, or a number."""
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def haversine(lat1, lon1, lat2, lon2, unit: str = "km") -> Column:
    """Great-circle distance on a sphere."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lon = (b - a) / 2, (F.radians(col(lon2)) - F.radians(col(lon1))) / 2
    h = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * RADIUS[unit]) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    turn = F.radians(col(lon2)) - F.radians(col(lon1))
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(F.sin(turn) * F.cos(b), north)) + 360.0, F.lit(360.0))


def velocity(speed_knots, course) -> tuple[Column, Column]:
    """Metres a second to the north and to the east."""
    speed, heading = col(speed_knots) * KNOT_MS, F.radians(col(course))
    return speed * F.cos(heading), speed * F.sin(heading)


def predict_position(lat, lon, north_ms, east_ms, seconds) -> tuple[Column, Column]:
    """Where a velocity leads in at most 120 s; times before now are not limited."""
    dt = F.least(col(seconds), F.lit(config.MAX_PREDICT_S))
    scale = F.greatest(F.lit(0.1), F.cos(F.radians(col(lat))))
    return col(lat) + col(north_ms) * dt / METRES_A_DEGREE, col(lon) + col(east_ms) * dt / (scale * METRES_A_DEGREE)


def dead_reckon(lat, lon, speed_knots, course, seconds) -> tuple[Column, Column]:
    """A position after sailing straight on: a knot is a minute of latitude an hour."""
    degrees = col(speed_knots) * col(seconds) / 3600.0 / 60.0
    heading = F.radians(col(course))
    return col(lat) + degrees * F.cos(heading), col(lon) + degrees * F.sin(heading) / F.cos(F.radians(col(lat)))


def turn(course, other) -> Column:
    """Signed change of course, from -180 up to but not including 180."""
    return F.pmod(col(other) - col(course) + 180.0, F.lit(360.0)) - 180.0


def gate_size(sigma_track, sigma_sensor) -> Column:
    """Metres within which a detection may belong to a track."""
    both = F.sqrt(F.pow(col(sigma_track), F.lit(2.0)) + F.pow(col(sigma_sensor), F.lit(2.0)))
    return F.least(F.lit(config.GATE_MAX), F.greatest(F.lit(config.GATE_MIN), both * config.GATE_SIGMAS))


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)) != 0.0


def kinematic_score(speed1, course1, speed2, course2) -> Column:
    """Differences of speed over 15 and of course over 120; a term counts where both sides are neither null nor zero."""
    apart = F.abs(col(course1) - col(course2))
    by_speed = F.when(_present(col(speed1)) & _present(col(speed2)), F.abs(col(speed1) - col(speed2)) / 15.0)
    by_course = F.when(_present(col(course1)) & _present(col(course2)), F.least(apart, 360.0 - apart) / 120.0)
    return F.coalesce(by_speed, F.lit(0.0)) + F.coalesce(by_course, F.lit(0.0))


def match_score(distance_m, sigma_track, sigma_sensor, kinematic) -> Column:
    return col(distance_m) / F.sqrt(F.pow(col(sigma_track), F.lit(2.0)) + F.pow(col(sigma_sensor), F.lit(2.0))) + col(kinematic)


def match_confidence(score) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - col(score) / 10.0))


def radar_probability(distance_nm, range_nm, rcs_m2, weather=1.0) -> Column:
    """Chance that a station sees a vessel of some radar cross-section."""
    by_range = F.greatest(F.lit(0.0), 1.0 - F.pow(col(distance_nm) / col(range_nm), F.lit(2.0)))
    return F.lit(0.85) * by_range * F.least(F.lit(1.5), 0.5 + 0.5 * col(rcs_m2)) * col(weather)


def radar_quality(probability) -> Column:
    return (col(probability) * 100.0).cast("int")


def satellite_probability(sensor_type, cloud_cover) -> Column:
    return F.when(col(sensor_type) == "SAR", F.lit(0.95)).otherwise(F.lit(0.85) * (1.0 - col(cloud_cover)))


def pixel_to_geo(lat, lon, altitude_m, heading, fov_degrees, x, y, width=1920, height=1080) -> tuple[Column, Column]:
    """The place of a picture's pixel on the ground, from height, field of view and heading."""
    across = 2.0 * col(altitude_m) * F.tan(F.radians(col(fov_degrees)) / 2.0)
    down = across * (height / width)
    east = (col(x) / width - 0.5) * across / (METRES_A_DEGREE * F.cos(F.radians(col(lat))))
    north = (col(y) / height - 0.5) * down / METRES_A_DEGREE
    turned = F.radians(col(heading))
    return col(lat) + north * F.cos(turned) - east * F.sin(turned), col(lon) + north * F.sin(turned) + east * F.cos(turned)


def pixel_size(pixels, altitude_m, fov_degrees, width=1920) -> Column:
    """Metres that a number of pixels spans."""
    return col(pixels) / width * 2.0 * col(altitude_m) * F.tan(F.radians(col(fov_degrees)) / 2.0)


def register_sql_functions(spark: SparkSession) -> None:
    """``haversine_distance(lat1, lon1, lat2, lon2)`` in km for SQL, as an expression."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION haversine_distance(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN 12742.0D * asin(sqrt(least(1.0D, power(sin((radians(lat2) - radians(lat1)) / 2), 2)
               + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2))))""")
