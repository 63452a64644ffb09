"""Constants and small dimension tables. The dimension functions give DataFrames of fixed size, fit to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, codes, places, limits and errors that results depend on.
NAV_STATUS = {
    0: "Under way using engine", 1: "At anchor", 2: "Not under command", 3: "Restricted manoeuverability",
    4: "Constrained by draught", 5: "Moored", 6: "Aground", 7: "Engaged in fishing", 8: "Under way sailing",
    9: "Reserved for HSC", 10: "Reserved for WIG", 11: "Reserved", 12: "Reserved", 13: "Reserved",
    14: "AIS-SART active", 15: "Not defined",
}
#: By decade of the code, which is how a type is looked up.
SHIP_TYPE = {0: "Not available", 20: "WIG", 30: "Fishing", 40: "HSC", 50: "Pilot vessel", 60: "Passenger", 70: "Cargo", 80: "Tanker", 90: "Other"}
LOST_REASON = {0: "Timeout", 1: "Merged with another track", 2: "Manual deletion", 3: "Out of range"}
VESSEL_CLASS = {
    "cargo": "cargo_ship", "tanker": "tanker", "container": "container_ship", "fishing": "fishing_boat",
    "passenger": "vessel", "naval": "naval_vessel", "tug": "vessel", "unknown": "unknown_vessel",
}
PORTS = [
    ("Mumbai", "India", 18.9388, 72.8354), ("Chennai", "India", 13.0827, 80.2707), ("Kochi", "India", 9.9312, 76.2673),
    ("Visakhapatnam", "India", 17.6868, 83.2185), ("Kandla", "India", 23.0333, 70.2167), ("Colombo", "Sri Lanka", 6.9271, 79.8612),
    ("Singapore", "Singapore", 1.3521, 103.8198), ("Dubai", "UAE", 25.2048, 55.2708), ("Karachi", "Pakistan", 24.8607, 67.0011),
    ("Chittagong", "Bangladesh", 22.3569, 91.7832),
]
RADAR_STATIONS = [
    ("RAD-MUM", "Mumbai", 18.94, 72.84, 60.0), ("RAD-CHN", "Chennai", 13.08, 80.27, 55.0), ("RAD-COL", "Colombo", 6.93, 79.85, 50.0),
    ("RAD-GOA", "Goa", 15.50, 73.83, 45.0), ("RAD-KOC", "Kochi", 9.97, 76.27, 50.0), ("RAD-VIS", "Visakhapatnam", 17.69, 83.22, 55.0),
    ("RAD-KAR", "Karachi", 24.86, 67.01, 60.0),
]
PATROL_ZONES = [
    ("DRN-001", "Mumbai Approach", 18.8, 72.5, 25.0), ("DRN-002", "Lakshadweep", 10.5, 72.6, 30.0), ("DRN-003", "Andaman Passage", 12.0, 92.7, 35.0),
    ("DRN-004", "Gulf of Kutch", 22.5, 69.0, 20.0), ("DRN-005", "Colombo Approach", 7.0, 79.5, 20.0),
]
REGIONS = [
    ("Arabian Sea", 10.0, 25.0, 55.0, 75.0), ("Bay of Bengal", 5.0, 22.0, 80.0, 95.0), ("Indian West Coast", 8.0, 23.0, 68.0, 77.0),
    ("Indian East Coast", 8.0, 22.0, 77.0, 88.0), ("Sri Lanka", 5.0, 12.0, 78.0, 85.0),
]
SATELLITES = [
    ("Sentinel-1A", "SAR", 10.0, 250.0), ("Sentinel-1B", "SAR", 10.0, 250.0), ("Sentinel-2A", "optical", 10.0, 290.0),
    ("Sentinel-2B", "optical", 10.0, 290.0), ("Planet-Dove", "optical", 3.0, 24.0), ("Maxar-WV3", "optical", 0.3, 13.0),
]
#: Standard error of a position by sensor, in metres.
SENSOR_SIGMA = {"ais": 10.0, "radar": 500.0, "satellite": 2000.0, "drone": 50.0}
SIGMA_MIN, SIGMA_MAX = 100.0, 5000.0
GATE_MIN, GATE_MAX, GATE_SIGMAS = 500.0, 10_000.0, 4.0
MAX_PREDICT_S, MERGE_KM, NEW_TRACK_COST, CONFIRM_UPDATES = 120.0, 5.0, 0.95, 3
COAST_S, DROP_S, AIS_GAP_S, RECENT_S, DARK_ALERT = 60.0, 120.0, 900.0, 120.0, 0.6
RRF_K, RRF_WEIGHTS = 60, {"structured": 1.0, "semantic": 0.8, "realtime": 1.2}


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "name string, country string, latitude double, longitude double")


def radar_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RADAR_STATIONS, "station_id string, name string, latitude double, longitude double, range_nm double")


def patrol_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATROL_ZONES, "zone_id string, name string, latitude double, longitude double, radius_nm double")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lat_min double, lat_max double, lon_min double, lon_max double")


def satellites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SATELLITES, "satellite string, sensor_type string, resolution_m double, swath_km double")
