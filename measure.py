"""Rows a second and shuffled bytes of the core's operators on detections made from ``events``, copied to so many rows:
``python measure.py 1000000 10000000``. Prints a line of a Markdown table for each operator and size."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copied(df: DataFrame, n: int) -> DataFrame:
    """``df`` until there are about ``n`` rows: each copy is of other vessels, at other places and times."""
    copies = max(1, round(n / df.count()))
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return many.withColumns({
        "event_id": F.col("event_id") * copies + F.col("copy"), "mmsi": F.concat("mmsi", F.lpad(F.col("copy").cast("string"), 4, "0")),
        "ts": F.timestamp_add("SECOND", F.col("copy") * 7, F.col("ts")), "latitude": F.col("latitude") + (F.col("copy") % 31) * 0.21, "longitude": F.col("longitude") + (F.col("copy") % 37) * 0.23}).drop("copy")


def main() -> None:
    from vesselspark import config
    from vesselspark.operators import extras, history, proximity, tracks
    from vesselspark.plans.adapter import positions
    from vesselspark.sources import nmea

    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "64").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    executors = lambda: sum(e.totalShuffleWrite() for e in _all(spark))
    for n in map(int, sys.argv[1:]):
        df = copied(positions(spark, "/root/testdata/sf0.1"), n)
        path = f"/tmp/measure-{n}-{int(time.time())}"
        df.write.parquet(path)
        df = spark.read.parquet(path)
        sentence = F.lit("15N4cJ`005Jrek0H@9n`DW5608EP")
        messages = df.select(F.lit("s").alias("source"), F.col("event_id").alias("at"), sentence.alias("payload"), F.lit(0).alias("fill_bits"), F.col("mmsi").alias("raw_sentence"))
        jobs = {
            "decode_nmea": lambda: nmea.decode_position(nmea._frame(messages)), "zone_violations": lambda: proximity.zone_violations(df, config.patrol_zones(spark).withColumnRenamed("zone_id", "zone")),
            "ais_gaps": lambda: history.ais_gaps(df), "segment_tracks": lambda: history.segment_tracks(df), "ais_gap_asof": lambda: history.ais_gap_asof(df),
            "vessel_master": lambda: history.vessel_master(df), "window_summary": lambda: extras.window_summary(df),
            "fold_tracks": lambda: tracks.fold_tracks(df.withColumns({"track_id": F.col("mmsi"), "detection_id": F.col("event_id").cast("string")}))}
        rows = df.count()
        for name, job in jobs.items():
            before, began = executors(), time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            print(f"| {name} | {rows:,} | {took:.1f} | {rows / took:,.0f} | {(executors() - before) / 1e6:,.0f} |", flush=True)
    spark.stop()


def _all(spark: SparkSession):
    found = spark._jsc.sc().statusStore().executorList(False)
    return [found.apply(k) for k in range(found.size())]


if __name__ == "__main__":
    main()
