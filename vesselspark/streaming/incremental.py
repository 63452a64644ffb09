"""Tables and sums that a stream keeps up to date: a table in buckets of which an update writes those it touches, the vessel
master as counts that add up, sessions of a vessel's reports, and statistics that queries report as they run."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vesselspark import config
from vesselspark.operators.history import NEWEST
from vesselspark.operators.sinks import upsert_tracks
from vesselspark.streaming.fusion import Folders


class BucketTable(Folders):
    """A table by key in ``n_buckets`` hash buckets. Update number n reads the buckets that its keys fall in and writes their
    new content below ``data/n``; all other buckets stay where they were written last. The folders are the ledger: the
    newest number may run again, from what was there before it, and an older one was counted and is passed over. Of each
    bucket the content before the newest update is kept for that."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n_buckets: int = 64):
        super().__init__(spark, path)
        self.schema, self.key, self.n_buckets = schema, key, n_buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """The numbers of the updates whose content of a bucket is there, by bucket."""
        found: dict[int, list[int]] = {}
        for number in self._written("data"):
            fs, folder = self._folder(f"data/{number}")
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("bucket="):
                    found.setdefault(int(name[7:]), []).append(number)
        return found

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, as they were before an update."""
        paths = []
        for bucket, numbers in self.versions().items():
            own = [n for n in numbers if before is None or n < before]
            if own and (buckets is None or bucket in buckets):
                paths.append(f"{self.path}/data/{own[-1]}/bucket={bucket}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, updates: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Update ``number``: ``merge(updates, current)`` gives the new rows of the buckets that ``updates`` touches."""
        done = self._written("data")
        if done and number < done[-1]:
            return
        hit = {r.bucket for r in updates.select(self._bucket().alias("bucket")).distinct().collect()}  # n_buckets at most
        rows = merge(updates, self.read(number, hit)).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        for bucket, numbers in self.versions().items():
            for old in [n for n in numbers if n < number][:-1]:
                fs, folder = self._folder(f"data/{old}/bucket={bucket}")
                fs.delete(folder, True)


def track_table(spark: SparkSession, path: str, schema: str, n_buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, schema, "track_id", n_buckets)


def upsert_batch(table: BucketTable, updates: DataFrame, number: int) -> None:
    """``upsert_tracks`` into a table of buckets."""
    table.apply(updates, number, upsert_tracks)


class VesselMaster:
    """``vessel_master`` kept from a stream: an update adds its counts to those of its vessels. Names and types are held with
    the time of the row they are from, so rows may come in any order."""

    SCHEMA = "mmsi string, named struct<ts:timestamp_ntz,event_id:long,value:string>, typed struct<ts:timestamp_ntz,event_id:long,value:string>, last_seen timestamp_ntz, total_positions long"

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        self.table = BucketTable(spark, path, self.SCHEMA, "mmsi", n_buckets)

    def apply(self, positions: DataFrame, number: int) -> None:
        """Positions of micro-batch ``number``; one that runs twice counts once."""
        order = [F.col(NEWEST[0]).cast("timestamp_ntz").alias("ts"), F.col(NEWEST[1]).cast("long").alias("event_id")]
        known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).cast("string").alias("value")))
        new = positions.select(F.col("mmsi").cast("string").alias("mmsi"), known("ship_name").alias("named"), known("vessel_type").alias("typed"), order[0].alias("last_seen"), F.lit(1).cast("long").alias("total_positions"))
        self.table.apply(self._summed(new), number, lambda updates, current: self._summed(updates.unionByName(current)))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("mmsi").agg(F.max("named").alias("named"), F.max("typed").alias("typed"), F.max("last_seen").alias("last_seen"), F.sum("total_positions").alias("total_positions"))

    def read(self) -> DataFrame:
        return self.table.read().select("mmsi", F.col("named.value").alias("ship_name"), F.col("typed.value").alias("vessel_type"), "last_seen", "total_positions")


def sessions(positions: DataFrame, gap_s: int = 120, key: str = "mmsi") -> DataFrame:
    """``segment_tracks`` on a stream with a watermark: ``(key, first_ts, last_ts, n)`` of each session that is over. A report
    ``gap_s`` after the last one still belongs to it. Reports without a time belong to none."""
    window = F.session_window("ts", f"{gap_s} seconds")
    found = positions.groupBy(window, key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return found.select(key, "first_ts", "last_ts", "n")


SENSORS = tuple(config.SENSOR_SIGMA)


def observe_detections(detections: DataFrame) -> DataFrame:
    """The same rows; their number by sensor is reported as ``detections``."""
    return detections.observe("detections", *[F.count_if(F.col("sensor") == s).alias(s) for s in SENSORS])


def observe_tracks(updates: DataFrame) -> DataFrame:
    """The same rows of changed tracks; those dropped, and of these the updates that they had, are reported as ``tracks``."""
    dropped = F.col("track_status") == "dropped"
    return updates.observe("tracks", F.count_if(dropped).alias("dropped"), F.coalesce(F.sum(F.when(dropped, F.col("update_count"))), F.lit(0)).alias("updates_of_dropped"))


class FusionStats(StreamingQueryListener):
    """Sums over micro-batches of what queries report by ``observe``; a micro-batch reports when it is done, once."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}
        self.seen: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if (str(progress.id), progress.batchId) in self.seen:
            return
        self.seen.add((str(progress.id), progress.batchId))
        for name, row in (progress.observedMetrics or {}).items():
            own = self.sums.setdefault(name, {})
            for field, value in row.asDict().items():
                own[field] = own.get(field, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def __repr__(self) -> str:
        return json.dumps(self.sums)
