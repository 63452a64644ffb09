"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Makes Spark remove a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_recorded: list[list[DataFrame]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session, as in tests, takes a temporary folder; others are refused,
    as their executors could not see the driver's disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="vesselspark-"))
        where = _local[0]
    return where.rstrip("/")


def write_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that later steps neither recompute it nor depend
    on any executor's disk. The folder's owner clears it; ``drop_table`` and ``scratch`` do so early."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_to"] = path
    for record in _recorded:
        record.append(table)
    return table


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_written_to"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Record the tables written inside; those still on the list at the end are deleted. Take what is to stay off it."""
    record: list[DataFrame] = []
    _recorded.append(record)
    try:
        yield record
    finally:
        _recorded[:] = [r for r in _recorded if r is not record]  # nested records may be equal
        for table in record:
            drop_table(table)
