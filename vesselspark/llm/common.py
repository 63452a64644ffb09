"""Shared helpers: reading the input tables, free column names, and columns made from whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until none of the columns has it in any case."""
    taken, free = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return free


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], list[list]]], fields: list[tuple[str, str, pa.DataType]], rows: int = 512) -> DataFrame:
    """``df`` with columns made from whole texts, without a shuffle. ``make`` is called once per task and returns what
    turns a list of texts into the lists of the new columns; ``fields`` are their names, Spark types and Arrow types."""
    names = [*df.columns, *(name for name, _, _ in fields)]
    kinds = [kind for _, _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                block = batch.slice(at, rows)
                made = work(block.column(len(block.columns) - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], *(pa.array(c, k) for c, k in zip(made, kinds))], names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` {kind}" for name, kind, _ in fields]
    return df.select("*", F.col(f"`{text_col}`").alias(*unused(names, "text"))).mapInArrow(run, ", ".join(schema))
