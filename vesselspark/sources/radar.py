"""Coastal radar frames; fields are read once the frames are found.

A file's frames follow one another, so where one starts depends on all before it. Files up to WHOLE_BYTES are scanned
whole. Larger ones are cut into blocks: a block tells, for each place at which a scan may enter it, where it leaves; the
blocks of a file are chained by that, and each is then scanned from the place where it is really entered.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions.casts import lookup
from vesselspark.tables import write_table

# Type codes, and the whole frame's least length by type.
TRACK_UPDATE, TRACK_LOST, SYSTEM_STATUS, HEARTBEAT = 0x0100, 0x0101, 0x0200, 0x0300
LEAST = {TRACK_UPDATE: 34, TRACK_LOST: 24, SYSTEM_STATUS: 28, HEARTBEAT: 8}
LONGEST = 0xFFFF
FRAMES = "source string, at long, message_type int, epoch long, frame binary, float_value double"


def find_frames(data: bytes) -> Iterator[tuple[int, int, int, bytes, float | None]]:
    """(offset, type, epoch, frame, its float) of each whole frame. A header of an unknown type, or of a length below its
    type's least, is stepped over by a byte; a frame that runs past the end ends the scan."""
    at = 0
    while at + 8 <= len(data):
        kind, length, epoch = struct.unpack_from(">HHI", data, at)
        least = LEAST.get(kind)
        if least is None or length < 8:
            at += 1
            continue
        if at + length > len(data):
            return
        if length < least:
            at += 1
            continue
        place = {TRACK_UPDATE: 24, SYSTEM_STATUS: 19}.get(kind)
        yield at, kind, epoch, data[at : at + length], struct.unpack_from(">f", data, at + place)[0] if place else None
        at += length


def split_radar_frames(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> one row per frame."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = [(path, *frame) for frame in find_frames(bytes(content))]
                yield pd.DataFrame(rows, columns=["source", "at", "message_type", "epoch", "frame", "float_value"])

    return files.select("path", "content").mapInPandas(scan, FRAMES)


WHOLE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
AHEAD = LONGEST + 8  # bytes beyond a block that its scan may look at
ENDED = -1


def block_exits(data: bytes, size: int, last: bool) -> np.ndarray:
    """Where a scan that enters a block of ``size`` bytes at each of its first LONGEST places leaves it, counted from the
    block's end; ENDED where it ends within. ``data`` has what follows the block too; ``last``: it ends with the file."""
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8).astype(np.int32)
    kind, length = raw[:size] << 8 | raw[1 : size + 1], raw[2 : size + 2] << 8 | raw[3 : size + 3]
    least = np.zeros(size, dtype=np.int32)
    for known, n in LEAST.items():
        least[kind == known] = n
    at = np.arange(size, dtype=np.int32)
    framed = (least > 0) & (length >= 8)
    following = np.where(framed & (length >= least), at + length, at + 1)
    # place size is the block's end, and further ones what lies beyond; the very last stands for a scan that has ended
    jump = np.arange(size + LONGEST + 2, dtype=np.int32)
    jump[:size] = following
    if last:
        jump[:size][(framed & (at + length > len(data))) | (at + 8 > len(data))] = len(jump) - 1
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    ends = jump[: min(LONGEST + 1, size)] - size
    ends[ends == LONGEST + 1] = ENDED
    return ends


def _pieces(lines: DataFrame) -> DataFrame:
    """(source, split, piece, data): the bytes of text lines, with the line feeds that they were cut at, in pieces of a
    block's size at least, but the last of a split."""
    names = ["source", "split", "piece", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = None, 0, [], 0

        def result(data: bytes) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, number, data), kinds)], names)

        for batch in batches:
            for source, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, split) != key or size >= BLOCK_BYTES:
                    if held:
                        yield result(b"".join(held))
                        number += 1
                    held, size = [], 0
                    if (source, split) != key:
                        key, number = (source, split), 0
                held += [line, b"\n"]
                size += len(line) + 1
        if held:
            yield result(b"".join(held))

    return lines.mapInArrow(run, "source string, split long, piece long, data binary")


def _blocks(pieces: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    """(source, block, data, size, last) of files from their pieces; ``data`` looks AHEAD into the next block. ``sizes``
    has the bytes of each file: text readers take off a mark of byte order and add a last line feed."""
    order = Window.partitionBy("source").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, -1)
    places = pieces.select("source", "split", "piece", F.length("data").cast("long").alias("n"))
    total = places.groupBy("source").agg(F.sum("n").alias("total")).join(sizes, "source")
    lacking = total.select("source", "file_size", (F.col("total") - F.col("file_size")).isin(-3, -2).alias("marked"))
    offsets = places.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n").join(lacking, "source")
    names = ["source", "block", "at", "data", "file_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for batch in batches:
            for source, at, data, size, marked in zip(*(c.to_pylist() for c in batch.columns)):
                if marked:
                    at, data = (at, b"\xef\xbb\xbf" + data) if at == 0 else (at + 3, data)
                data = data[: size - at]
                rows, low = [], at
                while low < at + len(data):
                    block = low // block_bytes
                    high = min(at + len(data), (block + 1) * block_bytes)
                    rows.append((source, block, low, data[low - at : high - at], size))
                    first = block * block_bytes  # what the blocks before look ahead to
                    for back in range(1, -(-AHEAD // block_bytes) + 1):
                        if block >= back and low < (end := first - (back - 1) * block_bytes + AHEAD):
                            rows.append((source, block - back, low, data[low - at : min(high, end) - at], size))
                    low = high
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    cut = pieces.join(offsets, ["source", "split", "piece"]).select("source", "before", "data", "file_size", "marked")
    cut = cut.mapInArrow(run, "source string, block long, at long, data binary, file_size long")
    whole = cut.groupBy("source", "block", "file_size").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))  # a block and AHEAD
    left = F.col("file_size") - F.col("block") * block_bytes
    return whole.select("source", "block", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.data))").alias("data"),
                        F.least(F.lit(block_bytes), left).cast("int").alias("size"), (left <= block_bytes + AHEAD).alias("last"))


def _chained(blocks: DataFrame) -> DataFrame:
    """(source, block, entry): where the scan of a file enters each of its blocks; blocks it doesn't reach are left out."""
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes, last = (batch.column(k).to_pylist() for k in (2, 3, 4))
            made = [zlib.compress(block_exits(*own).tobytes(), 1) for own in zip(data, sizes, last)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.binary())], ["source", "block", "size", "exits"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, entry = None, 0
        for batch in batches:
            out = []
            for own, block, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if own != source:
                    source, entry = own, 0
                if entry == ENDED:
                    continue
                if entry >= size:  # a frame longer than the block
                    entry -= size
                    continue
                out.append((source, block, entry))
                entry = int(np.frombuffer(zlib.decompress(packed), dtype=np.int32)[entry])
            kinds = (pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, kinds)], ["source", "block", "entry"])

    made = blocks.mapInArrow(exits, "source string, block long, size int, exits binary")
    return made.repartition("source").sortWithinPartitions("source", "block").mapInArrow(chain, "source string, block long, entry int")


def frames_of_large_files(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Frames of files read as text lines ``(source, split, data, file_size)``, in order within a split, that line feeds cut.
    Any text reader's splits will do, so a file of any size is read by many tasks; each block is scanned in one."""
    pieces = write_table(_pieces(files.select("source", "split", "data")))
    blocks = write_table(_blocks(pieces, files.groupBy("source").agg(F.max("file_size").alias("file_size")), block_bytes))
    entered = blocks.join(_chained(blocks), ["source", "block"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, block, data, size, entry in batch.itertuples(index=False):
                rows = [(source, block * block_bytes + entry + at, *rest) for at, *rest in find_frames(bytes(data)[entry:]) if entry + at < size]
                yield pd.DataFrame(rows, columns=["source", "at", "message_type", "epoch", "frame", "float_value"])

    return entered.select("source", "block", "data", "size", "entry").mapInPandas(scan, FRAMES)


def read_radar(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Frames of a file or of a folder's files. Those of over ``whole_bytes`` are read in splits, others whole."""
    files = spark.read.format("binaryFile").load(path)
    frames = split_radar_frames(files.where(F.col("length") <= whole_bytes).select(F.col("_metadata.file_path").alias("path"), "content"))
    if files.where(F.col("length") > whole_bytes).select("length").isEmpty():
        return frames
    where = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).where(where["file_size"] > whole_bytes)
    large = lines.select(where["file_path"].alias("source"), where["file_block_start"].alias("split"), F.col("value").cast("binary").alias("data"), where["file_size"].alias("file_size"))
    return frames.unionByName(frames_of_large_files(large, block_bytes))


def unsigned(frame: str, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(F.col(frame), at + 1, n)), 16, 10).cast("long")


def signed(frame: str, at: int, n: int) -> Column:
    value = unsigned(frame, at, n)
    return F.when(value >= 1 << (8 * n - 1), value - (1 << 8 * n)).otherwise(value)


def _head() -> list[Column]:
    return [F.col("source"), F.col("at"), F.timestamp_seconds("epoch").alias("ts")]


def _track_id() -> Column:
    return F.format_string("TRK-%08d", unsigned("frame", 8, 4)).alias("track_id")


def decode_track_update(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("message_type") == TRACK_UPDATE).select(
        *_head(), _track_id(), (signed("frame", 12, 4) / 1e6).alias("latitude"), (signed("frame", 16, 4) / 1e6).alias("longitude"),
        (unsigned("frame", 20, 2) / 10.0).alias("speed_knots"), (unsigned("frame", 22, 2) / 10.0).alias("course"), F.col("float_value").alias("rcs_dbsm"),
        (unsigned("frame", 28, 2) / 10.0).alias("range_nm"), (unsigned("frame", 30, 2) / 10.0).alias("bearing"), unsigned("frame", 32, 1).cast("int").alias("quality"))


def decode_track_lost(frames: DataFrame) -> DataFrame:
    reason = unsigned("frame", 20, 1).cast("int")
    return frames.where(F.col("message_type") == TRACK_LOST).select(
        *_head(), _track_id(), (signed("frame", 12, 4) / 1e6).alias("last_latitude"), (signed("frame", 16, 4) / 1e6).alias("last_longitude"),
        reason.alias("reason"), lookup(config.LOST_REASON, reason, "Unknown").alias("reason_text"))


def decode_system_status(frames: DataFrame) -> DataFrame:
    station = F.trim(F.decode(F.substring("frame", 9, 8), "US-ASCII"), F.lit("\0"))
    return frames.where(F.col("message_type") == SYSTEM_STATUS).select(
        *_head(), station.alias("station_id"), (unsigned("frame", 16, 1) != 0).alias("operational"), unsigned("frame", 17, 2).cast("int").alias("tracks_active"), F.col("float_value").alias("rotation_rpm"))


def decode_heartbeat(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("message_type") == HEARTBEAT).select(*_head())
