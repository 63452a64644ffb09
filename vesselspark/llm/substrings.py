"""Substring dedup with FM-indexes over shards.

A window is ``window`` consecutive words. Its anchor is the least hash of its runs of eight words, so equal windows
have equal anchors. Consecutive windows of a document with one anchor are a run; a run's words, from its first window's
start to its last one's end, are its segment. Only anchors that occur twice matter: their segments go to the shard of
their anchor, where equal segments are one row. Per shard an FM-index is built over the segments, and each segment is
streamed through it by backward search; stretches of windows that occur twice are reported and carried back to all
places of the segment.

An anchor with more than ``hot`` different segments is cut into chunks, every two of which share an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.common import unused
from vesselspark.llm.fmindex import DEPTH, FMIndex, repeated_windows
from vesselspark.tables import drop_table, write_table

WINDOW = 35
GRAM = 8
MOST_WINDOWS = 64  # of a segment; longer runs are cut, each window being in one piece
HOT = 512
WORDS_AN_INDEX = 300_000
STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def runs(words: list[bytes], window: int) -> list[tuple[int, int, int, int]]:
    """(anchor, first window, windows, 2 if the anchor's gram repeats within the text else 1), runs cut to MOST_WINDOWS."""
    gram = min(GRAM, window)
    if len(words) < window:
        return []
    own = hashes(words)
    grams = np.zeros(len(own) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams = grams * STEP + own[k : len(own) - gram + 1 + k]
    grams = (grams ^ (grams >> np.uint64(31))) * MIX
    grams ^= grams >> np.uint64(29)
    least, width, wanted = grams, 1, window - gram + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wanted > width:
        least = np.minimum(least[: -(wanted - width)], least[wanted - width :])
    values, counts = np.unique(grams, return_counts=True)
    again = values[counts > 1]
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    sizes = np.diff(np.r_[first, len(least)])
    anchors = least[first]
    places = np.searchsorted(again, anchors)
    repeats = 1 + (again[np.minimum(places, len(again) - 1)] == anchors) if len(again) else np.ones(len(first), np.int64)
    found = []
    for anchor, at, size, repeat in zip(anchors.view(np.int64).tolist(), first.tolist(), sizes.tolist(), repeats.tolist()):
        found += [(anchor, at + k, min(MOST_WINDOWS, size - k), repeat) for k in range(0, size, MOST_WINDOWS)]
    return found


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                block = batch.slice(at, 256)
                for doc, text_hash, text in zip(*(c.to_pylist() for c in block.columns)):
                    rows += [(doc, text_hash, *r) for r in runs(_words(text), window)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], NAMES)

    NAMES = ["doc", "text_hash", "anchor", "first", "windows", "repeats"]
    return docs.mapInArrow(run, "doc long, text_hash long, anchor long, first int, windows int, repeats int")


def _cut_out(joined: DataFrame, window: int) -> DataFrame:
    """(doc, text_hash, text, runs) -> one row per run, with its segment."""
    names = ["doc", "text_hash", "anchor", "first", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows: list[tuple] = []
                block = batch.slice(at, 128)
                for doc, text_hash, text, own in zip(*(c.to_pylist() for c in block.columns)):
                    words = _words(text)
                    rows += [(doc, text_hash, r["anchor"], r["first"], b" ".join(words[r["first"] : r["first"] + r["windows"] + window - 1])) for r in own]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

    return joined.mapInArrow(run, "doc long, text_hash long, anchor long, first int, segment binary")


def search_shard(segments: list[bytes], copies: list[int], window: int) -> list[tuple[int, int, int]]:
    """Build an index of the segments, those with more copies twice, and stream each through it."""
    split = [s.split() for s in segments]
    lengths = np.array([len(w) for w in split])
    _, numbers = np.unique(hashes([w for words in split for w in words]), return_inverse=True)
    numbers = numbers.astype(np.int64) + 1
    cuts = np.r_[0, np.cumsum(lengths)]
    parts, starts, at = [], [], 0
    separator = np.zeros(1, dtype=np.int64)
    for k, copy in enumerate(copies):
        starts.append(at)
        for _ in range(min(copy, 2)):
            parts += [numbers[cuts[k] : cuts[k + 1]], separator]
            at += int(lengths[k]) + 1
    symbols = np.concatenate(parts)
    return repeated_windows(FMIndex(symbols, max(DEPTH, window)), symbols, np.array(starts), lengths, window)


def _searched(tiles: DataFrame, window: int) -> DataFrame:
    """Rows (tile, anchor, segment_hash, copies, segment) sorted by tile -> (anchor, segment_hash, at, words): stretches
    of repeated words. Whole tiles are gathered into an index of about WORDS_AN_INDEX words."""
    names = ["anchor", "segment_hash", "at", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: set[tuple] = set()  # a segment may come with several tiles of its anchor
        size, last = 0, None

        def result() -> pa.RecordBatch:
            found = search_shard([r[4] for r in rows], [r[3] for r in rows], window)
            out = [(rows[k][1], rows[k][2], at, n + window - 1) for k, at, n in found]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= WORDS_AN_INDEX:
                    yield result()
                    rows, held, size = [], set(), 0
                last = row[0]
                if row[1:3] not in held:
                    held.add(row[1:3])
                    rows.append(row)
                    size += row[4].count(b" ") + 1
        if rows:
            yield result()

    return tiles.mapInArrow(run, "anchor long, segment_hash long, at int, words int")


def _tiles(segments: DataFrame, hot: int) -> DataFrame:
    """Distinct segments dealt to shards by their anchor, those of hot anchors to all pairs of chunks with their own."""
    counts = segments.groupBy("anchor").count().where(F.col("count") > hot)
    crowded = write_table(counts.select("anchor", F.ceil(F.col("count") / hot).cast("int").alias("chunks")))
    number = crowded.count()
    if not number:
        return segments.withColumn("tile", F.col("anchor"))
    small = F.broadcast(crowded) if number <= 10_000 else crowded
    marked = segments.join(small, "anchor", "left").withColumn("own", F.pmod("segment_hash", F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("own"))
    marked = marked.withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)))
    tile = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
    return marked.withColumn("tile", tile).drop("chunks", "own", "other")


def repeated_stretches(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``docs(doc, text_hash, text)`` -> ``(doc, text_hash, stretches)``: arrays of (at, words), which may overlap, that
    together are the words of windows whose words also start elsewhere."""
    anchored = write_table(_anchored(docs, window))
    # rows with equal doc and text are the same place in ``anchored`` twice, so they count as two
    twice = anchored.groupBy("anchor").agg(F.sum("repeats").alias("n")).where("n > 1").select("anchor")
    wanted = anchored.join(twice, "anchor", "left_semi").groupBy("doc", "text_hash")
    wanted = write_table(wanted.agg(F.collect_set(F.struct("anchor", "first", "windows")).alias("runs")))
    left, right = docs.alias("d"), wanted.alias("w")
    joined = left.join(right, F.expr("d.doc <=> w.doc and d.text_hash = w.text_hash")).select("d.doc", "d.text_hash", "text", "runs")
    places = write_table(_cut_out(joined, window).withColumn("segment_hash", F.xxhash64("segment")))
    drop_table(anchored)
    segments = write_table(places.groupBy("anchor", "segment_hash").agg(F.first("segment").alias("segment"), F.count("*").alias("copies")))
    tiles = _tiles(segments, hot).select("tile", "anchor", "segment_hash", "copies", "segment")
    found = write_table(_searched(tiles.repartition("tile").sortWithinPartitions("tile", "segment_hash"), window))
    drop_table(segments)
    stretch = F.struct((F.col("first") + F.col("at")).alias("at"), "words")
    back = places.drop("segment").join(found, ["anchor", "segment_hash"]).select("doc", "text_hash", stretch.alias("stretch"))
    result = write_table(back.groupBy("doc", "text_hash").agg(F.collect_set("stretch").alias("stretches")))
    drop_table(places)
    drop_table(wanted)
    return result


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT,
                   names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """Each row with three columns more: how many words it has, how many of them a repeated window covers, and the others,
    joined by blanks. Words are runs of anything but ASCII white space; windows are judged on the input. A null text has
    no words; null ids keep their rows; a row that repeats another is another place, so their windows are repeated.
    A text of any length is
    taken whole; an empty table gives none. The columns of ``docs`` are passed through; a name of theirs among ``names`` is
    an error."""
    if {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns named {names} exist already")
    text_hash, doc, other, own, words = unused(docs.columns, "text_hash", "doc", "other", "stretches", "words")
    keyed = docs.withColumn(text_hash, F.xxhash64(F.col(text_col)))
    slim = keyed.select(F.col(id_col).cast("long").alias("doc"), F.col(text_hash).alias("text_hash"), F.col(text_col).alias("text"))
    stretches = repeated_stretches(slim, window, hot).toDF(doc, other, own)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(text_hash) == F.col(other))
    joined = keyed.join(stretches, same, "left").select(*docs.columns, F.col(text_col).alias(words), own)
    columns, carried = [*docs.columns, *names], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(carried).to_pylist(), batch.column(carried + 1).to_pylist()):
                kept = _words(text)
                n = len(kept)
                if found:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for r in found:
                        gone[r["at"]] += 1
                        gone[r["at"] + r["words"]] -= 1
                    kept = [w for w, k in zip(kept, np.cumsum(gone).tolist()) if not k]
                rows.append((n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            extra = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *extra], columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{name}` {kind}" for name, kind in zip(names, ("long", "long", "string"))]
    return joined.mapInArrow(run, ", ".join(fields))
