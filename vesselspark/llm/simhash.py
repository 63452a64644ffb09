"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints with at most four
differing bits have at most one differing bit in some segment. So each fingerprint enters the table of each
segment under its own key, and probes the keys of the Hamming ball of radius one around it. Of a pair that
differs in one bit of a segment only the side that has the bit set needs to probe, hence probes clear one set
bit. Rows of one (segment, key) meet in one sorted run, where complete distances are verified.

Equal fingerprints are one row from the start. A run reports a spanning forest of its links, not all pairs. A
key that holds more than ``hot`` fingerprints is cut into chunks by hash, and every two chunks meet in a run of
their own, so no task holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.components import connected_components
from vesselspark.tables import write_table

SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4
HOT_KEY = 8192
SMALL_RUN = 8


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash over ``width``-word shingles of the ASCII-lower-cased text; zero if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, 42)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    values = np.array([hashed(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def forest(fps: np.ndarray, n_exact: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span what the first ``n_exact`` fingerprints reach within the run, those after them being
    probes, which are compared with the first ones only. Rows already reached are never compared again."""
    found, free = [], np.ones(len(fps), dtype=bool)
    for seed in range(n_exact):
        if not free[seed]:
            continue
        free[seed] = False
        waiting = [seed]
        while waiting:
            at = waiting.pop()
            left = np.flatnonzero(free if at < n_exact else free[:n_exact])
            if not len(left):
                continue
            hits = left[_close(fps[left], fps[at])]
            if len(hits):
                free[hits] = False
                found.append((np.full(len(hits), fps[at]), fps[hits]))
                waiting.extend(hits.tolist())
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, probe, fp) sorted by run, probe -> links (a, b)."""
    rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64)]

    def links(run: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[starts, len(run)])
        exact = np.add.reduceat(~probe, starts)
        a, b = [], []
        small = np.repeat((sizes <= SMALL_RUN) & (sizes > 1) & (exact > 0), sizes)
        run_s, probe_s, fp_s = run[small], probe[small], fp[small]
        for lag in range(1, SMALL_RUN):
            if len(fp_s) <= lag:
                break
            hit = (run_s[lag:] == run_s[:-lag]) & ~probe_s[:-lag] & _close(fp_s[lag:], fp_s[:-lag])
            a.append(fp_s[:-lag][hit])
            b.append(fp_s[lag:][hit])
        for k in np.flatnonzero((sizes > SMALL_RUN) & (exact > 0)):
            for left, right in forest(fp[starts[k] : starts[k] + sizes[k]], int(exact[k])):
                a.append(left)
                b.append(right)
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        run, probe, fp = (np.concatenate([x, y.view(x.dtype) if y.dtype != x.dtype else y]) for x, y in zip(rest, new))
        cut = int(np.searchsorted(run, run[-1])) if len(run) else 0
        if cut:
            yield links(run[:cut], probe[:cut], fp[:cut])
        rest = [run[cut:], probe[cut:], fp[cut:]]
    if len(rest[0]):
        yield links(*rest)


def _cleared(key: Column, tag: Column, width: int) -> Column:
    """A probe for each set bit of ``key``: the key without it."""
    bits = F.filter(F.array(*[F.lit(1 << k) for k in range(width)]), lambda bit: key.bitwiseAND(bit) != 0)
    return F.transform(bits, lambda bit: F.struct((key - bit + tag).alias("bucket"), F.lit(True).alias("probe")))


def _keys(fps: DataFrame, probes: bool) -> DataFrame:
    """(bucket, probe, fp): a bucket is the segment's number and key."""
    rows = []
    for number, (shift, width) in enumerate(SEGMENTS):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(number << 32)
        rows.append(F.array(F.struct((key + tag).alias("bucket"), F.lit(False).alias("probe"))))
        if probes:
            rows.append(_cleared(key, tag, width))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("k")).select("k.bucket", "k.probe", "fp")


def _hot_keys(fps: DataFrame, hot: int) -> DataFrame:
    """(bucket, chunks) of buckets that hold or are probed from a key of more than ``hot`` fingerprints."""
    crowded = _keys(fps, probes=False).groupBy("bucket").count().where(F.col("count") > hot)
    chunks = F.ceil(F.col("count") / hot).cast("int")
    bits = F.array(*[F.lit(1 << k) for k in range(max(w for _, w in SEGMENTS))])
    around = F.transform(F.filter(bits, lambda bit: F.col("bucket").bitwiseAND(bit) != 0), lambda bit: F.col("bucket") - bit)
    near = F.explode(F.concat(F.array("bucket"), around)).alias("bucket")
    return crowded.select(near, chunks.alias("chunks")).groupBy("bucket").agg(F.max("chunks").alias("chunks"))


def near_links(fps: DataFrame, hot: int = HOT_KEY) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``(a, b)`` that join the same components as all pairs with at most
    four differing bits do."""
    keyed = _keys(fps, probes=True)
    crowded = write_table(_hot_keys(fps, hot))
    n_hot = crowded.count()
    if n_hot:
        small = F.broadcast(crowded) if n_hot <= 10_000 else crowded
        keyed = keyed.join(small, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        keyed = keyed.select("bucket", "probe", "fp", own.alias("own"), other.alias("other"))
        tile = F.struct("bucket", F.least("own", "other"), F.greatest("own", "other"))
        keyed = keyed.select(F.xxhash64(tile).alias("bucket"), "probe", "fp")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_KEY) -> DataFrame:
    """``(id, fp, component_id)``: the fingerprint of each row's whole text and the smallest id that links of at
    most four differing bits reach. A null text counts as empty; texts without a word have fingerprint zero and
    are linked like any others. Rows with a null id keep a row and never name a component, unless nothing else
    does, which gives null. An empty table gives no rows; other columns are not read."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = write_table(base.mapInArrow(_fingerprints, "id long, fp long"))
    least = write_table(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(least.select("fp"), hot))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(table, "fp").select("id", "fp", "component_id")
