"""Vector search by cosine, ranked-list fusion and hybrid retrieval. Vectors are arrays of any one length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.meetings import BLOCK, PART, block_of, blocks_of, everywhere, meet
from vesselspark.operators.filters import match_filters
from vesselspark.tables import write_table

BATCH = 50


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: words hashed to signed places, at unit length."""

    def embed_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[value % dim] += 1 if value >> 63 else -1
            row /= max(1e-12, float(np.linalg.norm(row)))
        return out

    return embed_texts


def embed(df: DataFrame, embedder: Callable[[list[str]], np.ndarray], text_col: str = "content", dim: int = 64, failed_col: str | None = None) -> DataFrame:
    """``df`` with ``embedding``, in batches of BATCH texts; a batch that fails gets vectors of zeros, a null text too. With
    ``failed_col`` a column of that name tells the rows of batches that failed."""

    @F.pandas_udf("embedding array<float>, failed boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list[float]] = []
            failed: list[bool] = []
            for at in range(0, len(part), BATCH):
                texts = part.iloc[at : at + BATCH]
                wrong = False
                try:
                    vectors = np.asarray(embedder([x or "" for x in texts]), dtype=np.float32)
                except Exception:  # whatever a model raises, the batch has no vectors
                    vectors, wrong = np.zeros((len(texts), dim), dtype=np.float32), True
                found += [v.tolist() for v in vectors]
                failed += [wrong] * len(texts)
            yield pd.DataFrame({"embedding": found, "failed": failed})

    made = df.withColumn("__made", run(F.col(text_col))).withColumn("embedding", F.col("__made.embedding"))
    return (made.withColumn(failed_col, F.col("__made.failed")) if failed_col else made).drop("__made")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def cosine(vector: str, query: list[float]) -> Column:
    """Null for a vector of zeros."""
    fixed = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    length = float(np.sqrt(np.dot(query, query)))
    return F.when((norm > 0) & F.lit(length > 0), dot(F.col(vector), fixed) / (norm * length))


def _nearest(df: DataFrame, query: list[float], least: float, k: int, key: str) -> DataFrame:
    found = df.withColumn("similarity", cosine("embedding", query)).where(F.col("similarity") >= least)
    return found.orderBy(F.desc("similarity"), key).limit(k)


def search_documents(docs: DataFrame, query: list[float], document_type: str | None = None, threshold: float | None = None, k: int = 10, key: str = "id") -> DataFrame:
    """The ``k`` nearest with a cosine of at least ``threshold`` (None: 0.5)."""
    docs = docs.where(F.col("document_type") == document_type) if document_type else docs
    return _nearest(docs, query, 0.5 if threshold is None else threshold, k, key)


def search_track_history(history: DataFrame, query: list[float], start: datetime | None = None, end: datetime | None = None, threshold: float | None = None, k: int = 10, key: str = "id") -> DataFrame:
    """Windows that begin at ``start`` or later and end by ``end``, each if given."""
    history = history.where(F.col("window_start") >= F.lit(start)) if start else history
    history = history.where(F.col("window_end") <= F.lit(end)) if end else history
    return _nearest(history, query, 0.5 if threshold is None else threshold, k, key)


def search_anomalies(anomalies: DataFrame, query: list[float], source_type: str | None = None, threshold: float | None = None, k: int = 10, key: str = "id") -> DataFrame:
    anomalies = anomalies.where(F.col("source_type") == source_type) if source_type else anomalies
    return _nearest(anomalies, query, 0.5 if threshold is None else threshold, k, key)


def search_all(docs: DataFrame, history: DataFrame, anomalies: DataFrame, query: list[float], limit: int = 10, threshold: float | None = None) -> DataFrame:
    """A third of ``limit`` from each, tagged with where it is from, the nearest first."""
    k = limit // 3
    parts = {"documents": search_documents(docs, query, None, threshold, k), "track_history": search_track_history(history, query, None, None, threshold, k),
             "anomalies": search_anomalies(anomalies, query, None, threshold, k)}
    found = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("source"), "id", "content", "similarity")
        found = part if found is None else found.unionByName(part)
    return found.orderBy(F.desc("similarity"), "source", "id").limit(limit)


def item_id(columns: list[str]) -> Column:
    """The first of the usual ids that is not empty, else a hash of the row."""
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("track_id", "id", "mmsi", "ship_name") if c in columns]
    return F.coalesce(*ids, F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


#: A list of up to so many items is ranked by one window.
SHORT_LIST = 10_000


def ranked(df: DataFrame, position: str = "position", short: int = SHORT_LIST) -> DataFrame:
    """``df`` with ``rank``, from zero, by ``position``; those that tie by all of their columns. A long list is cut into
    ranges of positions, and a row's rank is what the ranges before its own hold and its place within it."""
    names = [c for c in df.columns if c != position]
    order = [F.col(position), F.to_json(F.struct(*names))]
    if df.limit(short + 1).count() <= short:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranges = write_table(df.repartitionByRange(*order).withColumn("rank_range", F.spark_partition_id()))
    sizes = ranges.groupBy("rank_range").agg(F.count("*").alias("rank_size"))  # a row a partition
    before = F.sum("rank_size").over(Window.orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("rank_range", F.coalesce(before, F.lit(0)).alias("rank_before"))
    within = F.row_number().over(Window.partitionBy("rank_range").orderBy(*order))
    return ranges.join(F.broadcast(sizes), "rank_range").withColumn("rank", F.col("rank_before") + within - 1).drop("rank_range", "rank_before")


def rrf_fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = config.RRF_K, short: int = SHORT_LIST) -> DataFrame:
    """Ranked lists of any length with an order column ``position`` -> ``item_id, fusion_score, payload``, best first. A list
    adds its weight over k plus the rank from zero, once for each time it holds the item. The payload, as JSON, is of the
    first list that has the item, but the last one of the structured list. Ties keep the order of lists, then ranks."""
    weights = weights or config.RRF_WEIGHTS
    every = None
    for place, (name, df) in enumerate(lists.items()):
        fields = [c for c in df.columns if c != "position"]
        part = ranked(df, "position", short).select(item_id(fields).alias("item_id"), "rank", F.to_json(F.struct(*fields)).alias("payload"))
        part = part.select("item_id", "rank", "payload", F.lit(place).alias("place"), (F.lit(float(weights[name])) / (k + F.col("rank"))).alias("score"),
                           F.struct(F.lit(place).alias("list"), (-F.col("rank") if name == "structured" else F.col("rank")).alias("at")).alias("order"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("item_id").agg(F.sum("score").alias("fusion_score"), F.min_by("payload", "order").alias("payload"), F.min(F.struct("place", "rank")).alias("first"))
    return fused.orderBy(F.desc("fusion_score"), "first").drop("first")


def hybrid_search(structured: DataFrame, semantic: DataFrame, live: DataFrame, filters: dict, n_live: int = 50) -> DataFrame:
    """Structured rows, nearest documents and the first live tracks that match, fused. Each has a column ``position``."""
    live = match_filters(live.orderBy("position").limit(n_live), filters)
    return rrf_fuse({"structured": structured, "semantic": semantic, "realtime": live})


#: Queries that are multiplied with a block at once.
ASKED = 512


class VectorBlock:
    """Unit vectors of a block by their length; each query's ``k`` nearest among those as long as it."""

    def __init__(self, rows: pa.Table, k: int):
        self.k = k
        self.groups = {size: (keys[order], vectors[order]) for size, (keys, vectors) in unit_rows(rows).items() for order in [np.argsort(keys, kind="stable")]}

    def ask(self, rows: pa.Table) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for size, (ids, asked) in unit_rows(rows).items():
            if size not in self.groups:
                continue
            keys, vectors = self.groups[size]
            k = min(self.k, len(keys))
            for at in range(0, len(ids) if k else 0, ASKED):
                scores = asked[at : at + ASKED] @ vectors.T
                least = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
                for query, row, low in zip(ids[at : at + ASKED], scores, least):
                    near = np.flatnonzero(row >= low)  # in the order of keys
                    near = near[np.argsort(-row[near], kind="stable")][:k]
                    for column, values in zip(out, (np.full(k, query), keys[near], row[near])):
                        column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "key", "similarity"])

    def end(self) -> None:
        return None


def unit_rows(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors, by the length of the vectors."""
    column = rows.column("embedding").combine_chunks()
    keys, lengths = rows.column(0).to_numpy(), np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths
    found = {}
    for size in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == size)
        matrix = values[starts[own][:, None] + np.arange(size)]
        found[size] = keys[own], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return found


def batch_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, key, similarity)``: the ``k`` nearest of each query ``(query_id, embedding)``. Documents lie in
    blocks that queries stream through; a block returns its best ``k`` a query. A query meets vectors of its own length; rows
    without a key or a vector, or with components null or not finite, take no part."""
    fine = F.col("key").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = docs.select(F.col(key).cast("long").alias("key"), "embedding").where(fine)
    asked = queries.select(F.col("query_id").cast("long").alias("key"), "embedding").where(fine)
    n_blocks, n_parts = blocks_of(rows.count(), block), blocks_of(asked.count(), PART)
    found = meet(rows, asked, block_of(F.col("key"), n_blocks), everywhere(n_blocks), n_blocks, n_parts, lambda own: VectorBlock(own, k), "query_id long, key long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "similarity")
