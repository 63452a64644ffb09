"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (``max_sample`` vectors): it alternates between the signs of the rotated
vectors and the rotation that best fits them, as iterative quantisation does. Each vector's code is the signs after it,
and is cut into substrings of eight bits. By pigeonhole, of two codes within a Hamming radius r = q m + a, m being the number
of substrings, one of the first a + 1 substrings differs by at most q bits or one of the others by at most q - 1. So every
block of vectors has a table for each substring from its 256 values to rows; a query probes the values within that many
bits, complete codes of the rows found are compared, and rows within the radius are ranked by the inner product of the
original vectors in doubles.

The radius is the least that gives the wanted recall on the sample, found there by brute force. Codes are made once. A
block's tables are built once for each part of the queries, a stated set, which stream through them; a block returns at
most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.blocks import as_bytes, as_matrix, usable
from vesselspark.meetings import BLOCK, block_of, blocks_of, everywhere, meet
from vesselspark.tables import write_table

MAX_SAMPLE = 4000
SAMPLE_QUERIES = 400
BITS_A_SUBSTRING = 8
QUERY_PART = 8192
RECALL = 0.94
POPCOUNT = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]).astype(np.uint8)
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Coder:
    """Codes are the signs of ``(v - mean) @ rotation``, as bytes: one substring each."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int = 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def learn_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 11) -> Coder:
    """A square rotation, padded by random directions to a whole number of substrings."""
    length = sample.shape[1]
    bits = -(-length // BITS_A_SUBSTRING) * BITS_A_SUBSTRING
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    rotation = np.linalg.qr(rng.normal(size=(length, length)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(centred.T @ np.sign(centred @ rotation))
        rotation = left @ right
    return Coder(mean, np.hstack([rotation, rng.normal(size=(length, bits - length))]))


def distances(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Hamming distances of all of ``codes`` to all of ``others``."""
    total = np.zeros((len(codes), len(others)), dtype=np.uint16)
    for k in range(codes.shape[1]):
        total += POPCOUNT[codes[:, k]][:, others[:, k]]
    return total


def fit(sample: np.ndarray, k: int, recall: float = RECALL) -> Coder:
    """The rotation, and the radius at which the sample's first queries find that share of their k nearest. A larger
    table has nearer neighbours, so its recall is no less."""
    coder = learn_rotation(sample)
    codes, queries = coder.codes(sample), sample[:SAMPLE_QUERIES]
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    nearest = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    needed = np.take_along_axis(distances(codes[: len(queries)], codes), nearest, axis=1)
    coder.radius = int(np.quantile(needed, recall, method="higher")) if needed.size else coder.codes(sample).shape[1] * BITS_A_SUBSTRING
    return coder


def whole(codes: np.ndarray) -> np.ndarray:
    """Complete codes as rows of 64-bit words."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : codes.shape[1]] = codes
    return padded.view(np.uint64)


class Index:
    """A block's substring tables: for each substring, rows in order of its value and how many have each value."""

    def __init__(self, codes: np.ndarray):
        self.whole = whole(codes)
        self.rows = [np.argsort(codes[:, k], kind="stable") for k in range(codes.shape[1])]
        self.counts = [np.bincount(codes[:, k], minlength=256) for k in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius, by probing and then complete distances."""
        reach, rest = divmod(radius, len(code))
        seen = np.zeros(len(self.whole), dtype=bool)
        for k, (value, rows, counts) in enumerate(zip(code, self.rows, self.counts)):
            seen[rows[np.repeat(POPCOUNT[value] <= reach - (k > rest), counts)]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.whole[found] ^ whole(code[None, :])).sum(axis=1) <= radius]


class CodedBlock:
    """A block's index and original vectors; each query's ``k`` best within the radius."""

    def __init__(self, rows: pa.Table, coder: Coder, kind: str, k: int):
        self.ids, self.coder, self.kind, self.k = rows.column("id").to_numpy(), coder, kind, k
        self.vectors = as_matrix(rows.column("vector"), kind).astype(np.float64)
        self.index = Index(as_matrix(rows.column("code"), "u1"))

    def ask(self, rows: pa.Table) -> pa.RecordBatch:
        found: list[tuple[int, int, float]] = []
        queries, codes = as_matrix(rows.column("vector"), self.kind).astype(np.float64), as_matrix(rows.column("code"), "u1")
        for own, query, code in zip(rows.column("id").to_pylist(), queries, codes):
            near = self.index.within(code, self.coder.radius)
            near = near[self.ids[near] != own]
            if not len(near):
                continue
            score = np.einsum("ij,j->i", self.vectors[near], query)
            if len(near) > self.k:
                top = score >= np.partition(score, len(near) - self.k)[len(near) - self.k]  # with all ties of the k-th
                near, score = near[top], score[top]
            best = np.lexsort((self.ids[near], -score))[: self.k]
            found += zip([own] * len(best), self.ids[near][best].tolist(), score[best].tolist())
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 3, kinds)], ["query_id", "vec_id", "score"])

    def end(self) -> None:
        return None


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK, query_part: int = QUERY_PART, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query``, a condition on the column ``id``, holds for,
    its ``k`` largest inner products found among all other rows, largest first and ties to the smaller id. A query that
    finds fewer than ``k`` within the radius searches again in twice the radius, until all codes are within it, so it
    gets ``k`` rows or all there are. Vectors that are null, zero or hold null or non-finite components take no part;
    vectors of different lengths never meet. Rows that repeat an id are one vector, the least of theirs. An empty table, or
    one without a query, gives none."""
    fine = write_table(usable(vectors, id_col, vector_col))
    given = vectors.schema[vector_col].dataType
    kind = "<f4" if given.elementType.typeName() == "float" else "<f8"  # bytes that hold the original numbers
    results = []
    for length, count in fine.groupBy(F.size("vector").alias("n")).count().collect():
        rows = fine.where(F.size("vector") == length)
        sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_sample).collect()
        coder = fit(np.array([r.vector for r in sample]), k)
        coded = write_table(_coded(rows, coder, kind))
        wanted = coded.where(is_query)
        n_wanted = wanted.count()
        while True:
            found = write_table(_search(coded, count, wanted, n_wanted, coder, kind, k, block, query_part))
            results.append(found)
            if coder.radius >= coder.rotation.shape[1]:
                break
            full = found.groupBy("query_id").count().where(F.col("count") >= min(k, count - 1))
            short = wanted.join(full.select(F.col("query_id").alias("id")), "id", "left_anti")
            wanted = write_table(short)
            n_wanted = wanted.count()
            if not n_wanted:
                break
            coder.radius = min(2 * coder.radius + 1, coder.rotation.shape[1])
    if not results:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = results[0]
    for found in results[1:]:
        every = every.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _coded(rows: DataFrame, coder: Coder, kind: str) -> DataFrame:
    """``(id, code, vector)``, the last two as bytes."""
    fixed = rows.sparkSession.sparkContext.broadcast(coder)  # a square of the vectors' length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(fixed.value.codes(matrix)), as_bytes(matrix.astype(kind))], ["id", "code", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "id long, code binary, vector binary")


def _search(rows: DataFrame, count: int, wanted: DataFrame, n_wanted: int, coder: Coder, kind: str, k: int, block: int, query_part: int) -> DataFrame:
    fixed = rows.sparkSession.sparkContext.broadcast(coder)
    n_blocks, n_parts = blocks_of(count, block), blocks_of(n_wanted, query_part)
    return meet(rows, wanted, block_of(F.col("id"), n_blocks), everywhere(n_blocks), n_blocks, n_parts, lambda own: CodedBlock(own, fixed.value, kind, k), FOUND)
