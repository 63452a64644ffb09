"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised once to int8 with a scale of their own; what that takes off is quantised
to int8 again, on a scale 254 times finer. The norms of what each step leaves off are kept. For two vectors x = x' + dx
and y = y' + dy, the product x.y differs from x'.y' by at most |x'||dy| + |dx||y|. A tile multiplies first codes exactly;
pairs whose bounds lie on one side of the threshold are decided. Those in between take the second codes, and what is still
open, a few in a hundred thousand, leaves the tile and is recomputed from the doubles.

A block's vectors are met by those of half the other blocks, so every two blocks meet once. A tile returns the number of
links of each of its vectors and links that span its components, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.blocks import as_bytes, as_matrix, pieces, usable
from vesselspark.llm.components import connected_components
from vesselspark.meetings import BLOCK, PART, block_of, blocks_of, meet
from vesselspark.tables import write_table

ROWS_AT_ONCE = 1024
FOUND = "a long, b long, links long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled by their largest component first, so that no square under- or overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


class Quantised:
    """First and second codes of unit vectors, and for each vector: the scale, and bounds of the norms of what the codes of
    one or two steps stand for and of what they leave off."""

    COLUMNS = ("codes", "finer", "bounds")

    def __init__(self, codes: np.ndarray, finer: np.ndarray, bounds: np.ndarray):
        self.first, self.finer = codes, finer
        self.scale, self.norm, self.lost, self.finer_norm, self.finer_lost = bounds.T
        # a sum of int8 products over fewer than 1040 components is an integer below 2**24, which float32 holds exactly
        self.codes = codes.astype(np.float32 if codes.shape[1] < 1040 else np.float64)

    @classmethod
    def of(cls, units: np.ndarray) -> Quantised:
        scale = np.abs(units).max(axis=1) / 127
        codes = np.rint(units / scale[:, None])
        coded = codes * scale[:, None]
        finer = np.clip(np.rint((units - coded) / (scale[:, None] / 254)), -127, 127)
        both = coded + finer * (scale[:, None] / 254)
        slack = 1 + 1e-9  # for the rounding of the bounds themselves
        norms = [np.sqrt((x**2).sum(axis=1)) * slack + (1e-12 if off else 0) for x, off in ((coded, 0), (units - coded, 1), (both, 0), (units - both, 1))]
        return cls(codes.astype(np.int8), finer.astype(np.int8), np.stack([scale, *norms], axis=1))

    @classmethod
    def read(cls, rows: pa.Table) -> Quantised:
        return cls(*(as_matrix(rows.column(c), kind) for c, kind in zip(cls.COLUMNS, ("i1", "i1", "<f8"))))

    def written(self) -> list[pa.Array]:
        return [as_bytes(x) for x in (self.first, self.finer, np.stack([self.scale, self.norm, self.lost, self.finer_norm, self.finer_lost], axis=1))]

    def restored(self, rows: np.ndarray) -> np.ndarray:
        return (self.first[rows] + self.finer[rows] / 254.0) * self.scale[rows, None]


def linked(a: Quantised, b: Quantised, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the rows of ``a`` have a cosine of the threshold or more with which rows of ``b``, and the rows and columns
    of the pairs that two steps of codes leave open."""
    near = (a.codes[rows] @ b.codes.T) * (a.scale[rows, None].astype(np.float32) * b.scale[None, :].astype(np.float32))
    # the bound, with room for the three float32 roundings above
    widest = float(a.norm[rows].max() * b.lost.max() + a.lost[rows].max() + 1e-6)
    result = near >= threshold + widest
    left, right = np.nonzero((near >= threshold - widest) & ~result)
    own = left + rows.start
    error = a.norm[own] * b.lost[right] + a.lost[own] + 1e-6
    value = near[left, right].astype(np.float64)
    result[left, right] = value >= threshold + error
    between = np.flatnonzero(np.abs(value - threshold) <= error)
    still: list[np.ndarray] = []
    for part in pieces(len(between), 1 << 16):
        k = between[part]
        value = np.einsum("ij,ij->i", a.restored(own[k]), b.restored(right[k]))
        error = a.finer_norm[own[k]] * b.finer_lost[right[k]] + a.finer_lost[own[k]] + 1e-12
        result[left[k], right[k]] = value >= threshold + error
        still.append(k[np.abs(value - threshold) <= error])
    k = np.concatenate(still) if still else np.empty(0, np.int64)
    return result, own[k], right[k]


class Tile:
    """A block's vectors. Rows of the result: (a, b, 0) for links that span components, (a, b, null) for pairs still open,
    and (a, null, n) for links found of a vector."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.ids, self.codes, self.threshold = rows.column("id").to_numpy(), Quantised.read(rows), threshold
        self.block = rows.column("own")[0].as_py()
        self.order = np.argsort(self.ids)
        self.links = np.zeros(len(self.ids), np.int64)
        self.parent = np.arange(len(self.ids))

    def _root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    def ask(self, rows: pa.Table) -> pa.RecordBatch:
        ids, codes = rows.column("id").to_numpy(), Quantised.read(rows)
        home = rows.column("own").to_numpy() == self.block  # rows of the block itself, whose pairs count once
        n, links = len(self.ids), np.zeros(len(ids), np.int64)
        node = np.where(home, self.order[np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), n - 1)], n + np.arange(len(ids)))
        self.parent = np.r_[self.parent[:n], np.arange(n, n + len(ids))]
        found: list[tuple[int, int | None, int | None]] = []
        for part in pieces(n, ROWS_AT_ONCE):
            hits, left, right = linked(self.codes, codes, part, self.threshold)
            twice = home & (self.ids[part, None] >= ids[None, :])
            hits &= ~twice
            keep = ~twice[left - part.start, right]
            found += zip(self.ids[left[keep]].tolist(), ids[right[keep]].tolist(), [None] * int(keep.sum()))
            self.links[part] += hits.sum(axis=1)
            links += hits.sum(axis=0)
            for k in np.flatnonzero(hits.any(axis=1)):
                one, others = self._root(k + part.start), np.flatnonzero(hits[k])
                for other in others[self.parent[node[others]] != one]:
                    far = self._root(int(node[other]))
                    if far != one:
                        # a root of the block stays one, so that its vectors keep their parents when these rows go
                        low, high = sorted((one, far))
                        self.parent[high], one = low, low
                        found.append((int(self.ids[k + part.start]), int(ids[other]), 0))
        found += [(int(ids[k]), None, int(links[k])) for k in np.flatnonzero(links)]
        return self._batch(found)

    def end(self) -> pa.RecordBatch:
        return self._batch([(int(self.ids[k]), None, int(self.links[k])) for k in np.flatnonzero(self.links)])

    @staticmethod
    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found)) or [()] * 3], ["a", "b", "links"])


def _quantised(rows: DataFrame, own: Column) -> DataFrame:
    """``(id, own, codes, finer, bounds)`` of ``rows(id, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *Quantised.of(unit(matrix)).written()], ["id", "own", *Quantised.COLUMNS])

    return rows.select("id", own.alias("own"), "vector").mapInArrow(run, "id long, own long, codes binary, finer binary, bounds binary")


def half_of_blocks(own: Column, number: int) -> Column:
    """The blocks that a block's vectors go to: its own and those up to half way around before it."""
    reach = F.when(own * 2 >= number, (number - 1) // 2).otherwise(number // 2)
    return F.transform(F.sequence(F.lit(0).cast("long"), reach.cast("long")), lambda k: F.pmod(own - k, F.lit(number)))


def _settled(still: DataFrame, fine: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose cosine in doubles is the threshold or more."""
    left = fine.select(F.col("id").alias("a"), F.col("vector").alias("x"))
    both = still.join(left, "a").join(fine.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (unit(batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold))

    return both.mapInArrow(run, "a long, b long")


def vector_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each distinct id: the number of other vectors with a cosine of at least
    ``threshold``, the least id that links reach, and whether it is that one. Vectors that are null, zero or hold null
    or non-finite components, and such as have another length, link with nothing. Rows that repeat an id are one vector,
    the least of theirs; rows without an id give none, as does an empty table."""
    given = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    fine = write_table(usable(vectors, id_col, vector_col))
    found = settled = None
    for length, count in fine.groupBy(F.size("vector").alias("n")).count().collect():
        rows = fine.where(F.size("vector") == length)
        number = blocks_of(count, block)
        coded = write_table(_quantised(rows, block_of(F.col("id"), number)))
        tiles = write_table(meet(coded, coded, F.col("own"), half_of_blocks(F.col("own"), number), number, blocks_of(count, PART), lambda own: Tile(own, threshold), FOUND))
        open_pairs = _settled(tiles.where("links is null").select("a", "b"), rows, threshold)
        found = tiles if found is None else found.unionByName(tiles)
        settled = open_pairs if settled is None else settled.unionByName(open_pairs)
    if found is None:
        return given.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    settled = write_table(settled)
    one = F.lit(1).cast("long").alias("links")
    counts = found.where("b is null").select("a", "links").unionByName(settled.select("a", one)).unionByName(settled.select(F.col("b").alias("a"), one))
    counts = counts.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    links = found.where("b is not null and links = 0").select("a", "b").unionByName(settled)
    roots = connected_components(links).withColumnRenamed("node", "id")
    every = given.join(counts, "id", "left").join(roots, "id", "left")
    root = F.coalesce("root", "id")
    return every.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), root.alias("component_id"), (root == F.col("id")).alias("kept"))
