"""Every row asked against every row of a table, in blocks.

A table's rows are dealt into blocks of bounded size. Rows that ask are copied to each block they are to meet, and stream
through its task by batches after the block's own rows, which were gathered and prepared once. To split the work of a block
the rows that ask may be dealt into parts; each part has its own copy of the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block: what a task holds at once is bounded by it, whatever the input.
BLOCK = 8192
#: Rows that ask and share a copy of a block.
PART = 65_536
MOST_PARTITIONS = 20_000


class Block(Protocol):
    def ask(self, rows: pa.Table) -> pa.RecordBatch: ...

    def end(self) -> pa.RecordBatch | None: ...


def blocks_of(n_rows: int, size: int) -> int:
    return max(1, -(-n_rows // size))


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def everywhere(n_blocks: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))


def meet(rows: DataFrame, asked: DataFrame, block: Column, meets: Column, n_blocks: int, n_parts: int, prepare: Callable[[pa.Table], Block], schema: str) -> DataFrame:
    """``rows`` and ``asked`` have the same columns, the first a key. ``block``: of a row; ``meets``: the array of blocks
    that a row of ``asked`` goes to. ``prepare`` makes a block of its rows."""
    columns = rows.columns
    left = rows.select(block.alias("m_block"), F.explode(everywhere(n_parts)).alias("m_part"), F.lit(False).alias("m_asks"), *columns)
    part = F.pmod(F.xxhash64(columns[0], F.lit(1)), F.lit(n_parts)).cast("long")
    right = asked.select(F.explode(meets).alias("m_block"), part.alias("m_part"), F.lit(True).alias("m_asks"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [], None
        for batch in batches:
            heads = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            changed = (heads[0][1:] != heads[0][:-1]) | (heads[1][1:] != heads[1][:-1]) | (heads[2][1:] != heads[2][:-1])
            cuts = [0, *(changed.nonzero()[0] + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                own = (heads[0][low], heads[1][low])
                if own != key:
                    if made and (last := made.end()) is not None:
                        yield last
                    key, held, made = own, [], None
                rest = pa.RecordBatch.from_arrays(batch.slice(low, high - low).columns[3:], columns)
                if not heads[2][low]:
                    held.append(rest)
                    continue
                if made is None and held:
                    made, held = prepare(pa.Table.from_batches(held)), []
                if made:
                    yield made.ask(pa.Table.from_batches([rest]))
        if made and (last := made.end()) is not None:
            yield last

    dealt = left.unionByName(right).repartition(min(MOST_PARTITIONS, n_blocks * n_parts), "m_block", "m_part")
    return dealt.sortWithinPartitions("m_block", "m_part", "m_asks").mapInArrow(run, schema)
