"""Fill-in-middle over content-defined chunks.

A text's bytes are cut where a rolling hash of the last WINDOW bytes says so, so texts that share a passage share its
chunks, wherever it stands. What has to be known of a chunk is kept by its content: its code points, whether it holds a
sentinel, and its two last bytes, as a sentinel may lie across a border. The sums of the chunks' counts tell in which chunk
a document's cut lies; only that chunk is looked into.

Nothing is shuffled: summaries are shared within a task, in two generations of bounded size. Any chunking gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.common import unused

WINDOW = 16
LEAST, MOST = 256, 8192
BORDER_BITS = 10  # one place in 1024 is a border
SLAB = 1 << 20
CACHE_BYTES = 16 << 20
CONTINUATION = bytes(range(0x80, 0xC0))
SENTINELS = (b"<P>", b"<S>", b"<M>")
STEP, MIX = 0x01000193, np.uint32(0x9E3779B1)


def _marks(data: bytes) -> list[int]:
    """Ascending places where a chunk may end: the WINDOW bytes before hash to a border, and a code point starts."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found = []
    for at in range(0, len(raw) - WINDOW, SLAB):
        part = raw[at : at + SLAB + WINDOW]
        hashed, width = (part.astype(np.uint32) + np.uint32(1)) * MIX, 1
        while width < WINDOW:
            hashed = hashed[:-width] * np.uint32(pow(STEP, width, 1 << 32)) + hashed[width:]
            width *= 2
        places = np.flatnonzero((hashed[: len(part) - WINDOW] * MIX) >> np.uint32(32 - BORDER_BITS) == 0) + WINDOW
        found.append(places[(part[places] & 0xC0) != 0x80] + at)
    return np.concatenate(found).tolist() if found else []


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end: LEAST to MOST bytes each (some more where a code point would be cut), but the last."""
    ends, at, n = [], 0, len(data)
    marks = _marks(data) if n > LEAST else []
    while n - at > LEAST:
        k = bisect_left(marks, at + LEAST)
        end = at + MOST
        if k < len(marks) and marks[k] < end:
            end = marks[k]
        else:
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
        if end >= n:
            break
        ends.append(end)
        at = end
    return [*ends, n] if n else []


class Summaries:
    """Summaries of chunks by their content. A dictionary of bytes compares the content itself, so chunks whose hashes
    agree by chance stay apart. When CACHE_BYTES of content are young, they become the old ones, and the old ones go."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.size, self.met = limit, 0, 0
        self.young: dict[bytes, tuple[int, bool]] = {}
        self.old: dict[bytes, tuple[int, bool]] = {}

    def of(self, chunk: bytes) -> tuple[int, bool]:
        """(code points, whether a sentinel lies in it)"""
        known = self.young.get(chunk)
        if known is not None:
            self.met += 1
            return known
        known = self.old.get(chunk)
        if known is None:
            known = len(chunk.translate(None, CONTINUATION)), any(s in chunk for s in SENTINELS)
        else:
            self.met += 1
        if self.size + len(chunk) > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[chunk] = known
        self.size += len(chunk)
        return known


class Parts:
    """A text as its chunks' summaries put together."""

    def __init__(self, data: bytes, summaries: Summaries) -> None:
        self.data, self.ends, self.upto, self.marked = data, chunk_ends(data), [], False
        at, total, tail = 0, 0, b""
        for end in self.ends:
            chunk = data[at:end]
            count, marked = summaries.of(chunk)
            across = tail + chunk[:2]
            self.marked = self.marked or marked or any(s in across for s in SENTINELS)
            total += count
            self.upto.append(total)
            tail, at = (tail + chunk[-2:])[-2:], end
        self.n = total

    def byte_of(self, place: int) -> int:
        """Where the code point number ``place`` starts."""
        if place >= self.n:
            return len(self.data)
        k = bisect_right(self.upto, place)
        at, before = (self.ends[k - 1], self.upto[k - 1]) if k else (0, 0)
        if self.upto[k] - before == self.ends[k] - at:
            return at + place - before
        chunk = np.frombuffer(self.data, dtype=np.uint8, count=self.ends[k] - at, offset=at)
        return at + int(np.flatnonzero((chunk & 0xC0) != 0x80)[place - before])


def draws(seed: int, name: str) -> list[int]:
    digest = sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(data: bytes, name: str, summaries: Summaries, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and of middle, output)"""
    parts = Parts(data, summaries)
    h1, h2, h3, h4 = draws(seed, name)
    if not parts.n or parts.marked or h3 % 100 >= fim_percent:
        return parts.n, "plain", None, None, data
    first, second = sorted((h1 % (parts.n + 1), h2 % (parts.n + 1)))
    low, high = parts.byte_of(first), parts.byte_of(second)
    prefix, middle, suffix = data[:low], data[low:high], data[high:]
    if h4 % 100 < spm_percent:
        return parts.n, "spm", first, second - first, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return parts.n, "psm", first, second - first, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20,
                   names: tuple[str, str, str, str, str] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """Each row with five columns more: its code points, its form, how many of them are prefix and middle (null if plain),
    and the text for training. The draws of a document are those of its seed and id, so repeated rows give equal output and
    a rerun the same. Of documents ``fim_percent`` are cut, of these ``spm_percent`` with the suffix first.

    A null text is empty, an empty one plain, as is one that holds a sentinel; a null id draws as an empty one. A text of any
    length is one row and is chunked in slabs. An empty table gives an empty one. The columns of ``docs`` are passed through;
    a name of theirs among ``names`` is an error."""
    if {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns named {names} exist already")
    columns, carried = [*docs.columns, *names], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                block = batch.slice(at, 512)
                keys, texts = (block.column(carried + k).to_pylist() for k in range(2))
                rows = [transformed(t, k, summaries, seed, fim_percent, spm_percent) for k, t in zip(keys, texts)]
                made = list(zip(*rows))
                extra = [pa.array(c, kind) for c, kind in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*block.columns[:carried], *extra, pa.array(made[4], pa.binary()).view(pa.string())], columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{name}` {kind}" for name, kind in zip(names, ("long", "string", "long", "long", "string"))]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    free = unused(docs.columns, "key", "text")
    return docs.select("*", key.alias(free[0]), text.alias(free[1])).mapInArrow(run, ", ".join(fields))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from. A cut text holds no sentinel and no border makes one, so
    the three inserted ones split the output into its parts."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
