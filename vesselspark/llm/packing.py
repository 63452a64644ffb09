"""Best-fit packing by minimum bin slack.

Only lengths decide how pieces go together, and there are at most ``capacity`` different ones, so the plan is made
from the histogram of lengths, a table of bounded size. For the next bin a subset-sum programme over the available
lengths, its states bits of an integer, finds the fullest combination that contains the longest length left. The
combination is removed as often as the counts allow at once, since it stays the fullest one until a length runs out.
Pieces are then numbered within their length by counts per input partition, and each number has its place in the plan.
"""

from __future__ import annotations

import base64
import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.tables import write_table


CAPACITY = 1024
END_ID = 2
CACHED_WORDS = 1_000_000
#: Fixed value: how the byte-level tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_SPACE = re.compile(r"[^\S \n]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The byte-level tokenizer always starts a token at a line feed between two characters that are not white space, at
    the character after it, and at a blank between two such characters. So words are encoded once and remembered: by
    the same vocabulary as ranks, which is faster word by word. Texts with other white space, with white space side by
    side or at an end, or with a special token's string are encoded whole."""

    def __init__(self, path: str, ranks_path: str, cached_words: int):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.cached_words = cached_words
        self.feed = self._word("\n")

    def _word(self, word: str) -> bytes:
        if word[-1:] in ".,!?;:" and word[:-1].strip(" ").isalpha():  # a mark after letters is a split of its own
            return self._remembered(word[:-1]) + self._remembered(word[-1])
        ids = self.words.encode_ordinary(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remembered(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._word(word)
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        lines = [line.split(" ") for line in text.split("\n")]
        if any("" in words for words in lines) or OTHER_SPACE.search(text) or any(x in text for x in self.specials):
            return self._whole(text)
        known, out = self.known, []
        for words in lines:
            words = [words[0], *[" " + w for w in words[1:]]]
            found = list(map(known.get, words))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        found[k] = self._remembered(words[k])
            out.append(b"".join(found))
        if len(known) > self.cached_words:
            known.clear()
        return self.feed.join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, ranks_path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    """One encoder, with its memory of words, per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, ranks_path, cached_words)
    return _encoders[path]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one if need be."""
    first = n_ids % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n_ids, capacity))]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """The pieces of every row's whole text, with the partition they came from and their number among the
    partition's pieces of that length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encode = encoder(tokenizer_path, ranks_path, cached_words).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                block = batch.slice(at, 256)
                texts = [x or "" for x in block.column(1).to_pylist()]
                for doc, text in zip(block.column(0).to_pylist(), texts):
                    ids = encode(text) + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        out.append((doc, k, start, length, crc, part, seen[length]))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the available lengths, the combination with the largest sum within ``capacity`` that has the longest one."""
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    items: list[tuple[int, int]] = []  # (length, copies), copies in powers of two so that any number can be made up
    for length in sorted(counts, reverse=True):
        most, copies = min(counts[length] - (length == longest), room // length), 1
        while most > 0:
            take = min(copies, most)
            items.append((length, take))
            most -= take
            copies *= 2
    reached, states = 1, [1]
    for length, take in items:
        reached |= (reached << (length * take)) & mask
        states.append(reached)
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    used = {longest: 1}
    for k in range(len(states) - 1, 0, -1):
        if not states[k - 1] >> total & 1:
            length, take = items[k - 1]
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, its pieces' places: (first number, first bin, offset, how many bins), by first number. A bin's
    combination is laid out longest first; the runs of equal combinations lie in bins of consecutive numbers."""
    left = {k: v for k, v in counts.items() if v}
    taken, places, bins = dict.fromkeys(left, 0), {k: [] for k in left}, 0
    while left:
        used = fullest(left, capacity)
        times = min(left[length] // n for length, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                places[length].append((taken[length], bins, offset, times))
                taken[length] += times
                offset += length
            left[length] -= used[length] * times
            if not left[length]:
                del left[length]
        bins += times
    return places


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null text counts as
    empty and gives a piece of the end id alone; null and repeated ids keep their rows; an empty table gives none. A text
    of any length is encoded whole and cut into pieces of ``capacity`` ids."""
    pieces = write_table(tokenized_pieces(docs, tokenizer_path, ranks_path, capacity, end_id, id_col, text_col, cached_words))
    parts = pieces.groupBy("part", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = write_table(parts.select("part", "length", "count", F.coalesce(before, F.lit(0)).alias("before")))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    places = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))  # bounded by `capacity` as well

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {length: [p[0] for p in found] for length, found in places.value.items()}
        for batch in batches:
            sequence, offset = [], []
            for length, number in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                at = bisect.bisect_right(starts[length], number) - 1
                first, first_bin, where, _ = places.value[length][at]
                sequence.append(first_bin + number - first)
                offset.append(where)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], OUT)

    OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # one row of counts for each partition and length, so they grow with the input and are merged, not broadcast
    numbered = pieces.join(parts.select("part", "length", "before").hint("merge"), ["part", "length"])
    numbered = numbered.select(*OUT[:5], (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
