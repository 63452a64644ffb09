"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over a model's pieces reads a text once. At each position its output links give all pieces
that end there, the longest first, and each relaxes the best score of a segmentation up to the position; the best path
is then read back. Of equal scores the one with the longer last piece stays. A character that no piece covers is spelt
in the model's byte pieces, at a cost below that of any piece.

Blanks become the mark ``▁``, and a text gets one at its start. A mark that the text itself holds is spelt in bytes, which
no blank is, so decoding gives back every text exactly. No piece has the mark after another character, so a text falls
into parts that start with marks; each part is encoded once per worker and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
PENALTY = 10.0
CACHED_PARTS = 500_000


class PieceCodec:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        """``pieces`` by id, those that stand for no text as empty strings; ``byte_ids``: the ids of the 256 bytes."""
        import ahocorasick

        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        byte_of = {k: bytes([b]) for b, k in enumerate(byte_ids)}
        self.spelling = [byte_of.get(k, p.replace(MARK, " ").encode()) for k, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has the mark of a blank after another character")
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), k, scores[k]))
        self.automaton.make_automaton()
        self.spelt = min((s for p, s in zip(pieces, scores) if p), default=0.0) - PENALTY
        self.mark = np.array([byte_ids[b] for b in MARK.encode()], dtype="<u4").tobytes(), self.spelt
        self.known: dict[str, tuple[bytes, float]] = {}

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        text = [not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) for k in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(k) if t else "" for k, t in zip(ids, text)], [model.get_score(k) for k in ids], byte_ids)

    def _best(self, part: str) -> tuple[bytes, float]:
        """The ids of a part's best segmentation, as little-endian 32-bit bytes, and its score."""
        n = len(part)
        best, last = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        done = 0  # positions up to here are settled
        for end, (length, piece, score) in self.automaton.iter(part):
            while done < end:  # no more pieces end before this one
                done += 1
                self._spell(best, last, done)
            at = end + 1 - length
            value = best[at] + score
            if value > best[end + 1]:
                best[end + 1], last[end + 1] = value, (at, piece)
        while done < n:
            done += 1
            self._spell(best, last, done)
        ids: list[int] = []
        at = n
        while at:
            before, piece = last[at]
            ids += [self.byte_ids[b] for b in reversed(part[before:at].encode("utf-8", "surrogatepass"))] if piece < 0 else [piece]
            at = before
        return np.array(ids[::-1], dtype="<u4").tobytes(), best[n]

    def _spell(self, best: list[float], last: list[tuple[int, int]], end: int) -> None:
        value = best[end - 1] + self.spelt
        if value > best[end]:
            best[end], last[end] = value, (end - 1, -1)

    def encode(self, text: str) -> tuple[bytes, float]:
        first, *others = text.split(MARK)
        ids, score = self._encode(MARK + first)
        if not others:
            return ids, score
        rest = [self._encode(x) for x in others]
        return ids + b"".join(self.mark[0] + more for more, _ in rest), score + sum(self.mark[1] + value for _, value in rest)

    def _encode(self, text: str) -> tuple[bytes, float]:
        parts = PART.findall(text.replace(" ", MARK))
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
        found = list(map(self.known.get, parts))
        if None in found:
            for k, own in enumerate(found):
                if own is None:
                    part = parts[k]
                    found[k] = self.known[part] = self.known.get(part) or self._best(part)
        return b"".join([ids for ids, _ in found]), sum(score for _, score in found)

    def decode(self, ids: bytes) -> str:
        spelt = map(self.spelling.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(spelt).decode("utf-8", "surrogatepass")[1:]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec, with its memory of parts, per worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec.load(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, score)`` of every row's whole text, ``ids`` an array of ints. A null text counts as empty, which is one
    mark; null and repeated ids keep their rows; other columns are not read. A text of any length is encoded whole, part by
    part; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                found = [own.encode(x or "") for x in block.column(1).to_pylist()]
                cuts = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(i for i, _ in found), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(cuts), ids)
                yield pa.RecordBatch.from_arrays([block.column(0), lists, pa.array([s for _, s in found], pa.float64())], ["id", "ids", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, ids array<int>, score double")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(id, ids, ...)`` -> ``(id, n_ids, ids_crc32, text)``; null ids count as none, and the crc is of the ids as
    unsigned little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            rows = []
            for ids in batch.column(1).to_pylist():
                raw = np.array(ids or [], dtype="<u4").tobytes()
                rows.append((len(raw) // 4, zlib.crc32(raw), own.decode(raw)))
            columns = list(zip(*rows)) or [()] * 3
            extra = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *extra], ["id", "n_ids", "ids_crc32", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, n_ids long, ids_crc32 long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_ids, ids_crc32, score, exact)``: every text encoded, decoded again and compared; rows as of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block, rows = batch.slice(at, 256), []
                for text in block.column(1).to_pylist():
                    text = text or ""
                    ids, score = own.encode(text)
                    rows.append((len(ids) // 4, zlib.crc32(ids), score, own.decode(ids) == text))
                extra = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([block.column(0), *extra], ["id", "n_ids", "ids_crc32", "score", "exact"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, n_ids long, ids_crc32 long, score double, exact boolean")
