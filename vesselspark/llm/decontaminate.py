"""Benchmark decontamination by a generalised suffix automaton.

The words of test items are numbered, and one automaton holds all their substrings. A document's words stream through it;
at each word it is known how long the longest string of words is that ends there and occurs in an item. From ``window``
words on, all of these words are hit, and the state of the last ``window`` words tells the items. Items of fewer words count
as a whole: each is the longest string of its state, so they lie on the way up the suffix links.

Items are cut into overlapping pieces of bounded length, and pieces are dealt to shards of bounded size. One shard goes to
every task and nothing is shuffled; of more, each shard's automaton is built in tasks of its own and the documents are sent
to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.common import unused
from vesselspark.meetings import block_of, everywhere, meet

WINDOW = 10
#: Bytes of items in an automaton: what a task holds at once, and the most that goes through the driver.
SHARD_BYTES = 1_000_000
PIECE_WORDS = 4096
#: Bytes to words: other ASCII separates, A-Z become a-z, all beyond ASCII belongs to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IN_WORD = np.array([c != 32 for c in _TABLE])


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TABLE).split()


class Automaton:
    """Of items ``(name, words)``; no item without words. ``window`` states and whole short items know their items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: dict[int, set[str | None]] = {}
        self.short: set[int] = set()
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items]
        ends = [self._add(codes) for _, codes in coded]
        self.least = min([window, *(len(codes) for _, codes in coded)])
        for (name, codes), end in zip(coded, ends):
            if len(codes) < window:
                self.short.add(end)
                self.names.setdefault(end, set()).add(name)
            state = 0
            for k, code in enumerate(codes):
                state = self.go[state][code]
                if k + 1 >= window:
                    self.names.setdefault(self._cut(state), set()).add(name)
        # the nearest state of a whole short item, itself or up the links; links lead to shorter strings
        self.above = [0] * len(self.go)
        if self.short:
            for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
                self.above[state] = state if state in self.short else self.above[self.link[state]]

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of a string of at least as many."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _copy(self, of: int, length: int) -> int:
        self.go.append(dict(self.go[of]))
        self.length.append(length)
        self.link.append(self.link[of])
        return len(self.go) - 1

    def _add(self, codes: list[int]) -> int:
        last = 0
        for code in codes:
            last = self._extend(last, code)
        return last

    def _extend(self, last: int, code: int) -> int:
        go, link, length = self.go, self.link, self.length
        known = go[last].get(code)
        if known is not None:  # another item has this string
            return known if length[known] == length[last] + 1 else self._split(last, code, known)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, state = len(go) - 1, last
        while state >= 0 and code not in go[state]:
            go[state][code] = new
            state = link[state]
        if state >= 0:
            at = go[state][code]
            link[new] = at if length[at] == length[state] + 1 else self._split(state, code, at)
        return new

    def _split(self, state: int, code: int, at: int) -> int:
        """The shorter strings of ``at``, those that end in ``state`` and ``code``, get a state of their own."""
        clone = self._copy(at, self.length[state] + 1)
        self.link[at] = clone
        while state >= 0 and self.go[state].get(code) == at:
            self.go[state][code] = clone
            state = self.link[state]
        return clone

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(disjoint ascending stretches of hit words, end exclusive; names of the items whose windows occur)"""
        go, link, length, least, window = self.go, self.link, self.length, self.least, self.window
        root, state, size = go[0], 0, 0
        found: list[tuple[int, int]] = []
        states: set[int] = set()
        for at, code in enumerate(map(self.number.get, words)):
            if code is None:
                state = size = 0
                continue
            following = go[state].get(code)
            if following is not None:
                size += 1
                state = following
            else:
                while state and (following := go[state].get(code)) is None:
                    state = link[state]
                    size = length[state]
                if not state:
                    following = root[code]
                state = following
                size += 1
            if size < least:
                continue
            covered = 0
            if size >= window:
                covered = size
                states.add(self._cut(state))
            up = self.above[state]
            if up and length[up] > size:
                up = self.above[link[up]]
            while up:
                covered = max(covered, length[up])
                states.add(up)
                up = self.above[link[up]]
            if covered:
                low = at + 1 - covered
                while found and found[-1][1] >= low:
                    low = min(low, found.pop()[0])
                found.append((low, at + 1))
        return found, set().union(*(self.names[s] for s in states)) if states else set()


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending stretches with the same words."""
    result: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if result and low <= result[-1][1]:
            result[-1] = result[-1][0], max(high, result[-1][1])
        else:
            result.append((low, high))
    return result


def places(data: bytes, stretches: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The code points that stretches of words lie at, end exclusive."""
    if not stretches:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.r_[False, _IN_WORD[raw], False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    upto = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [{"start": int(upto[starts[low]]), "end": int(upto[ends[high - 1]])} for low, high in stretches]


FIELDS = [("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("items", "array<string>", pa.list_(pa.string())),
          ("spans", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _row(data: bytes, n_words: int, stretches: list[tuple[int, int]], names: set[str | None]) -> tuple:
    return n_words, sum(high - low for low, high in stretches), sorted(n for n in names if n is not None), places(data, stretches)


def _pieces(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(key, id, text): items in pieces that share window - 1 words, each window in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                cut = [b" ".join(words[k : k + PIECE_WORDS + window - 1]) for k in range(0, max(1, len(words) - window + 1), PIECE_WORDS)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.binary())], ["id", "text"])

    named = items.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return named.mapInArrow(run, "id string, text binary").select(F.xxhash64("id", "text").alias("key"), "id", "text")


class _Shard:
    def __init__(self, rows: pa.Table, window: int) -> None:
        self.automaton = Automaton([(n, t.split()) for n, t in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())], window)

    def ask(self, rows: pa.Table) -> pa.RecordBatch:
        out = []
        for key, name, text in zip(*(c.to_pylist() for c in rows.columns)):
            stretches, names = self.automaton.hits(words_of(text))
            if stretches:
                out.append((key, name, [{"start": low, "end": high} for low, high in stretches], sorted(n for n in names if n is not None)))
        kinds = (pa.int64(), pa.string(), FIELDS[3][2], FIELDS[2][2])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["key", "id", "stretches", "names"])

    def end(self) -> None:
        return None


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans"), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each row of ``docs`` with four columns more: how many words it has, how many of them are hit, the ids as strings,
    ascending, of the items that have a window in it, and the code points of the stretches of hit words, end exclusive.

    Words are runs of a-z, 0-9 and anything beyond ASCII, after A-Z are lower-cased. Windows are ``window`` consecutive words
    of an item; an item of fewer, but not none, is one window. A null text has no words; an item with a null id hits, but
    is not listed; repeated items and rows change nothing; ids that are equal are one item. Without items nothing is hit, and
    an empty table gives an empty one. Texts and items of any length are taken whole. The columns of ``docs`` are passed
    through; a name of theirs among ``names`` is an error."""
    if {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns named {names} exist already")
    cut = _pieces(items, item_col, item_text_col, window)
    size = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    columns, carried = [*docs.columns, *names], len(docs.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {kind}" for n, (_, kind, _) in zip(names, FIELDS)])
    free = unused(docs.columns, "text", "key", "id", "stretches", "names")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")

    def extended(block: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        extra = [pa.array(c, kind) for c, (_, _, kind) in zip(list(zip(*rows)) or [()] * 4, FIELDS)]
        return pa.RecordBatch.from_arrays([*block.columns[:carried], *extra], columns)

    if size <= shard_bytes:
        held = [(r.id, bytes(r.text)) for r in cut.collect()]  # shard_bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([(n, t.split()) for n, t in held], window)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    block, rows = batch.slice(at, 512), []
                    for data in block.column(carried).to_pylist():
                        words = words_of(data)
                        rows.append(_row(data, len(words), *automaton.hits(words)))
                    yield extended(block, rows)

        return docs.select("*", text.alias(free[0])).mapInArrow(run, schema)

    n_shards = -(-size // shard_bytes)
    key, name = F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{id_col}`").cast("string")
    asked = docs.select(key.alias("key"), name.alias("id"), text.alias("text"))
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism // n_shards)
    met = meet(cut, asked, block_of(F.xxhash64("key", "id"), n_shards), everywhere(n_shards), n_shards, parts, lambda rows: _Shard(rows, window),
               f"key long, id string, stretches {FIELDS[3][1]}, names array<string>")
    met = met.groupBy("key", "id").agg(F.flatten(F.collect_list("stretches")).alias("stretches"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    keyed = docs.select("*", text.alias(free[0]), key.alias(free[1]), name.alias(free[2]))
    met = met.toDF("met_key", "met_id", "met_stretches", "met_names")
    own = keyed.alias("d").join(met.alias("m"), keyed[free[1]].eqNullSafe(met.met_key) & keyed[free[2]].eqNullSafe(met.met_id), "left")
    own = own.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"d.`{free[0]}`"), F.col("m.met_stretches").alias(free[3]), F.col("m.met_names").alias(free[4]))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                block, rows = batch.slice(at, 512), []
                for data, stretches, found in zip(*(block.column(carried + k).to_pylist() for k in range(3))):
                    one = joined([(s["start"], s["end"]) for s in stretches or []])
                    rows.append(_row(data, len(words_of(data)), one, set(found or [])))
                yield extended(block, rows)

    return own.mapInArrow(combine, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without what they share with ``items``: rows of which more than ``most_coverage`` of the words are hit go, and
    the hit stretches of the others, each at least ``window`` words or a whole item, are cut out of their texts. Texts
    without a hit stay as they are, as do null ones. Columns are those of ``docs``."""
    found = find_items(docs, items, window, id_col, text_col, names=(names := tuple(unused(docs.columns, "n_words", "n_hit", "items", "spans"))), **more)
    kept = found.where(F.col(names[1]) <= F.col(names[0]) * most_coverage)
    text, spans = f"`{text_col}`", f"`{names[3]}`"
    gap = f"transform(sequence(0, size({spans})), k -> substring({text}, cast(if(k = 0, 0, element_at({spans}, k).end) + 1 as int), "
    gap += f"cast(if(k = size({spans}), length({text}), element_at({spans}, k + 1).start) - if(k = 0, 0, element_at({spans}, k).end) as int)))"
    cut = F.expr(f"if(size({spans}) > 0, array_join({gap}, ''), {text})")
    return kept.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
