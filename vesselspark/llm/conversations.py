"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of those that may be shared.

A turn is its SHA-256 digest. A prefix is the polynomial of its turns' digests modulo a prime of 256 bits, so the digests of
a conversation's prefixes can be put together from its parts, and a conversation is held in parts of bounded length.

A count-min sketch of all prefixes tells which cannot be shared: an estimate of one proves that a single conversation has
the prefix. What follows such a prefix is a chain that nobody else has; its nodes are made where they are. Only prefixes
with a greater estimate, and the first of a proven chain, are shuffled and grouped.

Sums over subtrees need no walk by levels. The least member of a node owns it. A conversation owns a prefix once it owns a
shorter one, so a member that doesn't own a node has all that it owns below that node. A node's sum is what its members own,
less what its owner owns above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.tables import drop_table, write_table

PART = 512  # turns of a conversation in one row
HEAD = 5  # turns that a rebuilt conversation takes at most
PRIME = 2**256 - 189
BASE = 0x9E3779B97F4A7C15F39CC0605CEDC8341082276BF3A27251F86C6A11D0C18E95
LEAST_BITS, MOST_BITS = 10, 26  # counters of a row of the sketch; one bit of each is broadcast
SLICE_BITS = 16
IDS_AT_ONCE = 4096
CROWDED = 4096
ROOT = b""
NOTHING = sha256(b"").hexdigest()


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, F.sha2(text.cast("binary"), 256))
    turns = conversations.where(F.col(f"`{conv_col}`").isNotNull())
    return turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(F.sha2(both.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("chars"))


def _parts(turns: DataFrame, part: int) -> tuple[DataFrame, bool]:
    """(conv, part, first, n, turns): up to ``part`` turns in order, the rank of the first, and all the conversation's turns.
    Long conversations are ranked in ranges of turns, whose sizes are added up; no group exceeds ``part`` rows."""
    item = F.struct("turn", "digest", "chars")
    long = write_table(turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > part))
    n_long = long.count()
    short = turns.join(F.broadcast(long) if n_long <= 10_000 else long, "conv", "left_anti") if n_long else turns
    rows = short.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    rows = rows.select("conv", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("first"), F.size("turns").cast("long").alias("n"), "turns")
    if n_long:
        mine = turns.join(F.broadcast(long) if n_long <= 10_000 else long, "conv")
        ranged = write_table(mine.repartitionByRange("conv", "turn", "digest").withColumn("range", F.spark_partition_id()))
        upto = ranged.groupBy("conv", "range").agg(F.count("*").alias("size"))
        upto = upto.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
        ranked = ranged.withColumn("own", F.row_number().over(Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), "digest")))
        ranked = ranked.join(upto, ["conv", "range"]).withColumn("rank", F.col("own") + F.col("before"))
        grouped = ranked.groupBy("conv", F.floor((F.col("rank") - 1) / part).cast("long").alias("part"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("ranked"))
        rows = rows.unionByName(grouped.select("conv", "part", (F.col("part") * part + 1).alias("first"), "n", F.transform("ranked", lambda r: r["item"]).alias("turns")))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))), bool(n_long)


def _rebuilt(rows: DataFrame, block: int, most: int) -> DataFrame:
    """The first turns of each conversation replaced by those of its block's first one: as many as its id draws."""
    heads = rows.where((F.col("part") == 0) & (F.col("conv") % block == 0)).select(F.col("conv").alias("leader"), F.slice("turns", 1, HEAD).alias("head"))
    leader = F.col("conv") - F.col("conv") % block
    drawn = F.when(leader == F.col("conv"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    joined = rows.withColumn("leader", leader).withColumn("h", drawn).join(heads, "leader", "left")
    none = F.array().cast("array<struct<digest:binary,chars:bigint>>")
    joined = joined.withColumn("head", F.when(F.col("h") > 0, F.expr("slice(head, 1, h)"))).withColumn("head", F.coalesce("head", none)).withColumn("k", F.size("head"))
    start = F.col("part") == 0
    own = F.expr("slice(turns, h + 1, size(turns))")
    return joined.select("conv", "part", F.when(start, 1).otherwise(F.col("first") - F.col("h") + F.col("k")).alias("first"),
                         (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"), F.when(start, F.concat("head", own)).otherwise(F.col("turns")).alias("turns"))


def _number(digest: bytes | None) -> int:
    return int.from_bytes(digest or b"", "big")


def prefix_digests(digests: list[bytes], first: int, before: int = 0) -> list[int]:
    """Digests of the prefixes that end in each of the turns, ``before`` being that of what precedes them."""
    power, total, found = pow(BASE, first, PRIME), before, []
    for digest in digests:
        total = (total + int.from_bytes(digest, "big") * power) % PRIME
        power = power * BASE % PRIME
        found.append(total)
    return found


def _prefixes(rows: DataFrame, several: bool) -> DataFrame:
    """(conv, part, first, n, before, prefixes, chars); ``before`` is the digest of the earlier parts, none for the first."""
    slim = rows.select("conv", "part", "first", "n", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))
    if several:
        slim = write_table(slim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, first, digests = (c.to_pylist() for c in batch.columns)
            made = [(prefix_digests(d, f) or [0])[-1].to_bytes(32, "big") for d, f in zip(digests, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["conv", "part", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            before = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total = total if conv == last else 0
                last = conv
                before.append(total.to_bytes(32, "big"))
                total = (total + _number(own)) % PRIME
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.binary())], ["conv", "part", "before"])

    if several:
        in_parts = slim.join(slim.where("part = 1").select("conv"), "conv", "left_semi").select("conv", "part", "first", "digests")
        sums = in_parts.mapInArrow(totals, "conv long, part long, total binary").repartition("conv").sortWithinPartitions("conv", "part")
        before = sums.mapInArrow(added, "conv long, part long, before binary").where("part > 0")
        slim = slim.join(before, ["conv", "part"], "left")
    else:
        slim = slim.withColumn("before", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "part", "first", "n", "before", "prefixes", "chars"]
        for batch in batches:
            made = [[x.to_bytes(32, "big") for x in prefix_digests(d, f, _number(b))] for d, f, b in zip(*(batch.column(k).to_pylist() for k in (5, 2, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.list_(pa.binary())), batch.column(6)], names)

    return slim.select("conv", "part", "first", "n", "before", "digests", "chars").mapInArrow(run, "conv long, part long, first long, n long, before binary, prefixes array<binary>, chars array<long>")


def counters(prefixes: list[bytes], bits: int) -> np.ndarray:
    """The two counters, one in each row of the sketch, of each prefix."""
    words = np.frombuffer(b"".join(prefixes), dtype=">u8").reshape(len(prefixes), 4)
    own = (words[:, :2] >> np.uint64(64 - bits)).astype(np.int64)
    own[:, 1] += 1 << bits
    return own


def sketch(prefixes: DataFrame, bits: int) -> bytes:
    """Which counters reached two, a bit each. Counting is a grouped sum; slices of bits are made in tasks."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [d for row in batch.column(0).to_pylist() for d in row]
            values, counts = np.unique(counters(own, bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(np.minimum(counts, 2), pa.int64())], ["counter", "n"])

    def packed(group: pa.Table) -> pa.Table:
        slice_of, inner = group.column("slice")[0], np.zeros(1 << SLICE_BITS, dtype=bool)
        inner[group.column("inner").to_numpy()] = True
        return pa.table({"slice": pa.array([slice_of.as_py()], pa.int64()), "packed": pa.array([np.packbits(inner).tobytes()], pa.binary())})

    reached = prefixes.select("prefixes").mapInArrow(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).where("n >= 2")
    sliced = reached.select(F.shiftright("counter", SLICE_BITS).alias("slice"), F.col("counter").bitwiseAND((1 << SLICE_BITS) - 1).alias("inner"))
    whole = bytearray(max(1, (2 << bits) >> SLICE_BITS) * (1 << SLICE_BITS) // 8)
    for row in sliced.groupBy("slice").applyInArrow(packed, "slice long, packed binary").toLocalIterator():  # 2 << MOST_BITS bits at most
        at = row.slice * (1 << SLICE_BITS) // 8
        whole[at : at + len(row.packed)] = row.packed
    return bytes(whole)


def _screened(prefixes: DataFrame, bits: int, several: bool) -> DataFrame:
    """With ``cut``: how many prefixes of the row go to the grouping; ``proven``: the last of them is a single one's."""
    spark = prefixes.sparkSession
    reached = spark.sparkContext.broadcast(sketch(prefixes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(reached.value, dtype=np.uint8)
        for batch in batches:
            rows = batch.column(5).to_pylist()
            own = counters([d for row in rows for d in row], bits)
            shared = ((bitmap[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1).all(axis=1)
            ends = np.cumsum([len(row) for row in rows])
            singles = np.flatnonzero(~shared)
            at = np.r_[singles, len(shared)][np.searchsorted(singles, ends - [len(row) for row in rows])]
            proven = at < ends
            cut = np.where(proven, at - ends + [len(row) + 1 for row in rows], [len(row) for row in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.int32()), pa.array(proven, pa.bool_())], [*batch.schema.names, "cut", "proven"])

    schema = "conv long, part long, first long, n long, before binary, prefixes array<binary>, chars array<long>, cut int, proven boolean"
    found = prefixes.mapInArrow(run, schema)
    if several:
        begun = found.where("proven").groupBy("conv").agg(F.min("part").alias("begun"))
        found = found.join(begun, "conv", "left").withColumn("cut", F.when(F.col("part") > F.col("begun"), 0).otherwise(F.col("cut"))).drop("begun")
    return found


def _listed(ended: DataFrame) -> DataFrame:
    """(digest, conv) -> (digest, ends): SHA-256 of the ids in ascending order, joined by commas. Ranges of ids become pieces
    of text in many tasks; a node's pieces then stream through one hash, which has to take them in order."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array(held[:1], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], ["digest", "least", "piece"])

        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (digest != last or len(held) == IDS_AT_ONCE):
                    yield flushed()
                    held = []
                last = digest
                held.append(conv)
        if held:
            yield flushed()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        result = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends"])
        for batch in batches:
            for digest, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest != last:
                    if state:
                        yield result()
                    last, state = digest, sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if state:
            yield result()

    cut = ended.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(pieces, "digest binary, least long, piece string")
    return cut.repartition("digest").sortWithinPartitions("digest", "least").mapInArrow(hashed, "digest binary, ends string")


def _id_digest(conv: Column) -> Column:
    return F.sha2(conv.cast("string").cast("binary"), 256)


def _grouped(sent: DataFrame) -> DataFrame:
    """Exact nodes of the prefixes that were sent: (conv, depth, digest, parent, chars, more, ended)."""
    nodes = sent.groupBy("depth", "digest").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), F.min("parent").alias("parent"), F.max("chars").alias("chars"), F.max("more").alias("more"),
        F.sum(F.col("ended").cast("long")).alias("n_ends"), F.min(F.when(F.col("ended"), F.col("conv"))).alias("end"))
    nodes = write_table(nodes)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("kids"))
    valued = write_table(nodes.join(kids, "digest", "left").withColumn("leaf", F.col("kids").isNull().cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars")))
    before = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = valued.select("digest", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_above") for c in ("leaf", "saved")))
    owned = valued.groupBy(F.col("owner").alias("conv")).agg(F.sum("leaf").alias("leaf_owned"), F.sum("saved").alias("saved_owned"))
    members = sent.select("conv", "digest").join(owned, "conv", "left").groupBy("digest").agg(*(F.coalesce(F.sum(f"{c}_owned"), F.lit(0)).alias(f"{c}_all") for c in ("leaf", "saved")))
    # parents of many children go to every task: at most 10,000, as kids are not more than nodes
    most = max(CROWDED, nodes.count() // 10_000)
    parents = valued.select(F.col("digest").alias("parent"), F.col("owner").alias("parent_conv"), "kids")
    crowded = F.broadcast(parents.where(F.col("kids") > most).select("parent", F.col("parent_conv").alias("known")))
    found = valued.join(crowded, "parent", "left").withColumn("looked_up", F.when(F.col("known").isNull(), F.col("parent")).otherwise(F.col("digest")))
    found = found.join(parents.select(F.col("parent").alias("looked_up"), "parent_conv"), "looked_up", "left").withColumn("parent_conv", F.coalesce("known", "parent_conv"))
    lists = _listed(sent.where("ended and not single").select("digest", "conv"))
    found = found.join(members, "digest").join(above, "digest").join(lists, "digest", "left")
    ends = F.when(F.col("n_ends") == 0, F.lit(NOTHING)).when(F.col("n_ends") == 1, _id_digest(F.col("end"))).otherwise(F.col("ends"))
    result = write_table(found.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("kids", F.lit(0)) + F.col("more").cast("long")).alias("n_children"), (F.col("leaf_all") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("saved_all") - F.col("saved_above")).alias("saved_tokens"), ends.alias("ends_sha256")))
    drop_table(nodes)
    drop_table(valued)
    return result


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                block: int | None = 100, most: int = HEAD + 1, part: int = PART, bits: int | None = None) -> DataFrame:
    """The distinct prefixes of all conversations, from the root without a turn: ``(conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256)``. A node is named by its depth and its least member; ``saved_tokens``
    sums, over its subtree, the code points of each node's last text times its members but one; ``ends_sha256`` is of the
    ids of those that end there. With ``block``, each conversation c first takes the first h turns of conversation
    c - c % block in place of its own first h, h being crc32 of c modulo ``most``; without, they are as they are.

    Turns are ordered by ``turn``, null first; those that tie by SHA-256 of role and text, so repeated rows are turns of
    their own in a fixed order. A null role or text is empty; rows with a null id are of no conversation. Texts are hashed
    where they lie and may be of any length, conversations too. An empty table gives an empty one."""
    if part < HEAD or most > HEAD + 1:
        raise ValueError("a part must hold the turns that are taken over")
    rows, several = _parts(_turns(conversations, conv_col, turn_col, role_col, text_col), part)
    prefixes = write_table(_prefixes(_rebuilt(rows, block, most) if block else rows, several))
    n = prefixes.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    bits = bits or min(MOST_BITS, max(LEAST_BITS, (4 * n).bit_length()))
    screened = _screened(prefixes, bits, several)
    depth = F.col("first") + F.col("at")
    each = F.posexplode(F.arrays_zip("prefixes", "chars")).alias("at", "own")
    shared = screened.select("*", F.posexplode(F.expr("slice(arrays_zip(prefixes, chars), 1, cut)")).alias("at", "own"))
    parent = F.when(F.col("at") > 0, F.expr("prefixes[at - 1]")).otherwise(F.coalesce("before", F.lit(ROOT)))
    single = F.col("proven") & (F.col("at") == F.col("cut") - 1)
    lengths = prefixes.where("part = 0").select("conv", "n")
    sent = shared.select("conv", depth.alias("depth"), F.col("own.prefixes").alias("digest"), parent.alias("parent"), F.col("own.chars").alias("chars"), single.alias("single"),
                         (single & (depth < F.col("n"))).alias("more"), (depth == F.col("n")).alias("ended"))
    roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"),
                           F.lit(False).alias("single"), F.lit(False).alias("more"), (F.col("n") == 0).alias("ended"))
    sent = write_table(sent.unionByName(roots))
    nodes = _grouped(sent)
    drop_table(sent)
    tail = screened.select("conv", "first", "n", "cut", each).where("at >= cut").select("conv", depth.alias("depth"), "n")
    one = F.lit(1).cast("long")
    tails = tail.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
                        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), _id_digest(F.col("conv"))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    return nodes.unionByName(tails)
