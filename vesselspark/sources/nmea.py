"""AIS sentences: reading, checksums, reassembly and decoding of messages 1, 2, 3, 5 and 18. Checksums and fields are taken
batch by batch from Arrow columns, and messages are decoded by built-in expressions, each row once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark import config
from vesselspark.functions.casts import lookup
from vesselspark.tables import write_table

#: Characters by value, in steps of one: the six-bit alphabet has a gap of eight code points in the middle.
ARMOUR = "".join(chr(v + 48 if v < 40 else v + 56) for v in range(64))

#: Lines of a block, as a power of two.
BLOCK_BITS = 16


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    """``(source, at, line)``: stripped lines that start a sentence, with their file and order in it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    return lines.where(F.col("line").startswith("!") | F.col("line").startswith("$"))


def nmea_checksum_ok(line: Column) -> Column:
    """Whether the exclusive or of the characters between the start and the star is the two hex digits after it."""
    body = F.regexp_extract(line, r"^[!$](.*)\*[0-9A-Fa-f]{2}\s*$", 1)
    stated = F.conv(F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})\s*$", 1), 16, 10).cast("int")
    found = F.aggregate(F.transform(F.split(body, ""), F.ascii), F.lit(0), lambda a, x: a.bitwiseXOR(x))
    return F.coalesce((body != "") & (found == stated), F.lit(False))


#: A line with a checksum, as ``nmea_checksum_ok`` reads it.
_CHECKED = r"^[!$](?P<body>[^\n\r\x{85}\x{2028}\x{2029}]*)\*(?P<stated>[0-9A-Fa-f]{2})[ \t\n\x0b\f\r]*$"
_FIELDS = "source string, at long, line string, total int, number int, seq_id string, channel string, payload string, fill_bits int"


def checksums(bodies: pa.Array) -> np.ndarray:
    """The exclusive or of the characters of each body, none of which is empty."""
    bodies = pc.cast(bodies, pa.large_binary())
    bounds = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    found = np.bitwise_xor.reduceat(data, bounds[:-1] - bounds[0]).astype(np.int64)
    wide = np.logical_or.reduceat(data >= 128, bounds[:-1] - bounds[0])
    for k in wide.nonzero()[0]:  # of characters, not of bytes
        found[k] = np.bitwise_xor.reduce([ord(c) for c in bodies[int(k)].as_py().decode("utf-8", "replace")])
    return found


def _whole_numbers(texts: pa.Array) -> pa.Array:
    """Text as a number, null where it is none that fits."""
    digits = pc.struct_field(pc.extract_regex(texts, r"^[\x00-\x20]*(?P<sign>[+-]?)0*(?P<digits>[0-9]{1,10})[\x00-\x20]*$"), [1])
    value = pc.cast(digits, pa.int64())
    value = pc.if_else(pc.match_substring(texts, "-"), pc.negate(value), value)
    fits = pc.and_(pc.greater_equal(value, -(1 << 31)), pc.less(value, 1 << 31))
    return pc.cast(pc.if_else(fits, value, pa.scalar(None, pa.int64())), pa.int32())


def split_nmea(lines: DataFrame) -> DataFrame:
    """Sentence fields of checked lines; a line with fewer than seven parts or an unreadable number goes. Filters of later
    steps stay behind this one, so however a line is made, it is made once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.extract_regex(batch.column(2), _CHECKED)
            body = pc.struct_field(found, [0])
            some = pc.fill_null(pc.greater(pc.binary_length(body), 0), False)
            rows, body, stated = batch.filter(some), body.filter(some), pc.struct_field(found, [1]).filter(some)
            if rows.num_rows:
                ok = pa.array(checksums(body) == np.array([int(h, 16) for h in stated.to_pylist()]))
                rows, body = rows.filter(ok), body.filter(ok)
            parts = pc.split_pattern(body, ",")
            enough = pc.greater_equal(pc.list_value_length(parts), 7)
            rows, parts = rows.filter(enough), parts.filter(enough)
            part = lambda k: pc.list_element(parts, k)
            total, number, fill = (_whole_numbers(part(k)) for k in (1, 2, 6))
            seq = pc.if_else(pc.equal(part(3), ""), "default", part(3))
            made = pa.RecordBatch.from_arrays([*rows.columns, total, number, seq, part(4), part(5), fill], ["source", "at", "line", "total", "number", "seq_id", "channel", "payload", "fill_bits"])
            yield made.filter(pc.and_(pc.and_(pc.is_valid(total), pc.is_valid(number)), pc.is_valid(fill)))

    return lines.select("source", F.col("at").cast("long").alias("at"), "line").mapInArrow(run, _FIELDS)


LANE = ["source", "channel", "seq_id", "total"]
_LANE_SCHEMA = "source string, channel string, seq_id string, total int, block long"


def block_effect(numbers: list[int], total: int) -> tuple[list[int], list[list[int]]]:
    """What a block of parts does to a buffer, whichever parts it holds on entry: the numbers in the order of their first
    places, and for each the parts that are held at the block's end if a message is completed at that place. Parts are only
    added until one is completed, so the first completion is at the last of the first places of the missing numbers."""
    firsts: dict[int, int] = {}
    for at, number in enumerate(numbers):
        firsts.setdefault(number, at)
    starts = {at: k for k, at in enumerate(firsts.values())}
    at_end: list[set[int]] = [set() for _ in firsts]
    # all starts run together; those that come to the same parts stay together
    running: list[tuple[set[int], list[int]]] = []
    for at, number in enumerate(numbers):
        for held, _ in running:
            held.add(number)
            if len(held) == total:
                held.clear()
        if at in starts:
            running.append((set(), [starts[at]]))
        if len(running) > 1:
            merged: dict[frozenset[int], tuple[set[int], list[int]]] = {}
            for held, own in running:
                same = merged.setdefault(frozenset(held), (held, []))
                same[1].extend(own)
            running = list(merged.values())
    for held, own in running:
        for k in own:
            at_end[k] = held
    return list(firsts), [sorted(held) for held in at_end]


def after_block(held: list[int], total: int, firsts: list[int], at_end: list[list[int]]) -> list[int]:
    """The parts held at the end of a block that is entered with ``held``."""
    missing = {k for k in range(1, total + 1)} - set(held)
    places = [k for k, number in enumerate(firsts) if number in missing]
    return at_end[places[-1]] if len(places) == len(missing) else sorted(set(held) | set(firsts))


def _entered(blocks: DataFrame) -> DataFrame:
    """(lane, block, held, payloads): what the buffer holds when a block begins, from the effects of those before it."""
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, numbers, payloads = (batch.column(k).to_pylist() for k in (3, 5, 6))
            made = [(*block_effect(n, t), dict(zip(n, p))) for t, n, p in zip(totals, numbers, payloads)]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
            columns = [[m[0] for m in made], [m[1] for m in made], [[m[2][k] for k in m[0]] for m in made]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, k) for c, k in zip(columns, kinds))], [*LANE, "block", "firsts", "at_end", "last"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, newest = None, [], {}
        for batch in batches:
            out = []
            for *key, _, firsts, at_end, last in zip(*(c.to_pylist() for c in batch.columns)):
                if key != lane:
                    lane, held, newest = key, [], {}
                out.append((held, [newest[k] for k in held]))
                held = after_block(held, key[3], firsts, at_end)
                newest |= dict(zip(firsts, last))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 2, kinds))], [*LANE, "block", "held", "payloads"])

    short = blocks.select(*LANE, "block", F.col("parts.number").alias("numbers"), F.col("parts.payload").alias("payloads"))
    made = short.mapInArrow(effects, f"{_LANE_SCHEMA}, firsts array<int>, at_end array<array<int>>, last array<string>")
    return made.repartition(*LANE).sortWithinPartitions(*LANE, "block").mapInArrow(scan, f"{_LANE_SCHEMA}, held array<int>, payloads array<string>")


def assemble_nmea(fields: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Whole messages. Each (source, channel, seq_id, total) has a buffer with a place for each part. A part takes its place
    there, also from an earlier one that still waits; when all are taken they are joined in order, with fill bits and text of
    the part that completed them, and the buffer is empty. A lost part so leaves a message out and may spoil the next one,
    never more. Numbers beyond the total and empty payloads are passed over; a null source or channel is empty.

    A file of any length is spread over tasks: blocks of 2^``block_bits`` lines tell their effect on any buffer, the effects
    of a lane's blocks are put together in order, and each block is then worked on from the buffer it is entered with."""
    single = fields.where("total = 1").select("source", "at", "payload", "fill_bits", F.col("line").alias("raw_sentence"))
    parts = fields.where("total > 1 and number between 1 and total and payload <> ''").withColumns({
        "block": F.shiftright("at", block_bits), "source": F.coalesce("source", F.lit("")), "channel": F.coalesce("channel", F.lit(""))})
    row = F.struct("at", "number", "payload", "fill_bits", "line")
    blocks = write_table(parts.groupBy(*LANE, "block").agg(F.sort_array(F.collect_list(row)).alias("parts")))  # a block's lines at most
    several = blocks.groupBy(*LANE).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    none = F.array().cast("array<int>").alias("held"), F.array().cast("array<string>").alias("payloads")
    entered = blocks.join(_entered(blocks), [*LANE, "block"]) if several else blocks.select("*", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["source", "at", "payload", "fill_bits", "raw_sentence"], (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
        for batch in batches:
            out = []
            sizes = pc.list_value_length(batch.column(4)).to_pylist()
            rows = zip(*(c.to_pylist() for c in batch.column(4).flatten().flatten()))
            for source, total, held, payloads, size in zip(*(batch.column(k).to_pylist() for k in range(4)), sizes):
                buffer = dict(zip(held, payloads))
                for at, number, payload, fill_bits, line in islice(rows, size):
                    buffer[number] = payload
                    if len(buffer) == total:
                        out.append((source, at, "".join(buffer[k] for k in range(1, total + 1)), fill_bits, line))
                        buffer = {}
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names)

    whole = entered.select("source", "total", "held", "payloads", "parts").mapInArrow(run, "source string, at long, payload string, fill_bits int, raw_sentence string")
    return single.unionByName(whole)


#: The same values in the order of base 64, whose decoder packs six bits a character.
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bits of a word: a whole number of bytes and of characters, and a field of any message lies in two at most.
WORD = 48


def nmea_bits(payload: Column, fill_bits: Column) -> Column:
    """The payload as ``struct<words, len>``: its bits in numbers of WORD bits, the last one filled up with zeros, and how
    many there are without the fill bits. Unknown characters are skipped."""
    known = F.regexp_replace(payload, "[^0-W`-w]", "")
    digits, step = WORD // 4, WORD // 6

    def numbers(text: Column) -> Column:
        count = F.ceil(F.length(text) / step).cast("int")
        packed = F.hex(F.unbase64(F.rpad(F.translate(text, ARMOUR, BASE64), count * step, "A")))
        word = lambda h, k: F.conv(F.substring(h, k * digits + 1, F.lit(digits)), 16, 10).cast("long")
        # the packed text is made once, not once a word
        words = F.transform(F.array(packed), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: word(h, k)))[0]
        return F.struct(F.when(count > 0, words).otherwise(F.array().cast("array<bigint>")).alias("words"), F.greatest(F.lit(0), F.length(text) * 6 - fill_bits).alias("len"))

    return F.transform(F.array(known), numbers)[0]


def bits_uint(bits: Column, start: int, length: int) -> Column:
    """Bits past the end count for nothing, so a short payload gives a shortened number."""
    word = lambda k: F.coalesce(F.get(bits["words"], F.lit(k)), F.lit(0).cast("long"))
    at, offset = divmod(start, WORD)
    left = WORD - offset - length
    if left >= 0:
        value = F.shiftright(word(at), left).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
    else:
        high = word(at).bitwiseAND(F.lit((1 << (WORD - offset)) - 1).cast("long"))
        value = F.shiftleft(high, -left).bitwiseOR(F.shiftright(word(at + 1), WORD + left))
    beyond = F.greatest(F.lit(0), F.least(F.lit(length), F.lit(start + length) - bits["len"]))
    return F.call_function("shiftright", value, beyond.cast("int"))


def bits_int(bits: Column, start: int, length: int) -> Column:
    value = bits_uint(bits, start, length)
    return F.when(value >= 1 << (length - 1), value - (1 << length)).otherwise(value)


#: The alphabet of texts, by value.
TEXT = "".join(chr(v + 64 if v < 32 else v) for v in range(64))


def bits_text(bits: Column, start: int, length: int) -> Column:
    """Six-bit characters, without the filling at the ends, of a payload that reaches to the text's end. They go through
    base 64 by words of eight."""
    words = []
    for at in range(start, start + length, WORD):
        taken = min(WORD, start + length - at)
        words.append(F.lpad(F.hex(F.shiftleft(bits_uint(bits, at, taken), WORD - taken)), WORD // 4, "0"))
    coded = F.substring(F.base64(F.unhex(F.concat(*words))), 1, length // 6)
    return F.trim(F.trim(F.translate(coded, BASE64, TEXT), F.lit("@")))


def _frame(messages: DataFrame) -> DataFrame:
    bits = nmea_bits(F.col("payload"), F.col("fill_bits"))
    return messages.withColumn("bits", bits).withColumns({"message_type": bits_uint(F.col("bits"), 0, 6).cast("int"), "bits_len": F.col("bits.len")})


def _unless(value: Column, missing: Column) -> Column:
    return F.when(~missing, value)


def _position() -> dict[str, Column]:
    b = F.col("bits")
    rot, sog, cog, heading = bits_int(b, 42, 8), bits_uint(b, 50, 10) / 10.0, bits_uint(b, 116, 12) / 10.0, bits_uint(b, 128, 9)
    status = bits_uint(b, 38, 4).cast("int")
    squared = F.pow(rot / 4.733, F.lit(2.0))
    return {
        "message_type": F.col("message_type"), "mmsi": bits_uint(b, 8, 30).cast("string"), "nav_status": status, "nav_status_text": lookup(config.NAV_STATUS, status, "Unknown"),
        "rate_of_turn": _unless(F.when(rot < 0, -squared).otherwise(squared), rot == -128), "speed_over_ground": _unless(sog, sog >= 102.2),
        "position_accuracy": bits_uint(b, 60, 1) == 1, "longitude": bits_int(b, 61, 28) / 600000.0, "latitude": bits_int(b, 89, 27) / 600000.0,
        "course_over_ground": _unless(cog, cog >= 360), "true_heading": _unless(heading, heading >= 511).cast("int"), "timestamp_seconds": bits_uint(b, 137, 6).cast("int"),
        "bits_len": F.col("bits_len"), "truncated": F.col("bits_len") < 168, "raw_sentence": F.col("raw_sentence")}


def _static() -> dict[str, Column]:
    b, code = F.col("bits"), bits_uint(F.col("bits"), 232, 8).cast("int")
    whole = F.col("bits_len") >= 424
    number = lambda at, n: F.when(whole, bits_uint(b, at, n).cast("int"))
    text = lambda at, n: F.when(whole, bits_text(b, at, n))
    sizes = {"dimension_bow": (240, 9), "dimension_stern": (249, 9), "dimension_port": (258, 6), "dimension_starboard": (264, 6),
             "eta_month": (274, 4), "eta_day": (278, 5), "eta_hour": (283, 5), "eta_minute": (288, 6)}
    return {
        "message_type": F.col("message_type"), "mmsi": F.when(whole, bits_uint(b, 8, 30).cast("string")), "imo": number(40, 30), "callsign": text(70, 42), "ship_name": text(112, 120),
        "ship_type": F.when(whole, code), "ship_type_text": F.when(whole, lookup(config.SHIP_TYPE, (F.floor(code / 10) * 10).cast("int"), "Unknown")),
        **{name: number(*at) for name, at in sizes.items()}, "length": number(240, 9) + number(249, 9), "width": number(258, 6) + number(264, 6),
        "draught": F.when(whole, bits_uint(b, 294, 8) / 10.0), "destination": text(302, 120), "error": F.when(~whole, "incomplete"), "bits_len": F.col("bits_len"), "raw_sentence": F.col("raw_sentence")}


def _class_b() -> dict[str, Column]:
    b, heading = F.col("bits"), bits_uint(F.col("bits"), 124, 9)
    return {
        "message_type": F.col("message_type"), "mmsi": bits_uint(b, 8, 30).cast("string"), "speed_over_ground": bits_uint(b, 46, 10) / 10.0,
        "longitude": bits_int(b, 57, 28) / 600000.0, "latitude": bits_int(b, 85, 27) / 600000.0, "course_over_ground": bits_uint(b, 112, 12) / 10.0,
        "true_heading": _unless(heading, heading >= 511).cast("int"), "bits_len": F.col("bits_len"), "truncated": F.col("bits_len") < 168, "raw_sentence": F.col("raw_sentence")}


#: The messages that are decoded, and the columns of each.
DECODED = {"message_type between 1 and 3": _position, "message_type = 5": _static, "message_type = 18": _class_b}


def _of_kind(framed: DataFrame, kind: str) -> DataFrame:
    return framed.where(kind).select(*(value.alias(name) for name, value in DECODED[kind]().items()))


def decode_position(framed: DataFrame) -> DataFrame:
    """Messages 1 to 3."""
    return _of_kind(framed, "message_type between 1 and 3")


def decode_static(framed: DataFrame) -> DataFrame:
    """Message 5; fewer than 424 bits give a row with the error alone."""
    return _of_kind(framed, "message_type = 5")


def decode_class_b(framed: DataFrame) -> DataFrame:
    """Message 18; speed and course are as sent."""
    return _of_kind(framed, "message_type = 18")


def decode_nmea(messages: DataFrame) -> DataFrame:
    """All messages in one frame: what a type lacks is null, and other types keep type and sentence. One pass, not one a
    type, so what makes the messages runs once."""
    every: dict[str, Column] = {}
    common = ("message_type", "bits_len", "raw_sentence")
    for kind, columns in DECODED.items():
        for name, value in columns().items():
            every[name] = value if name in common else every[name].when(F.expr(kind), value) if name in every else F.when(F.expr(kind), value)
    return _frame(messages).select(*(value.alias(name) for name, value in every.items()))


def nmea_messages(spark: SparkSession, path: str) -> DataFrame:
    return decode_nmea(assemble_nmea(split_nmea(read_nmea(spark, path))))
