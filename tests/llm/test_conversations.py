from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from vesselspark.llm.conversations import BASE, PRIME, counters, prefix_digests, prefix_trie


def digest(role, text):
    return sha256(f"{len(role)}:{role}{sha256(text.encode()).hexdigest()}".encode()).digest()


def plain(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        b, h = c - (abs(c) % 100) * (1 if c >= 0 else -1), crc32(str(c).encode()) % 6
        made[c] = own.get(b, [])[:h] + turns[h:] if rebuild else turns
    members, kids = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved, result = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(made[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        result.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(result, key=lambda r: (r[0], r[1]))


def table(seed, n=260, longest=14):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -100, -101, 100_000, 100_007, 123_456_789_012]:
        if c % 7 == 5:
            continue
        turns = rnd.randint(1, longest)
        same = rnd.random() < 0.4
        for t in range(turns):
            text = f"same {t}" if same and t < 12 else rnd.choice(["é", "a b", "", None, "漢字 x", f"own {c} {t}"])
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "user", None]), text))
    rows += rows[:5] + [(None, 1, "user", "nobody's")] * 3
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("part, bits", [(512, None), (5, None), (5, 3), (512, 0)])
def test_matches_plain(spark, part, bits):
    rows = table(part + (bits or 9))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("digest", F.lit(1))
    more = {} if bits is None else {"bits": bits or 1}
    got = sorted((tuple(r) for r in prefix_trie(df, part=part, **more).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rows)


def test_as_they_are_with_a_long_one(spark):
    rnd = random.Random(4)
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}") for t in range(200)] + [(3, t, "user", f"t{t}" if t < 250 else f"u{t}") for t in range(280)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie(df, block=None, part=16).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rows, rebuild=False)


def test_crowds(spark, monkeypatch):
    """One conversation in hundreds of copies, ends in several pieces, parents of many children."""
    from vesselspark.llm import conversations

    monkeypatch.setattr(conversations, "IDS_AT_ONCE", 16)
    monkeypatch.setattr(conversations, "CROWDED", 3)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(c, 3, "user", f"c{c}") for c in range(0, 300, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie(df, block=None).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rows, rebuild=False)


def test_digests_are_put_together_from_parts():
    turns = [bytes([k]) * 32 for k in range(1, 9)]
    whole = prefix_digests(turns, 1)
    assert prefix_digests(turns[3:], 4, whole[2]) == whole[3:]
    assert whole[1] == (int.from_bytes(turns[0], "big") * BASE + int.from_bytes(turns[1], "big") * BASE**2) % PRIME
    assert len(set(whole)) == 8 and counters([w.to_bytes(32, "big") for w in whole], 8).max() < 512


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    empty = next(c for c in range(201, 299) if crc32(str(c).encode()) % 6 > 2)
    rows = [(empty, 1, "a", "b"), (empty, 2, None, None)]  # without its block's first conversation nothing is left
    assert [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()] == plain(rows)
    rows = [(100, None, None, "x" * 300_000), (100, None, None, "x" * 300_000)]
    assert sorted(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()) == plain(rows)
    with pytest.raises(ValueError):
        prefix_trie(spark.createDataFrame(rows, schema), part=2)
