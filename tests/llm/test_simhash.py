from __future__ import annotations

import random

import pytest
import xxhash

from vesselspark.llm.simhash import fingerprint, simhash_components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in words).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, plain(t)) for i, t in rows]
    label = {i: i for i, _ in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: (f, find(i)) for i, f in fps}


def corpus():
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "É é É é x"), (6, "a b c d")]
    base = [rnd.choices(vocab, k=rnd.randint(5, 200)) for _ in range(40)]
    for n in range(7, 260):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((n, " ".join(words)))
    long = rnd.choices(vocab, k=3000)
    for n in range(260, 300):  # a group of near copies with many different fingerprints
        words = list(long)
        for _ in range(12):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((n, " ".join(words)))
    rows.append((300, "the the " * 40_000))
    return rows


@pytest.mark.parametrize("hot", [8192, 3])
def test_matches_all_pairs(spark, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_components(df, hot=hot).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert [fingerprint(x) for x in ("A b  C", "a b c")] == [xxhash.xxh64_intdigest(b"a b c", 42)] * 2
    df = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, "x y", 6), (None, "z", 6)], "doc_id long, text string, fp long")
    got = sorted((r.id or -1, r.component_id or -1) for r in simhash_components(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert simhash_components(df.limit(0)).collect() == []
