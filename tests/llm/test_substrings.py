from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from vesselspark.llm.fmindex import FMIndex, repeated_windows, suffix_order
from vesselspark.llm.substrings import remove_repeats, runs


def split(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(texts, window):
    words = [split(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    result = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        result.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return result


def test_index_counts():
    rnd = np.random.default_rng(1)
    symbols = np.r_[rnd.integers(1, 5, 400), 0]
    text = symbols.tolist()
    assert suffix_order(symbols).tolist() == sorted(range(401), key=lambda k: text[k : k + 64] + [-1] * 64)
    index = FMIndex(symbols)
    for _ in range(300):
        size = int(rnd.integers(1, 8))
        at = int(rnd.integers(0, 400 - size))
        pattern = text[at : at + size] if rnd.random() < 0.7 else rnd.integers(1, 5, size).tolist()
        low, high = np.array([0]), np.array([index.n])
        for s in reversed(pattern):
            low, high = index.extend(np.array([s]), low, high)
        assert high[0] - low[0] == sum(text[k : k + size] == pattern for k in range(401))


@pytest.mark.parametrize("window", [3, 35, 64, 65, 90])
def test_repeated_windows(window):
    rnd = np.random.default_rng(window)
    texts = [rnd.integers(1, 4, int(rnd.integers(1, 120))) for _ in range(30)]
    texts += [np.r_[rnd.integers(1, 4, 5), texts[k], rnd.integers(1, 4, 3)] for k in range(10)]
    texts += [np.full(97, 2)]
    lengths = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    symbols = np.concatenate([np.r_[t, 0] for t in texts])
    got = {(t, k) for t, at, n in repeated_windows(FMIndex(symbols, max(64, window)), symbols, starts, lengths, window) for k in range(at, at + n)}
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - window + 1) if seen[tuple(t[i : i + window])] > 1}


def test_runs_cover_each_window_once():
    rnd = random.Random(2)
    words = [rnd.choice("abcdefghij").encode() for _ in range(400)] + [b"x"] * 200
    at = 0
    for _, first, windows, _ in runs(words, 35):
        assert first == at and 1 <= windows <= 64
        at += windows
    assert at == len(words) - 34 and runs(words[:34], 35) == []


def corpus():
    rnd = random.Random(3)
    vocab = [f"w{k}é" for k in range(400)]
    text = lambda n: rnd.choices(vocab, k=n)
    shared = [text(n) for n in (34, 35, 36, 60, 90)]
    rows = [text(rnd.randint(0, 150)) + rnd.choice(shared) + text(rnd.randint(0, 50)) for _ in range(80)]
    rows += [text(40) for _ in range(10)] + [rows[0], rows[1]]
    twice = text(50)
    rows += [twice + text(9) + twice, ["the"] * 500, ["the", "a"] * 30, text(34)]
    long = text(120)
    for _ in range(60):
        edited = list(long)
        edited[rnd.randrange(120)] = rnd.choice(vocab)
        rows.append(edited)
    texts = [rnd.choice([" ", "\n", " \t"]).join(r) for r in rows]
    return [None, "", " \n", "a b", "a b c", *texts, " ".join(text(30_000))]


@pytest.mark.parametrize("window, hot", [(35, 512), (35, 4), (100, 512), (3, 512)])
def test_matches_counting_all_windows(spark, window, hot):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "s", k) for k, t in enumerate(texts)], "doc_id long, text string, source string, text_hash long")
    rows = remove_repeats(df.repartition(3), window, hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == dict(enumerate(plain(texts, window)))
    assert all(r.text_hash == r.doc_id for r in rows)
    with pytest.raises(ValueError):
        remove_repeats(df, names=("n", "Source", "k"))
    assert rows[0].source == "s" and len(rows) == len(texts)


def test_edges(spark):
    words = " ".join(f"x{k}" for k in range(40))
    df = spark.createDataFrame([(1, words), (1, words), (None, words + " z"), (None, "q"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect())
    assert got == [(0, 1, 0, "q"), (0, 41, 40, "z"), (1, 40, 40, ""), (1, 40, 40, ""), (4, 0, 0, "")]
    assert remove_repeats(df.limit(0)).collect() == []
    alone = spark.createDataFrame([(1, words), (1, words)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(alone).collect()] == [40, 40]
