from __future__ import annotations

import math
from collections import Counter

import numpy as np

from vesselspark.llm.queries import op1_quality
from vesselspark.llm import quality
from vesselspark.llm.ngrams import features
from vesselspark.llm.quality import QualityModel, learn, score_documents, scores, train


def test_held_out(spark):
    rows = op1_quality(spark, "/root/testdata/sf0.01").toPandas()
    assert list(rows.columns[:4]) == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 1000
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == held.quality).mean() >= 0.95) and held.score.between(0, 1).all()
    clean = held[held.quality == 1]
    assert (clean.predicted == 1).mean() >= 0.97


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (2, "", 2.0), (None, "a b", 3.0), (4, "x" * 3_000_000, 4.0), (5, "a b", 5.0), (5, "a b", 5.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (1, None)], "doc_id long, quality int")
    model = train(docs, labels)
    got = [(r.id, r.score) for r in score_documents(docs, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i == 5}) == 1 and len({s for i, s in got if i in (1, 2)}) == 1
    empty = train(docs.limit(0), labels.limit(0))
    assert scores(empty, ["", None, "z"]).tolist() == [0.5, 0.5, 0.5]
    assert score_documents(docs.limit(0), model).collect() == []


def test_neighbours_do_not_matter():
    rng = np.random.default_rng(3)
    model = QualityModel(rng.normal(size=1 << 17).astype(np.float32), 0.1)
    texts = ["a", "", "b c\td", "the the the", "ü" * 50, "one two three four " * 99]
    alone = [scores(model, [t])[0] for t in texts]
    assert np.allclose(alone, scores(model, texts), atol=1e-12)


def counted(text):
    """The words, pairs of words and character n-grams of a text, one by one, with their numbers."""
    words, spaced = text.split(), "".join(" " if c.isspace() else c for c in text)
    found = [("word", w) for w in words] + [("pair", "same" if a == b else (a, b)) for a, b in zip(words, words[1:])]
    found += [(n, spaced[k : k + n]) for n in (3, 4) for k in range(len(spaced) - n + 1)]
    return Counter(found)


def test_features_one_by_one():
    """Buckets are hashes, so what is compared is which features are equal and how often each occurs."""
    texts = ["the cat and the cat sat", "a b\tc a b\nc", "x", "zz zz zz", "über die über die"]
    for text in texts:
        got = sorted(Counter(int(b) for bucket, _ in features([text], quality.BITS, quality.SIZES) for b in bucket).values())
        assert got == sorted(counted(text).values())
        (bucket, share), total = next(iter(quality._sparse([text]))), sum(counted(text).values())
        assert np.allclose(sorted(share), np.array(sorted(counted(text).values())) / total) and len(set(bucket.tolist())) == len(counted(text))


def plainly_learned(data, dim, epochs, rate, seed):
    """The same descent, number by number."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << quality.BITS, dim)).astype(np.float32).astype(float)
    layer, bias, done = [[0.0] * dim, [0.0] * dim], [0.0, 0.0], 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            label, bucket, share = data[k]
            pace, done = rate * (1 - done / (epochs * len(data))), done + 1
            hidden = [sum(s * table[b][j] for b, s in zip(bucket, share)) for j in range(dim)]
            logits = [sum(w * h for w, h in zip(layer[c], hidden)) + bias[c] for c in (0, 1)]
            odds = [math.exp(x) for x in logits]
            slope = [odds[c] / sum(odds) - (c == label) for c in (0, 1)]
            back = [sum(slope[c] * layer[c][j] for c in (0, 1)) for j in range(dim)]
            for c in (0, 1):
                bias[c] -= pace * 0.1 * slope[c]
                for j in range(dim):
                    layer[c][j] -= pace * slope[c] * hidden[j]
            for b, s in zip(bucket, share):
                for j in range(dim):
                    table[b][j] -= pace * 8 * math.sqrt(s) * back[j]
    return table, layer, bias


def test_descent_and_score_number_by_number():
    texts = ["good text here", "bad bad junk", "more good text", "junk and junk", "text"]
    data = [(k % 2, *next(iter(quality._sparse([t])))) for k, t in enumerate(texts)]
    table, layer, bias = learn(data, 4, 3, 0.5, 1)
    plain = plainly_learned(data, 4, 3, 0.5, 1)
    assert np.allclose(table, plain[0], atol=1e-5) and np.allclose(layer, plain[1], atol=1e-5) and np.allclose(bias, plain[2], atol=1e-5)
    model = QualityModel((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))
    for (_, bucket, share), text in zip(data, texts):
        hidden = sum(s * table[b].astype(float) for b, s in zip(bucket, share))
        odds = np.exp(layer.astype(float) @ hidden + bias)
        assert abs(odds[1] / odds.sum() - scores(model, [text])[0]) < 1e-5


def test_bounds_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda data, *a: seen.append(data) or learn(data, *a))
    docs = spark.createDataFrame([(1, "a b c"), *[(2, "one text of many")] * 500, (2, "another"), (3, "x " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *[(2, 0)] * 50, (3, 1)], "doc_id long, quality int")
    train(docs, labels)
    assert sorted(y for y, *_ in seen[0]) == [0, 1, 1]
    train(docs, labels, max_chars=1)
    train(docs, labels, max_rows=2)
    assert len(seen[1]) == 1 and len(seen[2]) == 2
