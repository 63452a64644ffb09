from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vesselspark.llm.ann import Index, distances, fit, learn_rotation, nearest
from vesselspark.llm.queries import op6_neighbours


def plain(vectors, k):
    """The k nearest of each query by trying all."""
    found = {}
    for i, q in vectors.items():
        if i % 20 == 0:
            scores = sorted((-float(np.dot(np.array(q), np.array(v))), j) for j, v in vectors.items() if j != i and len(v) == len(q))
            found[i] = [(j, -s) for s, j in scores[:k]]
    return found


def test_probing_finds_the_whole_ball():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(500, 20))
    coder = learn_rotation(vectors)
    assert np.allclose(coder.rotation[:, :20].T @ coder.rotation[:, :20], np.eye(20), atol=1e-9)
    codes = coder.codes(vectors)
    all_distances = distances(codes, codes)
    index = Index(codes)
    for radius in (0, 3, 8, 24):
        for k in range(20):
            assert index.within(codes[k], radius).tolist() == np.flatnonzero(all_distances[k] <= radius).tolist()
    assert fit(vectors[:1], 5).radius == 24


def test_recall_on_the_table(spark):
    got = op6_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    exact = plain({int(i): np.array(v, float) for i, v in zip(table.vec_id, table.embedding)}, 20)
    hits = sum(len({j for j, _ in exact[i]} & set(part.vec_id)) for i, part in got.groupby("query_id"))
    assert set(got.query_id) == set(exact) and hits / sum(map(len, exact.values())) >= 0.9
    for i, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and i not in set(part.vec_id)
        order = list(zip(-part.score, part.vec_id))
        assert order == sorted(order)


def test_edges(spark):
    rng = np.random.default_rng(3)
    vectors = {k: [float(np.float32(x)) for x in rng.normal(size=8)] for k in range(300)}
    vectors |= {k + 400: vectors[k] for k in range(0, 100, 20)}
    vectors |= {1000: [1.0, 2.0], 1001: [3.0, 1.0], 1020: [5.0]}
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, [1.0] * 8), (2080, [float("inf")] + [1.0] * 7), (2100, [])]
    rows = [(k, v, 1) for k, v in [*vectors.items(), *bad, (7, vectors[7])]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = nearest(df, F.col("id") % 20 == 0, block=64, query_part=8).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = {i: e for i, e in plain(vectors, 20).items() if e}
    assert got.keys() == exact.keys() and all(len(got[i]) == len(exact[i]) for i in exact)
    assert all(math.isclose(s, np.dot(vectors[i], vectors[j]), rel_tol=1e-12) for i in got for j, s in got[i])
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in exact[i]}) for i in exact)
    assert hits / sum(map(len, exact.values())) >= 0.9 and got[1000] == [(1001, 5.0)]
    assert nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
