from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselspark.llm.vector_dedup import FOUND, Quantised, Tile, _quantised, half_of_blocks, linked, unit, vector_components
from vesselspark.meetings import block_of, meet


def plain(rows, threshold):
    vectors = {}
    for i, v in rows:
        if i is not None:
            ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
            old = vectors.get(i)
            vectors[i] = min(old, list(v)) if ok and old else list(v) if ok else old
    label = {i: i for i in vectors}
    links = dict.fromkeys(vectors, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in vectors.items():
        for j, b in vectors.items():
            if a and b and i < j and len(a) == len(b):
                a1, b1 = np.array(a, float), np.array(b, float)
                if a1 @ b1 / np.linalg.norm(a1) / np.linalg.norm(b1) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in vectors}


def rows():
    rng = np.random.default_rng(5)
    found = []
    for k in range(12):
        centre = rng.normal(size=16)
        found += [centre + rng.normal(size=16) * s for s in rng.uniform(0.02, 0.4, 14)]
    found += list(rng.normal(size=(60, 16)))
    found = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(found)]
    found += [(k + 1000, v) for k, v in found[:9]] + [found[3]]
    return [*found, (2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (None, [1.0] * 16), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [])]


@pytest.mark.parametrize("block", [8192, 100, 40, 25])
def test_all_pairs(spark, block):
    data = [(i, v, 1) for i, v in rows()]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vector_components(df, block=block).collect()}
    assert got == plain(rows(), 0.95)
    assert vector_components(df.limit(0)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a = unit(rng.normal(size=(300, 64)))
    b = unit(a + rng.normal(size=(300, 64)) * 0.042)
    qa, qb = Quantised.of(a), Quantised.of(b)
    left_open = 0
    for threshold in (0.9, 0.95, float(a[0] @ b[0])):
        exact = np.einsum("ik,jk->ij", a, b) >= threshold
        hits, left, right = linked(qa, qb, slice(0, 300), threshold)
        wrong = hits != exact
        wrong[left, right] = False
        assert not wrong.any()
        left_open += len(left)
    assert 1 <= left_open <= 5
    first, both = qa.first * qa.scale[:, None], qa.restored(np.arange(300))
    for part, norm, lost in ((first, qa.norm, qa.lost), (both, qa.finer_norm, qa.finer_lost)):
        assert (np.abs(a @ b.T - part @ b.T) <= lost[:, None]).all() and (np.linalg.norm(part, axis=1) <= norm).all()
    assert qa.finer_lost.max() < qa.lost.min() / 100


def test_every_two_blocks_meet_once(spark):
    for number in (1, 2, 3, 4, 7, 8):
        rows = spark.range(number).select(F.col("id"), F.explode(half_of_blocks(F.col("id"), number)).alias("met")).collect()
        pairs = [tuple(sorted((r.id, r.met))) for r in rows]
        assert sorted(pairs) == [(i, j) for i in range(number) for j in range(i, number)]


@pytest.mark.parametrize("block", [8192, 100])
def test_a_clique_is_a_tree(spark, block):
    v = np.ones((500, 8)) + np.random.default_rng(2).normal(size=(500, 8)) * 1e-3
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, vector array<double>")
    number = -(-500 // block)
    coded = _quantised(df, block_of(F.col("id"), number))
    found = meet(coded, coded, F.col("own"), half_of_blocks(F.col("own"), number), number, 1, lambda own: Tile(own, 0.95), FOUND).collect()
    counts = Counter()
    for r in found:
        if r.b is None:
            counts[r.a] += r.links
    assert set(counts.values()) == {499} and len(counts) == 500
    assert sum(r.b is not None for r in found) <= 499 + 500 * number and all(r.links == 0 for r in found if r.b is not None)


def test_pairs_at_the_threshold_are_settled_in_doubles(spark):
    rng, base = np.random.default_rng(8), np.eye(16)[0]
    rows = []
    for k in range(200):
        other = rng.normal(size=16)
        other -= other @ base * base
        other /= np.linalg.norm(other)
        cosine = 0.95 + (k - 100) * 1e-9
        rows.append((k + 1, [float(x) for x in cosine * base + np.sqrt(1 - cosine**2) * other], 0))
    rows.append((0, [float(x) for x in base], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vector_components(df).collect()}
    assert got == plain([r[:2] for r in rows], 0.95) and 50 < got[0][0] < 150
