"""Clustering and code compression against brute force in plain Python."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import clustering, codes, lattice

VECTORS = "vec_id long, embedding array<double>, label int"
CLASHING = "block int, v int, cluster int, distance int, n int, sums int, slot int, `of` int, s int, code int, error int, rid int, x int"


def whole(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) or abs(x) > lattice.MOST / scale for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def lloyd(points, centroids, rounds):
    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(p)[1] for p in points]
        for i in range(len(centroids)):
            held = [p for p, o in zip(points, own, strict=True) if o == i]
            if held:
                centroids[i] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    return [nearest(p) for p in points], centroids


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, v) for i, e in rows if (v := whole(e, 64)) is not None and len(v) == size]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    found, centroids = lloyd([v for _, v in kept], [list(v) for _, v in order[:k]], rounds)
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str), centroids


def brute_codes(rows, parts=8, k=16, rounds=6):
    kept = [(i, v) for i, e in rows if (v := whole(e, 4096)) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        own = slice(p * width, (p + 1) * width)
        found, book = lloyd([v[own] for _, v in kept], [list(v[own]) for _, v in order[:k]], rounds)
        books += book
        code = [c + f"{e:02x}" for c, (_, e) in zip(code, found, strict=True)]
        error = [a + d for a, (d, _) in zip(error, found, strict=True)]
    return sorted(((i, c, e) for (i, _), c, e in zip(kept, code, error, strict=True)), key=str), books


def random_rows(seed, n=300, size=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, size))
    x = centres[r.integers(0, 8, n)] + 0.3 * r.normal(size=(n, size))
    x[: n // 3] = x[0]  # a third are one vector
    return [(i if i % 50 else 7, x[i].tolist()) for i in range(n)]


def awkward():
    ones = [1.0] * 64
    return [
        (1, None, 1), (2, [], 1), (3, [0.5] * 63, 1), (4, [None, *ones[1:]], 1), (5, [float("nan"), *ones[1:]], 1), (6, [float("inf"), *ones[1:]], None),
        (7, [1e30, *ones[1:]], 1), (8, ones, 1), (8, ones, 1), (8, [-x for x in ones], None), (None, ones, None), (None, None, None), (9, [-1e-9] * 64, 2),
        (10, [0.0] * 64, 2), (11, [-0.0] * 64, 2), (12, [2.0e6 / 64] * 64, 3), (13, [1.0] * 65, 3),
    ]


def clashing(spark, rows):
    n = CLASHING.count("int")
    return spark.createDataFrame([(*r, *[3] * n) for r in rows], f"{VECTORS}, {CLASHING}")


@pytest.mark.parametrize("block", [4096, 40])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", block)
    rows = random_rows(1)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    found, centroids = clustering.clusters(df)
    want, books = brute_clusters(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want
    assert centroids.tolist() == books


def test_clusters_of_awkward_rows(spark):
    rows = awkward()
    found, centroids = clustering.clusters(clashing(spark, rows))
    want, books = brute_clusters([r[:2] for r in rows])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want
    assert centroids.tolist() == books
    none, centroids = clustering.clusters(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and len(centroids) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 9), st.sampled_from([1, 3, 40, 2**27]))
def test_whole_nodes_and_leaves(seed, n, k, spread):
    r = np.random.default_rng(seed)
    x = r.integers(-spread, spread + 1, (n, 4))
    x = x[clustering.kd_order(x)]
    c = r.integers(-spread, spread + 1, (k, 4))
    far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    want = far.argmin(axis=1)
    own, counts, sums = clustering.assign(x, c)
    assert own.tolist() == want.tolist()
    assert counts.tolist() == np.bincount(want, minlength=k).tolist()
    assert all(sums[i].tolist() == x[want == i].sum(axis=0).tolist() for i in range(k))


def test_nodes_are_assigned_whole_and_centroids_pruned(monkeypatch):
    r = np.random.default_rng(3)
    centres = r.integers(-1000, 1000, (8, 4))
    x = (centres[r.integers(0, 8, 4000)] + r.integers(-5, 6, (4000, 4))).astype(np.int64)
    x = x[clustering.kd_order(x)]
    compared = []
    monkeypatch.setattr(clustering, "products", lambda a, b: compared.append(len(a)) or a @ b.T)
    clustering.assign(x, centres)
    assert sum(compared) < 2000  # nodes and the rows of a few leaves, of 4,000 rows


def test_codes_equal_brute_force(spark):
    rows = random_rows(2)
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], VECTORS).repartition(3)
    found, books = codes.coded(df)
    want, brute = brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in found.collect()), key=str) == want
    assert books.tolist() == brute


def test_codes_of_awkward_rows(spark):
    rows = awkward()
    found, books = codes.coded(clashing(spark, rows))
    got = [(r.vec_id, r.code, r.error) for r in found.collect()]
    fit = [r[:2] for r in rows if r[1] is not None and len(r[1]) == 64]
    want, brute = brute_codes(fit)
    assert sorted((r for r in got if r[1] is not None), key=str) == want
    assert books.tolist() == brute
    # Kept rows of another length have neither code nor error.
    assert sorted((r[0] for r in got if r[1] is None)) == [2, 3, 13]
    none, books = codes.coded(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and books.size == 0
    odd, _ = codes.coded(spark.createDataFrame([(1, [1.0] * 3, 1)], VECTORS))
    assert [(r.vec_id, r.code) for r in odd.collect()] == [(1, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 40), st.sampled_from([1, 3, 40, 2**27]))
def test_annulus_is_exact(seed, n, k, spread):
    r = np.random.default_rng(seed)
    x, e = r.integers(-spread, spread + 1, (n, 3)), r.integers(-spread, spread + 1, (k, 3))
    far = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(axis=2)
    best, d, taken = codes.nearest(x, e)
    assert best.tolist() == far.argmin(axis=1).tolist() and d.tolist() == far.min(axis=1).tolist() and taken <= n * k


def test_annulus_prunes():
    r = np.random.default_rng(4)
    e = r.integers(-100, 100, (16, 8)) * np.arange(1, 17)[:, None]
    x = e[r.integers(0, 16, 1000)] + r.integers(-3, 4, (1000, 8))
    assert codes.nearest(x, e)[2] < 3 * 1000  # of 16,000


def test_label_sums_take_nulls_together(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    rows = [r for r in awkward() if r[1] is None or len(r[1]) == 64]
    spark.createDataFrame(rows, VECTORS).write.parquet(path)
    got = codes.op13_vector_codes(spark, str(tmp_path)).collect()
    labels = {r[0]: r[2] for r in rows if whole(r[1], 4096) is not None and r[0] not in (8, None)}
    by = {}
    for r in codes.coded(spark.read.parquet(path))[0].collect():
        by[r.label] = by.get(r.label, 0) + r.error
    assert len(got) and all(r.label_error == by[labels[r.vec_id]] for r in got if r.vec_id in labels)
    assert {r.label_error for r in got if r.vec_id is None} == {by[None]}
