import numpy as np
import pandas as pd

from tidemark.llm import embeddings
from tidemark.llm.embeddings import agreement, near_vectors, op6_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = {}
    for i, v, label in rows:
        if v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        a = np.array(v, dtype=np.float32).astype(float)
        if np.linalg.norm(a):
            ok[i] = (a / np.linalg.norm(a), label)
    links = {i: set() for i, *_ in rows}
    for i, (a, la) in ok.items():
        for j, (b, lb) in ok.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= cosine:
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links):
    label = {}
    for start in sorted(links):
        if start in label:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += links[x]
    return label


def made(n=600, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 0.5])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2)) if len(rows) % 3 else 0))
    return rows


def test_recall_and_precision(spark):
    rows = made()
    links, got = brute(rows), near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    total = sum(map(len, links.values()))
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * total and total > 300
    want = reach(links)
    assert sum(r.component_id == want[r.vec_id] for r in got) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_hot_group_of_near_copies_loses_no_links(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, hot, dim = 20_400, 6_800, 64
    x = rng.normal(size=(n, dim))
    centre = np.eye(dim)[0]
    off = x[:hot] - (x[:hot] @ centre)[:, None] * centre
    x[:hot] = np.sqrt(0.97) * centre + np.sqrt(0.03) * off / np.linalg.norm(off, axis=1, keepdims=True)
    x = x.astype(np.float32)[rng.permutation(n)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.93).sum(axis=1) - 1 for a in range(0, n, 2000)])
    rows = pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": np.zeros(n, np.int32)})
    rows.to_parquet(tmp_path / "hot.parquet")
    got = near_vectors(spark.read.parquet(str(tmp_path / "hot.parquet"))).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert want.sum() > 4e7 and (got <= want).all()
    print("recall", got.sum() / want.sum())
    assert got.sum() >= 0.9999 * want.sum()


def test_repeated_ids_with_unlike_vectors_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (2, [5.0, -5.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False)]


def test_the_order_of_pivots_counts():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]])
    b = np.array([[1, 2, 3, 4], [4, 3, 2, 1], [1, 8, 9, 7]])
    assert agreement(a, b).tolist() == [4.0, 2.0, 1.0]


def test_candidates_are_counted_before_they_are_verified():
    """The pairs of a list whose cosines are taken: exactly those whose permutations agree, and few of all."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 48))
    x[350:] = x[:350] + 0.25 * rng.normal(size=(350, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = embeddings.apart(list(rng.normal(size=(400, 48))), 60, embeddings.near_cosine(0.93))
    near = x @ own.T
    held = np.argsort(-near, axis=1, kind="stable")[:, :8]
    close = (np.take_along_axis(near, held, axis=1) >= embeddings.near_cosine(0.93)).sum(axis=1)
    compared = pairs = 0
    for pivot in range(60):
        at = np.flatnonzero((held[:, :4] == pivot).any(axis=1))
        i, j = embeddings.candidates(held[at], held[at], close[at], close[at], pivot, 1.5, 4)
        got = set(zip(i[i < j].tolist(), j[i < j].tolist(), strict=True))
        want = set()
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                p, q = held[at[a]], held[at[b]]
                both = set(p[:4]) & set(q[:4])
                sure = set(p[: min(4, close[at[a]])]) & set(q[: min(4, close[at[b]])])
                if min(both, default=-1) == pivot and (sure or agreement(p[None], q[None])[0] >= 1.5):
                    want.add((a, b))
        assert got == want
        compared, pairs = compared + len(got), pairs + len(at) * (len(at) - 1) // 2
        rows = x[at]
        assert [v.tolist() for v in embeddings.verified(rows, rows, i, j, 0.93)] == [v[(rows[i] * rows[j]).sum(axis=1) >= 0.93].tolist() for v in (i, j)]
    assert compared < 0.5 * pairs


def test_split_lists_change_nothing(spark):
    rows = spark.createDataFrame(made(300), SCHEMA)
    one = sorted(map(tuple, near_vectors(rows).collect()))
    assert sorted(map(tuple, near_vectors(rows, list_rows=5).collect())) == one


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None),
        (5, None, 1),
        (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1),
        (8, [float("nan"), 1.0], 1),
        (9, [float("inf"), 1.0], 1),
        (10, [], 1),
        (11, [1.0, 0.0], 1),
        (11, [1.0, 0.0], 1),
        (12, [1.0, 0.0, 0.0], 1),
    ]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", id long, n long, pivots string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect())
    linked = [(1, 3, 1, True), (2, 3, 1, True), (11, 3, 1, False), (11, 3, 1, False)]
    linked[1] = (2, 3, 1, False)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)]
    assert got == sorted(linked + alone)
    assert near_vectors(table.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links = brute(rows)
    assert {r.vec_id: r.n_links for r in op6_embedding_dedup(spark, sf).collect()} == {i: len(x) for i, x in links.items()}
