import numpy as np
import pytest

from lectern.llm import knn


def brute(ids, x, threshold, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= threshold:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_clusters_and_unusable(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 64))
    x = np.concatenate([centre + rng.normal(size=centre.shape) * 0.15 for _ in range(8)] + [rng.normal(size=(400, 64))]).astype(np.float32)
    x *= rng.uniform(0.1, 9, size=(len(x), 1)).astype(np.float32)
    ids = list(range(len(x)))
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [1.0] * 3), (9005, [float("inf")] * 64), (9006, [None] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)] + [(i, v, 1) for i, v in bad], "vec_id long, embeddings array<float>, q int")
    df = df.unionAll(df.where("vec_id < 5"))
    want = brute(ids, x.astype(float), 0.88, 5)
    # Cells of a few rows, so that residents and visitors are split into blocks.
    monkeypatch.setattr(knn, "RESIDENTS", 20)
    monkeypatch.setattr(knn, "VISITORS", 30)
    got = {tuple(r) for r in knn.similar_pairs(df).collect()}
    assert len(want) > 200 and len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(want)
    asked = knn.top_k(df, min_sim=0.88, queries=df.selectExpr("vec_id q").where("q % 50 = 0"))
    assert {r.q % 50 for r in asked.collect()} <= {0}


def test_codes_keep_the_cosine():
    u = np.random.default_rng(1).normal(size=(500, 64))
    u = (u / np.linalg.norm(u, axis=1)[:, None]).astype(np.float32)
    d = knn._decode(np.stack([np.frombuffer(c, np.uint8) for c in knn._codes(u)]))
    assert np.abs(d @ d.T - u @ u.T).max() < knn.CODE_ERROR


def test_ties_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0] + [0.0] * 63) for i in range(9)], "vec_id long, embeddings array<float>")
    r = knn.top_k(same, k=3).collect()
    assert {(x.q, x.n) for x in r if x.q == 8} == {(8, 0), (8, 1), (8, 2)} and {(x.q, x.n) for x in r if x.q == 1} == {(1, 0), (1, 2), (1, 3)}
    assert knn.similar_pairs(same.limit(0)).count() == 0


def exact_ties(ids, x, asked, k):
    """{(q, n)} by brute force, and the k-th best cosine of each q."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    out, kth = set(), {}
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        top = sorted(range(len(ids)), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in top}
        kth[ids[i]] = s[top[-1]]
    return out, kth


@pytest.mark.parametrize("min_sim", [-2.0, 0.5])
@pytest.mark.parametrize("residents", [4096, 500])
def test_crowded_topic(spark, monkeypatch, min_sim, residents):
    rng = np.random.default_rng(8)
    c = rng.normal(size=64)
    x = (c + 0.15 * rng.normal(size=(3000, 64))).astype(np.float32)
    x[1000:1040] = x[7]  # more copies than any fixed number of candidates
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embeddings array<float>")
    df = df.unionAll(df.where("vec_id < 3"))
    monkeypatch.setattr(knn, "RESIDENTS", residents)
    asked = [*range(0, 3000, 60), 7, 1001, 1039]
    want, _ = exact_ties(ids, x, asked, 5)
    # One cell for all, so that only the choice of candidates is tested.
    got = knn.top_k(df, min_sim=min_sim, queries=spark.createDataFrame([(i,) for i in asked], "q long"), projections=1, tables=1, probes=1, width=1e6).collect()
    assert {(r.q, r.n) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bits", [4, 8])
def test_bounds_hold(bits):
    rng = np.random.default_rng(2)
    u = np.concatenate([rng.normal(size=(200, 64)), rng.normal(size=64) + 0.1 * rng.normal(size=(200, 64)), np.eye(64) + 0.07]).astype(np.float32)
    u /= np.linalg.norm(u, axis=1)[:, None]
    ids = np.arange(len(u))
    d, off = knn._opened(knn._bounded_codes(u, bits), 64, bits)
    s = u.astype(float) @ u.T.astype(float)
    for q, n, lo, hi in knn._best(d, off, ids, d, off, ids, len(u), -2.0):
        assert (lo <= s[q, n]).all() and (s[q, n] <= hi).all() and len(q) == len(u) * (len(u) - 1)


@pytest.mark.parametrize("rows", [0, 1, 10**4, 10**6, 10**9])
def test_shape(rows):
    s = knn.shape_for(rows)
    assert 4 <= s["projections"] <= 24 and s["tables"] >= 4
