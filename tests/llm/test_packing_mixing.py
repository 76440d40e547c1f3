import itertools
import random

import numpy as np
import pytest

from lectern.llm import mixing, packing, tokens


def test_hilbert_is_a_path():
    for dims, bits in ((2, 4), (3, 3)):
        c = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert(c, bits)
        assert sorted(key) == list(range(len(c)))
        walk = c[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_token_counts(monkeypatch):
    assert tokens.length("") == 0 and tokens.length("hello world") == 2
    long = "word and word\n" * 30_000
    plain = tokens.encoder(tokens.DEFAULT).encode_ordinary
    assert tokens.length(long) == len(plain(long))
    assert tokens.length(" " * 400_000) > 0
    # The cut beside runs of blanks changes no size.
    rng = random.Random(4)
    monkeypatch.setattr(tokens, "RUN", 3)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "Bc", "'s", "'ll", "12", "-", "(", "é", "漢", "\u00a0", "\x1c", " ", "  ", "\n", "\t", " " * 7, "\n\n\n\n", "\u2003 \n \u3000"]) for _ in range(rng.randint(0, 12)))
        assert tokens.length(t) == len(plain(t)), repr(t)


def docs(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["pump", "valve", "seal", "rotor"], int(rng.integers(1, 90)))), str(rng.choice(["A", " a ", "b", "c"], p=[0.5, 0.2, 0.25, 0.05])), 1) for i in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(9001, None, "a", 1), (9002, "", "b", 1), (9003, "x", None, 1), (None, "x", "a", 1)], "doc_id long, text string, source string, tokens int")


def test_packing(spark):
    d = docs(spark).unionByName(spark.createDataFrame([(5000, "pump " * 700, "a", 1)], "doc_id long, text string, source string, tokens int"))
    box = spark.createDataFrame([(1, "s", 64), (2, "l", 512), (3, "none", None), (4, "zero", 0)], "container_id int, label string, capacity_tokens long")
    p = packing.pack(d, box).toPandas()
    size = {r.doc_id: r.n for r in d.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).select("doc_id", tokens.count(packing.F.col("text")).alias("n")).collect()}
    for c, cap in ((1, 64), (2, 512)):
        q = p[p.container_id == c]
        assert q.groupby("bin_id").tokens.sum().max() <= cap
        assert q.groupby("doc_id").tokens.sum().to_dict() == size
        cut = q.groupby("doc_id").size()
        assert all(size[i] > cap for i in cut[cut > 1].index)
        assert q.tokens.sum() / (q.bin_id.nunique() * cap) > 0.85
    assert set(p.container_id) == {1, 2}
    r = packing.report(packing.pack(d, box, keys=True, window=64, keep_open=64), box).toPandas()
    assert set(r.container_id) == {1, 2} and (r.fill <= 1).all() and (r.spread < 0.9).all()
    assert packing.pack(d.limit(0), box).count() == 0 and packing.pack(d, box.limit(0)).count() == 0


def test_mixing(spark):
    d = docs(spark, 3000)
    t = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "C", 0.2, 3), (2, "b", 0.6, 2), (2, "missing", 0.4, 2), (3, "missing", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, buckets=8).toPandas()
    one = m[m.mix_id == 1]
    share = one.groupby("source").tokens.sum() / one.tokens.sum()
    assert share.to_dict() == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}, abs=0.01)
    most = one.groupby(["source", "doc_id"]).size().groupby("source").max()
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 3
    # Positions follow the schedule: the small source is denser late, the large one early.
    half = one.position.max() / 2
    late = one[one.position > half].groupby("source").tokens.sum() / one.groupby("source").tokens.sum()
    assert late["c"] > 0.55 > 0.5 > late["a"]
    assert m.groupby("mix_id").position.apply(lambda s: s.is_monotonic_increasing).all()
    r = {(x.mix_id, x.source): x for x in mixing.report(d, t, buckets=8).collect()}
    assert r[(2, "b")].actual_share == 1.0 and r[(2, "missing")].tokens == 0 and r[(3, "missing")].actual_share == 0.0
    assert mixing.mix(d.limit(0), t).count() == 0
