import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.operators import answers, bm25, dense, retrieval


def test_bm25_equals_loop(spark, tmp_path):
    rng = random.Random(1)
    words = ["pump", "valve", "seal", "rotor", "bolt", "gasket"]
    docs = [(f"d{i}_1_0", "f.txt", "A" if i % 2 else None, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(40)] + [("d99_1_0", None, "A", None), ("d0_1_0", "f.txt", None, "pump")][:1]
    c = spark.createDataFrame(docs, "chunk_id string, filename string, folder string, content string")
    q = spark.createDataFrame([(1, "pump seal pump"), (2, "nothing here"), (3, "")], "q_id long, text string")
    index = bm25.build(c, use_stem=False)
    got = {(r.q_id, r.chunk_id): r.bm25 for r in bm25.score(index, q).collect()}
    toks = {d[0]: ["" if False else w for w in f"[{d[1] or ''}] {d[3] or ''}".replace("[", " ").replace("]", " ").replace(".", " ").split()] for d in docs}
    df = Counter(w for t in toks.values() for w in set(t))
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    for d, t in toks.items():
        tf, s = Counter(t), 0.0
        for w in ["pump", "seal", "pump"]:
            if w in tf:
                idf = raw[w] if raw[w] >= 0 else 0.25 * mean
                s += idf * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        assert got.get((1, d), 0.0) == pytest.approx(s)
    assert not [k for k in got if k[0] in (2, 3)]
    top = bm25.top_k(bm25.score(index, q), 3).collect()
    assert len(top) <= 3 and [r.bm25_rank for r in sorted(top, key=lambda r: r.bm25_rank)] == list(range(1, len(top) + 1))
    # Stored, loaded, changed.
    path = f"file://{tmp_path}/index"
    assert bm25.load(spark, path) is None
    again = bm25.load_or_build(spark, path, c, use_stem=False)
    assert again.postings.count() == index.postings.count()
    grown = bm25.add(index, spark.createDataFrame([("new_1_0", "f.txt", None, "unique")], c.schema))
    assert grown.doclen.count() == index.doclen.count() + 1
    assert bm25.remove_document(grown, "new").doclen.count() == index.doclen.count()


def test_dense_excludes_unusable_and_self(spark):
    v = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 3.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0]), ("i", [float("nan"), 1.0])]
    vec = spark.createDataFrame(v, "chunk_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1], "a"), (2, [0.0, 0.0], "x")], "q_id long, vec array<double>, self_id string")
    got = [(r.q_id, r.chunk_id, round(r.distance, 4)) for r in dense.top_k(q, vec, k=5, dim=2, q_block=1, c_block=2).orderBy("sem_rank").collect()]
    assert got == [(1, "b", 0.005), (1, "c", 0.9005)]


def test_named_documents(spark):
    q = spark.createDataFrame([(1, "What says budget.txt?"), (2, "the safetymargin of it"), (3, "safetymargins"), (4, None), (5, "a.b")], "q_id long, text string")
    f = spark.createDataFrame([("budget.txt",), ("safetymargin.txt",), (None,), ("a.b",)], "filename string")
    assert {tuple(r) for r in retrieval.named_documents(q, f).collect()} == {(1, "budget.txt"), (2, "safetymargin.txt"), (5, "a.b")}


def _greedy(rows, named, k=8, per=2):
    limit = min(k, max(4, k // max(1, len(named)))) if named else 0
    out, seen = [], Counter()
    for c, f, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(out) >= k:
            break
        if seen[f] < (limit if f in named else per):
            out.append(c)
            seen[f] += 1
    return out


def test_diversity_equals_greedy(spark):
    rng = random.Random(4)
    rows, named = [], []
    for q in range(30):
        for i in range(rng.randint(1, 20)):
            rows.append((q, f"{q}_{i}", f"f{rng.randint(0, 3)}", rng.randint(1, 9) / 10))
        named += [(q, f"f{j}") for j in range(rng.randint(0, 2))]
    s = spark.createDataFrame([(q, c, v) for q, c, _, v in rows], "q_id long, chunk_id string, score double")
    ch = spark.createDataFrame([(c, f) for _, c, f, _ in rows], "chunk_id string, filename string")
    n = spark.createDataFrame(named, "q_id long, filename string")
    got = defaultdict(list)
    for r in retrieval.diverse(s, ch, n).orderBy("q_id", "pos").collect():
        got[r.q_id].append(r.chunk_id)
    for q in range(30):
        assert got[q] == _greedy([(c, f, v) for x, c, f, v in rows if x == q], {f for x, f in named if x == q})


def test_tables_and_blocks(spark):
    big = [("D_1_%d" % i, "D", "d.txt", 1, i, "D_t0", f"row {i}") for i in range(60)]
    small = [("E_2_%d" % i, "E", "e.txt", 2, i, "E_t0", f"cell {i}") for i in range(5)]
    rest = [("E_1_-1", "E", "e.txt", 1, -1, None, "summary"), ("F_1_-100", "F", "f.txt", 1, -100, None, None)]
    c = spark.createDataFrame(big + small + rest, "chunk_id string, doc_id string, filename string, page int, chunk_index int, table_id string, content string").withColumn("chunk_type", F.when(F.col("chunk_index") <= -100, "image"))
    top = spark.createDataFrame([(1, "D_1_7", 0.3, 1), (1, "E_2_0", 0.2, 2), (1, "F_1_-100", 0.1, 3)], "q_id long, chunk_id string, score double, pos int")
    whole = retrieval.with_tables(retrieval.with_summaries(top, c), c)
    order = [r.chunk_id for r in whole.orderBy("pos").collect()]
    assert order == ["E_2_1", "E_2_2", "E_2_3", "E_2_4", "D_1_7", "E_2_0", "F_1_-100", "E_1_-1"]
    b = retrieval.blocks(whole, c)
    got = {r.chunk_id: r.neighbours for r in b.collect()}
    assert got["D_1_7"] == [f"D_1_{i}" for i in range(5, 10)] and not {"E_2_0", "E_2_3", "E_2_4"} & set(got)
    assert got["F_1_-100"] == ["F_1_-100"]
    cited = retrieval.citations(b, c).orderBy("cited").collect()
    assert [r.doc_id for r in cited] == ["E", "D", "F"] and cited[0].pages == [1, 2] and cited[2].figures[0].idx == 0


def test_rerank_caps_the_rest(spark):
    s = spark.createDataFrame([(1, f"c{i:02d}", 1 - i / 100, "named" if i == 25 else "ranked") for i in range(30)], "q_id long, chunk_id string, score double, origin string")
    c = spark.createDataFrame([(f"c{i:02d}", "x") for i in range(30)], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "x")], "q_id long, text string")
    r = {x.chunk_id: x.score for x in retrieval.rerank(s, c, q).collect()}
    assert r["c00"] == 1 / 61 and r["c19"] == 1 / 80 and r["c20"] == pytest.approx(0.5 / 81) and r["c25"] == pytest.approx(0.75)


def test_answers(spark):
    runs = spark.createDataFrame([(1, 0, False, ["1v", "2v"]), (1, 1, False, ["1v"]), (1, 2, True, ["9v"]), (2, 0, False, ["1v"]), (3, 0, False, [])], "g int, run int, refused boolean, values array<string>")
    assert {r.g: r.drift for r in answers.drift(runs, ["g"]).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    conv = spark.createDataFrame([(1, "user", "old", 1), (1, "assistant", "a", 2), (1, "user", "last", 3)], "q_id long, role string, text string, turn int")
    q = spark.createDataFrame([(1, "more"), (2, "new")], "q_id long, text string")
    assert {r.q_id: r.text for r in retrieval.augmented(q, conv).collect()} == {1: "last more", 2: "new"}
    assert [r.text for r in retrieval.variants(q, lambda t: F.lit("a\n\nb\nc\nd")).where("q_id = 1").orderBy("variant").collect()] == ["more", "a", "b", "c"]


def test_index_is_stored_in_whole_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([("d_1_0", "f.txt", "A", "pump seal")], "chunk_id string, filename string, folder string, content string")
    two = one.unionAll(spark.createDataFrame([("e_1_0", "g.txt", "B", "pump valve pump")], one.schema))
    bm25.save(bm25.build(one), path)
    before = bm25.load(spark, path)
    assert before.stemmed and before.doclen.count() == 1
    # A version that was begun and never finished is not read.
    bm25.build(two).postings.write.parquet(f"{path}/v{bm25.VERSION}-unfinished/postings")
    assert bm25.load(spark, path).doclen.count() == 1
    bm25.save(bm25.build(two), path)
    now = bm25.load(spark, path)
    assert now.doclen.count() == 2 and {(r.term, r.n) for r in now.terms().collect()} == {(r.term, r.n) for r in bm25.build(two).terms().collect()}
    assert {r.dl for r in now.postings.where("chunk_id = 'e_1_0'").collect()} == {5}
    q = spark.createDataFrame([(1, "pump", "A"), (2, "pump", None), (3, "pump", "none")], "q_id long, text string, folder_filter string")
    assert {(r.q_id, r.chunk_id) for r in bm25.score(now, q).collect()} == {(1, "d_1_0"), (2, "d_1_0"), (2, "e_1_0")}
