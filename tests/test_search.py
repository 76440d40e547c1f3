import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import bm25, bm25_blocks, dense, retrieval

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(f"c{i:03d}", f"f{i % 9}.txt", rng.choice([None, "A", "B"]), " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 12)))) for i in range(300)]
    asks = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 5))) if i % 7 else "w1 w2", rng.choice([None, "A", "B", "none"])) for i in range(60)] + [(60, None, None), (61, "", "A")]
    return docs, asks


@pytest.fixture(scope="module")
def frames(spark, texts):
    c = spark.createDataFrame(texts[0], "chunk_id string, filename string, folder string, content string").repartition(3)
    return c, spark.createDataFrame(texts[1], "q_id long, text string, folder_filter string")


@pytest.mark.parametrize("stemmed,seeded", [(False, 50_000), (True, 50_000), (False, 10)])
def test_search_equals_all_pairs_ranked(frames, monkeypatch, stemmed, seeded):
    """The best of each question without a pair of question and chunk shuffled (bm25_topk, bm25_in_folder)."""
    monkeypatch.setattr(bm25, "SEEDED", seeded)
    c, q = frames
    index = bm25.build(c, use_stem=stemmed)
    for asked in (q, q.drop("folder_filter")):
        want = {(r.q_id, r.chunk_id): (r.bm25_rank, round(r.bm25, 8)) for r in bm25.top_k(bm25.score(index, asked), 4).collect()}
        got = bm25.search(index, asked, 4)
        assert {(r.q_id, r.chunk_id): (r.bm25_rank, round(r.bm25, 8)) for r in got.collect()} == want and want


def test_search_in_files_ranks_chunks_without_terms(frames):
    c, q = frames
    index = bm25.build(c, use_stem=False)
    asked = q.withColumn("filename", F.concat(F.lit("f"), (F.col("q_id") % 11).cast("string"), F.lit(".txt"))).withColumn("k", (F.col("q_id") % 5 + 1).cast("int"))
    got = {(r.q_id, r.filename, r.chunk_id, r.bm25_rank) for r in bm25.search_files(index, asked).collect()}
    score = {(r.q_id, r.chunk_id): r.bm25 for r in bm25.score(index, q.drop("folder_filter")).collect()}
    chunks, want = c.collect(), set()
    for a in asked.collect():
        mine = [x.chunk_id for x in chunks if x.filename == a.filename and a.folder_filter in (None, x.folder)]
        best = sorted(mine, key=lambda x: (-round(score.get((a.q_id, x), 0.0), 9), x))[: a.k]
        want |= {(a.q_id, a.filename, x, i + 1) for i, x in enumerate(best)}
    assert got == want and want


def test_negative_weights_leave_nothing_out():
    """With a negative inverse frequency partial sums are no bounds."""
    import pyarrow as pa

    parts = [(pa.RecordBatch.from_pydict({"chunk_id": ["a", "b", "c"], "folder": ["", "", ""], "filename": ["", "", ""], "dl": pa.array([2, 2, 2], pa.int32())}), np.array([0, 0, 1, 2]), np.array([0, 1, 0, 0]), np.array([1, 1, 1, 1]))]
    x = bm25_blocks._Block(parts, 2, 2.0, 1.5, 0.75, False)
    found, s = x.top([(2.0, 2.0, 0, 3), (-1.0, -1.0, 3, 4)], 2, 0.0)
    assert x.ids.take(bm25_blocks.pa.array(found)).to_pylist() == ["b", "c"] and s.tolist() == [2.0, 2.0]


def test_dense_equals_numpy_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (90, 3)).astype(float)
    v[v.any(axis=1) == 0] = 1.0
    fol = [None if i % 5 == 0 else "AB"[i % 2] for i in range(90)]
    vec = spark.createDataFrame([(f"c{i:02d}", v[i].tolist(), fol[i]) for i in range(90)], "chunk_id string, vec array<double>, folder string").repartition(2)
    q = spark.createDataFrame([(i, v[i].tolist(), f"c{i:02d}", "A" if i % 3 == 0 else None) for i in range(40)], "q_id long, vec array<double>, self_id string, folder_filter string")
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(40):
        mine = [j for j in range(90) if j != i and (i % 3 or fol[j] == "A")]
        want |= {(i, f"c{j:02d}", r + 1) for r, j in enumerate(sorted(mine, key=lambda j: (-s[i, j], j))[:7])}
    got = dense.top_k(q, vec, k=7, dim=3, q_block=16, c_block=10)
    assert {(r.q_id, r.chunk_id, r.sem_rank) for r in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_names_that_begin_alike_meet_by_long_pieces(spark):
    """A question meets the few names that share a long beginning, not all that share four characters."""
    q = spark.createDataFrame([(1, "spring manual ab-0000007.pdf please"), (2, "x.y of it")], "q_id long, text string")
    f = spark.createDataFrame([(f"spring manual ab-{i:07d}.pdf",) for i in range(50)] + [("x.y",), (".pdf",)], "filename string")
    assert {tuple(r) for r in retrieval.named_documents(q, f).collect()} == {(1, "spring manual ab-0000007.pdf"), (2, "x.y"), (1, ".pdf")}
    assert max(retrieval.PIECES) >= 24


def test_index_is_not_asked_for_without_questions(spark):
    """A catalogue question needs no keyword index (catalog_context)."""
    c = spark.createDataFrame([("d_1_0", "d", "d.txt", "A", 1, 0, None, None, "[T] text")], "chunk_id string, doc_id string, filename string, folder string, page int, chunk_index int, table_id string, chunk_type string, content string")
    q = spark.createDataFrame([(1, "Show a table of all documents with their revisions", None, None, "")], "q_id long, text string, folder_filter string, vec array<float>, self_id string")
    v = spark.createDataFrame([("d_1_0", [1.0] * 64, "A")], "chunk_id string, vec array<float>, folder string")

    def index():
        raise AssertionError("not needed")

    assert [r.chunk_id for r in retrieval.stages(q, c, index, v)["blocks"].collect()] == ["d_1_0"]


CHUNK = "chunk_id string, doc_id string, filename string, folder string, page int, chunk_index int, table_id string, chunk_type string, content string"


def test_stages_pass_once_over_the_index(spark, monkeypatch):
    """The lists of a question, of the files and subsystems it names and of a comparison come from one search (context_blocks)."""
    c = spark.createDataFrame([(f"d{i}_1_0", f"d{i}", f"name{i}.txt", "A", 1, 0, None, None, f"[T] domain digest Pump AB-{i}") for i in range(9)], CHUNK)
    q = spark.createDataFrame([(1, "AB-1 Pump name2.txt compare which is highest", [1.0] * 64, "")], "q_id long, text string, vec array<float>, self_id string")
    v = spark.createDataFrame([(f"d{i}_1_0", [1.0 + i] * 64) for i in range(9)], "chunk_id string, vec array<float>")
    calls, search = [], bm25._search
    monkeypatch.setattr(bm25, "_search", lambda *a: calls.append(1) or search(*a))
    got = retrieval.stages(q, c, bm25.build(c, use_stem=False), v, until="floors")["floors"].collect()
    assert len(calls) == 1 and {"named", "comparison"} <= {r.origin for r in got}


@pytest.mark.parametrize("most", [50_000, 0])
def test_once_keeps_a_row_of_each_key(spark, monkeypatch, most):
    """Repeated ids are found without shuffling whole rows, however many (bm25_in_folder)."""
    from lectern import runtime

    monkeypatch.setattr(runtime, "REPEATED", most)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5), ("c", 6)], "chunk_id string, n int")
    got = {r.chunk_id: r.n for r in runtime.once(df, "chunk_id").collect()}
    assert runtime.once(df, "chunk_id").count() == 4 and set(got) == {"a", "b", None, "c"} and got["b"] in (2, 3) and got[None] in (4, 5)
    one = spark.createDataFrame([("a", "f", "A", "x y")], "chunk_id string, filename string, folder string, content string")
    assert "Exchange" not in bm25.build(one, use_stem=False, unique=True).forward._jdf.queryExecution().executedPlan().toString()


def test_catalogue_questions_search_nothing(spark, monkeypatch):
    """Where only catalogue questions are asked no vectors are compared either, and every stage is there (catalog_context)."""
    def top_k(*_, **__):
        raise AssertionError("not needed")

    monkeypatch.setattr(dense, "top_k", top_k)
    c = spark.createDataFrame([("d_1_0", "d", "d.txt", "A", 1, 0, None, None, "[T] text")], CHUNK)
    q = spark.createDataFrame([(1, "Show a table of all documents with their revisions", "A", None, "")], "q_id long, text string, folder_filter string, vec array<float>, self_id string")
    v = spark.createDataFrame([("d_1_0", [1.0] * 64, "A")], "chunk_id string, vec array<float>, folder string")
    got = retrieval.stages(q, c, None, v)
    assert [r.chunk_id for r in got["blocks"].collect()] == ["d_1_0"] and got["prompts"].count() == got["citations"].count() == 1
    assert all(got[s].count() == 0 for s in ("dense", "named", "lexical", "rrf", "floors", "boosted", "reranked", "top", "context"))


def test_equal_questions_are_cut_into_pieces_once(spark):
    """Thousands of questions with one text make the pieces of one (catalog_context)."""
    q = spark.range(500).select(F.col("id").alias("q_id"), F.lit("show me name7.txt and all of the rest").alias("text"))
    f = spark.createDataFrame([(f"name{i}.txt",) for i in range(9)], "filename string")
    got = retrieval.named_documents(q, f)
    assert got.where("filename = 'name7.txt'").count() == got.count() == 500
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert "Aggregate [" in below[: below.index("Range")]
    assert "SortMergeJoin [g#" in got._jdf.queryExecution().executedPlan().toString()


def test_stages_do_only_what_is_asked(spark, monkeypatch):
    """Floors need no ranked list and names are sought once; the best chunks need no context (named_injection, reranked_scores, diverse_top)."""
    c = spark.createDataFrame([(f"d{i}_1_0", f"d{i}", f"name{i}.txt", "A", 1, 0, None, None, f"[T] domain digest Pump AB-{i}") for i in range(9)], CHUNK)
    q = spark.createDataFrame([(1, "AB-1 Pump name2.txt compare which is highest", [1.0] * 64, "")], "q_id long, text string, vec array<float>, self_id string")
    v = spark.createDataFrame([(f"d{i}_1_0", [1.0 + i] * 64) for i in range(9)], "chunk_id string, vec array<float>")
    index, written, write = bm25.build(c, use_stem=False), {}, retrieval.materialize

    def kept(df, tag):
        written[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(retrieval, "materialize", kept)
    floors = retrieval.stages(q, c, index, v, until="floors")
    assert "catalog" not in written and "main" not in written["scores"] and [tag for tag, plan in written.items() if "contains(" in plan.lower()] == ["named"]
    assert [r.filename for r in floors["named"].collect()] == ["name2.txt"]
    best, whole = retrieval.stages(q, c, index, v, until="top"), retrieval.stages(q, c, index, v)
    assert "context" not in best and best["top"].collect() == whole["top"].collect() and best["reranked"].count() == whole["reranked"].count()
    assert {tuple(r) for r in floors["floors"].collect()} == {tuple(r) for r in whole["floors"].collect()}


def test_dense_blocks_rank_few(monkeypatch):
    """Wide blocks give the exact best with equal similarities by id, ranking little of a block (named_injection)."""
    rng, k = np.random.default_rng(3), 5
    u, asks = rng.integers(-2, 3, (900, 4)).astype(float) + 0.5, rng.integers(-2, 3, (7, 4)).astype(float) + 0.25
    ids = [f"c{i:03d}" for i in rng.permutation(900)]
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
    asked = {"q_id": np.arange(7), "u": unit(asks), "self": pa.array([ids[0], None, None, ids[5], "", "", ""]), "folder": pa.array([None, "A", None, "B", None, None, "none"])}
    folders = ["A" if i % 3 else "B" for i in range(900)]
    widths, partition = [], np.partition
    monkeypatch.setattr(dense.np, "partition", lambda a, *x, **y: widths.append(a.shape[-1]) or partition(a, *x, **y))
    chunks = pa.RecordBatch.from_pydict({"chunk_id": ids, "vec": u.tolist(), "folder": folders})
    run = dense._search(type("Sent", (), {"value": asked}), k, 4, 3, 400)
    got = [tuple(r.values()) for b in run(iter([chunks.slice(0, 500), chunks.slice(500)])) for r in b.to_pylist()]
    sim = np.round(unit(asks) @ unit(u).T, 9)
    for i in range(7):
        want = sorted((-sim[i, j], ids[j]) for j in range(900) if ids[j] != asked["self"][i].as_py() and asked["folder"][i].as_py() in (None, folders[j]))[:k]
        assert sorted((-s, c) for q, c, s in got if q == i)[:k] == want
    assert widths and max(widths) <= 4 * k


def test_scores_shuffle_no_vectors(spark):
    """Only the vectors of repeated chunks are shuffled, and the tasks leave out what isn't usable (reranked_scores)."""
    nan = float("nan")
    v = [[1.0, 0.0], [1.0, 1.0], [0.0, 0.0], None, [nan, 1.0], [None, 1.0], [1.0], [float("inf"), 0.0]]
    q = spark.createDataFrame([(1, [1.0, 0.0], "")], "q_id long, vec array<float>, self_id string")
    s = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(v)], "chunk_id string, vec array<float>")
    got = dense.top_k(q, s, k=9, dim=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :] and [r.chunk_id for r in got.orderBy("sem_rank").collect()] == ["c0", "c1"]
    # Of a repeated chunk a usable vector counts; doubles are taken as they are, and chunks without id left out.
    twice = s.unionByName(spark.createDataFrame([("c2", [0.0, 1.0]), ("c3", [0.0, 2.0]), ("c4", [nan, nan]), ("c0", [2.0, 0.0]), (None, [1.0, 0.0])], s.schema))
    for kind in ("float", "double"):
        t = twice.select("chunk_id", F.col("vec").cast(f"array<{kind}>").alias("vec"))
        assert [(r.chunk_id, round(r.distance, 6)) for r in dense.top_k(q, t, k=9, dim=2).orderBy("sem_rank").collect()] == [("c0", 0), ("c1", round(1 - 0.5**0.5, 6)), ("c2", 1), ("c3", 1)]


def test_scores_cut_each_file_name_once(spark):
    """The pieces of names are worked out after names are made distinct, not for each chunk (reranked_scores)."""
    q = spark.createDataFrame([(1, "show me name7.txt")], "q_id long, text string")
    f = spark.range(50).select(F.concat(F.lit("name"), F.col("id") % 9, F.lit(".txt")).alias("filename"))
    got = retrieval.named_documents(q, f)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    names = plan[plan.index("Aggregate [filename") :]
    assert "regexp_replace" not in names and [tuple(r) for r in got.collect()] == [(1, "name7.txt")]


def test_scores_search_few_blocks(spark, monkeypatch):
    """An index in many pieces is searched in no more blocks than there are cores, and its few first chunks together (reranked_scores)."""
    c = spark.createDataFrame([(f"d{i}_1_0", "name.txt", "A", f"word{i % 7} word{i % 3} pump") for i in range(200)], "chunk_id string, filename string, folder string, content string").repartition(20)
    q, index = spark.createDataFrame([(1, "word3 pump"), (2, "word1 word2")], "q_id long, text string"), bm25.build(c, use_stem=False, unique=True)
    want, blocks, seen = bm25.search(index, q, 5).collect(), bm25._blocks, []
    monkeypatch.setattr(bm25, "SEEDED", 50)
    monkeypatch.setattr(bm25, "_blocks", lambda rows, forward, avgdl: seen.append(forward.rdd.getNumPartitions()) or blocks(rows, forward, avgdl))
    assert sorted(map(tuple, bm25.search(index, q, 5).collect())) == sorted(map(tuple, want)) and len(want) == 10
    assert seen == [1, spark.sparkContext.defaultParallelism]


def test_scores_of_near_equal_vectors_are_exact(monkeypatch):
    """Similarities that single precision can't tell apart are ranked by their nine decimals (reranked_scores)."""
    rng, n, k = np.random.default_rng(5), 600, 7
    u = np.array([[1.0, 1.0, 1.0, 1.0]]) + rng.normal(0, 1e-4, (n, 4))
    ids, asks = [f"c{i:03d}" for i in rng.permutation(n)], u[:5] + 1e-5
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
    asked = {"q_id": np.arange(5), "u": unit(asks), "self": pa.array([""] * 5), "folder": pa.array([None] * 5, pa.string())}
    monkeypatch.setattr(dense, "EXACT", 50)
    products, matmul = [], np.einsum
    monkeypatch.setattr(dense.np, "einsum", lambda *a: products.append(len(a[1])) or matmul(*a))
    batch = pa.RecordBatch.from_pydict({"chunk_id": ids, "vec": u.tolist(), "folder": ["A"] * n})
    got = [tuple(r.values()) for b in dense._search(type("Sent", (), {"value": asked}), k, 4, 3, 250)(iter([batch.slice(0, 300), batch.slice(300)])) for r in b.to_pylist()]
    sim = np.round(unit(asks) @ unit(u).T, 9)
    for i in range(5):
        assert sorted((-s, c) for q, c, s in got if q == i)[:k] == sorted((-sim[i, j], ids[j]) for j in range(n))[:k]
    assert products and max(products) <= 50
