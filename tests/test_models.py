import numpy as np
from pyspark.sql import functions as F

from lectern.operators import answers, bm25, corpus, models, procedure, retrieval


def test_hooks(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i}") for i in range(80)], "id int, text string").repartition(3)

    def model(texts):
        assert len(texts) <= 5 and all(t.startswith("search_query: text ") for t in texts)
        return [[float(t.rsplit(" ", 1)[1])] for t in texts]

    vec = models.embedder(model, kind="query", batch=5)
    assert {r.id: r.v for r in df.select("id", vec(F.col("text")).alias("v")).collect()} == {i: None if i % 7 == 0 else [float(i)] for i in range(80)}

    def reply(prompts):
        if prompts[0].endswith("3"):
            raise RuntimeError("down")
        return [None if p.endswith("4") else p.upper() for p in prompts]

    ask = models.generator(reply)
    got = {r.id: r.a for r in df.select("id", ask(F.col("text")).alias("a")).collect()}
    assert got[3] is None and got[4] == "" and got[7] is None and got[5] == "TEXT 5"
    m = spark.range(1).select(models.messages(F.lit("s"), F.lit("u")).alias("m")).first().m
    assert [tuple(x) for x in m] == [("system", "s"), ("user", "u")]
    h = np.array(models.hashed(16)(["one two", "", "One, TWO"]))
    assert np.allclose(h[0], h[2]) and not h[1].any() and abs(np.linalg.norm(h[0]) - 1) < 1e-9


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, page int, chunk_index int, chunk_type string, content string, note string")


def test_procedure(spark):
    rows = [(f"a{p}{i}", "a", p, i, None, f"chunk {p}{i} ", "x") for p in (2, 1) for i in range(3)]
    rows += [("b0", "b", 1, 0, None, "only", "x"), ("b0", "b", 1, 0, None, "only", "x"), ("b1", "b", 1, 1, None, "  ", "x"), ("b2", "b", 1, 2, None, None, "x"), ("b3", "b", None, 3, None, "no page", "x"), ("i", "b", 1, -100, "image", "fig", "x"), ("s", "c", 1, -1, None, "sum", "x"), ("n", None, 1, 0, None, "lost", "x")]
    c = _chunks(spark, rows)
    said = lambda p: F.when(F.contains(p, F.lit("chunk 10 \n\nchunk 11 \n\nchunk 12 ")) & ~F.contains(p, F.lit("chunk 21")), "Steps\n 1. do\n2. done\n3.").otherwise("")
    got = {(r.doc_id, r.step): r.text for r in procedure.steps(c, said, shown=4).collect()}
    assert got == {("a", 1): "1. do", ("a", 2): "2. done", ("b", 1): "no page", ("b", 2): "only"}
    plain = {(r.doc_id, r.step): r.text for r in procedure.steps(c).collect()}
    assert [plain["a", i] for i in range(1, 7)] == ["chunk 10", "chunk 11", "chunk 12", "chunk 20", "chunk 21", "chunk 22"]
    assert procedure.steps(c.limit(0), said).count() == 0
    one = spark.range(1).select(procedure.go(F.lit(4), F.lit(5)).alias("a"), procedure.go(F.lit(0), F.lit(5), back=F.lit(True)).alias("b"), procedure.go(F.lit(1), F.lit(5), step=F.lit(9)).alias("c"), procedure.go(F.lit(1), F.lit(5)).alias("d"), procedure.go(F.lit(0), F.lit(0)).alias("e")).first()
    assert tuple(one) == (4, 0, 4, 2, 0)


def test_late_figures_and_clear(spark, tmp_path):
    c = corpus.Corpus(spark, f"file://{tmp_path}/c", buckets=4)
    assert c.clear() == 0
    rows = spark.createDataFrame([("a_1_0", "a", "fa", "F", 1, 0, None, None, "t"), ("b_1_0", "b", "fb", "F", 1, 0, None, None, "t")], "chunk_id string, doc_id string, filename string, folder string, page int, chunk_index int, chunk_type string, caption_status string, content string")
    c.create(rows)
    heads = spark.createDataFrame([("a", "Ta", "fa", "F"), ("gone", "Tg", "fg", "F")], "doc_id string, title string, filename string, folder string")
    i = spark.createDataFrame([("a", 1, -100, None, "pending"), ("a", 2, -100, "read", "ocr"), ("gone", 1, -100, "x", "ocr")], "doc_id string, page int, chunk_index int, caption string, caption_status string")
    for _ in range(2):  # again: the same chunks are written over
        c.add_late(corpus.figures(i, heads))
        got = {r.chunk_id: r.content for r in c.chunks().collect()}
        assert got == {"a_1_0": "t", "b_1_0": "t", "a_1_-100": f"[Ta] [Figure on page 1]: {corpus.PENDING}", "a_2_-100": "[Ta] [Figure on page 2]: read"}
    at = f"file://{tmp_path}/index"
    bm25.save(bm25.build(c.chunks()), at)
    bm25.clear(spark, at)
    bm25.clear(spark, at)
    assert bm25.load(spark, at) is None and c.clear() == 4 and c.clear() == 0


def test_live(spark):
    df = spark.sql("select id, case when id < 3 then timestamp'2024-01-01 10:00:00' + make_dt_interval(0, id) end as created_at, id as seconds from range(4)")
    assert {r.id for r in answers.live(df, F.lit("2024-01-01 13:00:00").cast("timestamp")).collect()} == {1, 2}


def test_questions_without_vectors(spark):
    words = ["pump seal torque", "valve spring force", "tank wall thickness", "hose length"]
    rows = [(f"d{i}_1_0", f"d{i}", f"f{i}.txt", "F", 1, 0, None, None, w, "n") for i, w in enumerate(words)]
    c = spark.createDataFrame(rows, "chunk_id string, doc_id string, filename string, folder string, page int, chunk_index int, chunk_type string, table_id string, content string, note string")
    v = c.select("chunk_id", models.embedder(models.hashed(64))(F.col("content")).alias("vec"))
    q = spark.createDataFrame([(1, "pump seal torque"), (2, "which is the best valve spring")], "q_id long, text string")
    s = retrieval.stages(q, c, bm25.build(c), v, embed=models.embedder(models.hashed(64), kind="query"))
    first = {r.q_id: r.chunk_id for r in s["context"].where("pos = 1").collect()}
    assert first[1] == "d0_1_0" and first[2] == "d1_1_0"
    assert s["floors"].where("origin = 'comparison' and q_id = 2").count() == 4
