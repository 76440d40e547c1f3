"""From ranked candidates to cited context, for a whole batch of questions in one plan.

Each step is a DataFrame of ``(q_id, chunk_id, ...)``; ties are decided by chunk id.
Where a chunk came from is kept as ``origin`` instead of a special distance.

Defined results: a question without candidates has no rows in any step; repeated
candidates are one; null folders and file names are groups of their own; chunk text that
is null counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import materialize

RRF_K, GATE, POOL, CONTEXT_K, PER_FILE = 60, 1.3, 20, 8, 2
TABLE_MOST, TABLE_BUDGET, AROUND, STEM_LEAST = 24, 32, 2, 6
SUMMARY_BOOST, TABLE_BOOST = 3.0, 1.5
#: Origins whose chunks keep their score although the reranker didn't see them.
EXEMPT = ("named", "summary_of_named", "subsystem", "comparison")


#: Lengths of the pieces by which names of files are sought in questions.
PIECES = (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 28, 32)


# -- filters ------------------------------------------------------------------
def eq(field: str, value) -> Column:
    return F.col(field) == F.lit(value)


def ne(field: str, value) -> Column:
    """Not equal; a missing value differs from any other."""
    return ~F.col(field).eqNullSafe(F.lit(value))


def any_of(field: str, values) -> Column:
    return F.col(field).isin(list(values))


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of what is given; nothing given holds for every row."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def in_folder(condition: Column | None, folder: str | None) -> Column:
    return all_of(condition, None if folder is None else eq("folder", folder))


# -- candidates ---------------------------------------------------------------
def merge_hits(*hits: DataFrame) -> DataFrame:
    """Hits of several variants of a question: the smallest distance of each chunk."""
    return reduce(DataFrame.unionByName, [h.select("q_id", "chunk_id", "distance") for h in hits]).groupBy("q_id", "chunk_id").agg(F.min("distance").alias("distance"))


def open_questions(hits: DataFrame, named: DataFrame | None = None, threshold: float = GATE) -> DataFrame:
    """``(q_id)`` of questions that some hit is near enough to, or that name a document."""
    near = hits.groupBy("q_id").agg(F.bool_or(F.col("distance") <= threshold).alias("ok")).where("ok").select("q_id")
    return near if named is None else near.unionByName(named.select("q_id")).distinct()


def rrf(ranked: DataFrame, *, weight: Column | float = 1.0, k: int = RRF_K) -> DataFrame:
    """``(q_id, chunk_id, score)`` from ``(q_id, chunk_id, rank)`` rows of all lists together."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return ranked.groupBy("q_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("score"))


def named_documents(questions: DataFrame, files: DataFrame, least: int = STEM_LEAST) -> DataFrame:
    """``(q_id, filename)``: the question holds the file name, or its stem of at least ``least`` characters as a word of its own.

    A name that a question holds begins with one of the question's pieces of up to
    ``PIECES`` characters, so pieces as long as the stem allows are joined and the whole names
    compared after that: long ones, as many names begin alike.
    """
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    asked = questions.select("q_id", F.lower("text").alias("t")).where("t <> ''")
    # Questions that are alike are looked through once, by all cores: few as they are, Spark would give them to one task.
    q = asked.select("t").repartition(questions.sparkSession.sparkContext.defaultParallelism, "t").distinct()
    q = q.select("t", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("t"), n) for n in PIECES])))).alias("g"))
    f = files.select("filename").where("filename is not null and filename <> ''").distinct().withColumn("f", F.lower("filename"))
    f = f.withColumn("s", F.regexp_replace("f", r"\.[^.]*$", ""))
    # The stem begins the name, so its piece is the name's too.
    key, piece = F.when(F.col("s") == "", F.col("f")).otherwise(F.col("s")), F.lit(None).cast("string")
    for n in PIECES:
        piece = F.when(F.length(key) >= n, F.substring(key, 1, n)).otherwise(piece)
    # Never null, else Spark works the pieces out for every row of files, before these are made distinct, to leave null ones out.
    f = f.withColumn("g", F.coalesce(piece, F.lit("")))
    word = F.expr(r"t rlike concat('(?U)(?<!\\w)\\Q', replace(s, '\\E', ''), '\\E(?!\\w)')")
    # Spark takes the pieces to be as few as the texts and would send them all to the executors.
    held = q.join(f.hint("merge"), "g").where(F.col("t").contains(F.col("f")) | ((F.length("s") >= least) & F.col("t").contains(F.col("s")) & word)).select("t", "filename").distinct()
    return asked.join(held, "t").select("q_id", "filename").distinct()


def slots_of_named(named: DataFrame, context_k: int = CONTEXT_K) -> DataFrame:
    """``(q_id, filename, slots, diversity_limit)``: fewer named documents get more places each."""
    n = F.count("*").over(Window.partitionBy("q_id"))
    return named.distinct().select("q_id", "filename", F.greatest(F.lit(2), F.floor(F.lit(8) / n)).cast("int").alias("slots"), F.least(F.lit(context_k), F.greatest(F.lit(4), F.floor(F.lit(context_k) / n))).cast("int").alias("diversity_limit"))


def inject_named(best: DataFrame, named: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``(q_id, chunk_id, floor, origin)``: the best chunks ``(q_id, chunk_id, bm25_rank)`` of named documents by keyword score, and the documents' summaries (in the question's folder)."""
    summary = chunks.where("page = 1 and chunk_index = -1").select("filename", "chunk_id", "folder")
    there = named.select("q_id", "filename").distinct().join(summary, "filename").join(questions.select("q_id", "folder_filter"), "q_id").where(F.col("folder_filter").isNull() | (F.col("folder") == F.col("folder_filter")))
    floors = best.select("q_id", "chunk_id", (2 / (RRF_K + F.col("bm25_rank"))).alias("floor"), F.lit("named").alias("origin"))
    return floors.unionByName(there.select("q_id", "chunk_id", F.lit(3 / (RRF_K + 1)).alias("floor"), F.lit("summary_of_named").alias("origin")))


def _subsystems(questions: DataFrame) -> DataFrame:
    """``(q_id, folder_filter, text, n_id)``: each subsystem that a question names, with an id of its own."""
    return questions.select("q_id", "folder_filter", F.explode(F.array_distinct(text.subsystem_names(F.col("text")))).alias("text")).withColumn("n_id", F.xxhash64("q_id", "text"))


def inject_subsystems(questions: DataFrame, chunks: DataFrame, search) -> DataFrame:
    """Summary chunks on the page of the best keyword hit of each subsystem that a question names. ``search(names)`` ranks ``(q_id, text, folder_filter)`` rows."""
    names = _subsystems(questions)
    top = search(names.select(F.col("n_id").alias("q_id"), "text", "folder_filter")).where("bm25_rank = 1").select(F.col("q_id").alias("n_id"), "chunk_id")
    place = chunks.select("chunk_id", "doc_id", "page")
    goal = names.join(top, "n_id").join(place, "chunk_id").select("q_id", "doc_id", "page")
    there = chunks.where("chunk_index = -1").select("doc_id", "page", "chunk_id")
    return goal.join(there, ["doc_id", "page"]).select("q_id", "chunk_id", F.lit(2 / (RRF_K + 1)).alias("floor"), F.lit("subsystem").alias("origin")).distinct()


def inject_comparison(ranked: DataFrame) -> DataFrame:
    """Floors for the lists of a comparison question: ``ranked(q_id, chunk_id, rank)``."""
    return ranked.groupBy("q_id", "chunk_id").agg(F.max(3 / (RRF_K + F.col("rank"))).alias("floor")).withColumn("origin", F.lit("comparison"))


def raise_scores(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """Scores not below the floors of injected chunks; ``origin`` tells what put a chunk in."""
    f = floors.groupBy("q_id", "chunk_id").agg(F.max("floor").alias("floor"), F.min("origin").alias("injected"))
    j = scores.join(f, ["q_id", "chunk_id"], "full")
    had = F.col("origin") if "origin" in scores.columns else F.lit("ranked")
    return j.select("q_id", "chunk_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("floor", F.lit(0.0))).alias("score"), F.coalesce("injected", had).alias("origin"))


def boost(scores: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Summaries count threefold; for value questions chunks of tables one and a half times."""
    c = chunks.select("chunk_id", ((F.col("page") == 1) & (F.col("chunk_index") == -1)).alias("is_summary"), (F.coalesce("table_id", F.lit("")) != "").alias("in_table"))
    q = questions.select("q_id", text.is_value_question(F.col("text")).alias("for_value"))
    j = scores.join(c, "chunk_id").join(q, "q_id")
    s = F.col("score") * F.when(F.col("is_summary"), SUMMARY_BOOST).otherwise(1.0) * F.when(F.col("for_value") & F.col("in_table"), TABLE_BOOST).otherwise(1.0)
    return j.withColumn("score", s).drop("is_summary", "in_table", "for_value")


def rerank(scores: DataFrame, chunks: DataFrame, questions: DataFrame, reranker=None, pool: int = POOL) -> DataFrame:
    """The pool's scores become 1 / (60 + new rank), the others stay below the last of it.

    ``reranker(question, text)`` gives a column to sort by, largest first (a built-in
    expression or a pandas UDF); without one, or where it is null, the order stays.
    """
    w = Window.partitionBy("q_id")
    s = scores.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", 12)), "chunk_id")))
    top = s.where(F.col("r") <= pool)
    if reranker is not None:
        top = top.join(chunks.select("chunk_id", "content"), "chunk_id").join(questions.select("q_id", F.col("text").alias("_q")), "q_id")
        top = top.withColumn("_m", reranker(F.col("_q"), F.coalesce("content", F.lit("")))).drop("content", "_q")
    else:
        top = top.withColumn("_m", F.lit(None).cast("double"))
    top = top.withColumn("new", F.row_number().over(w.orderBy(F.desc_nulls_last("_m"), "r"))).select("q_id", "chunk_id", "new")
    size = top.groupBy("q_id").agg(F.count("*").alias("size"))
    j = s.join(top, ["q_id", "chunk_id"], "left").join(size, "q_id")
    capped = F.when(F.col("origin").isin(*EXEMPT), F.col("score")).otherwise(F.least("score", 0.5 / (RRF_K + F.col("size") + 1)))
    return j.select("q_id", "chunk_id", F.when(F.col("new").isNotNull(), 1.0 / (RRF_K + F.col("new"))).otherwise(capped).alias("score"), "origin")


def diverse(scores: DataFrame, chunks: DataFrame, named: DataFrame | None = None, *, k: int = CONTEXT_K, per_file: int = PER_FILE) -> DataFrame:
    """``(q_id, chunk_id, score, pos)``: the best k, at most ``per_file`` of a file; named files have more places."""
    s = scores.join(chunks.select("chunk_id", "filename"), "chunk_id")
    limit = F.lit(per_file)
    if named is not None:
        s = s.join(slots_of_named(named, k).select("q_id", "filename", "diversity_limit"), ["q_id", "filename"], "left")
        limit = F.coalesce("diversity_limit", limit)
    order = [F.desc(F.round("score", 12)), "chunk_id"]
    s = s.withColumn("in_file", F.row_number().over(Window.partitionBy("q_id", "filename").orderBy(*order))).where(F.col("in_file") <= limit)
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("pos") <= k).select("q_id", "chunk_id", "score", "pos")


# -- context ------------------------------------------------------------------
def with_summaries(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Behind the chosen chunks the summary of each of their documents that has none among them. ``(q_id, chunk_id, pos, origin)``"""
    place = chunks.select("chunk_id", "doc_id", ((F.col("page") == 1) & (F.col("chunk_index") == -1)).alias("is_summary"))
    t = top.join(place, "chunk_id")
    per = t.groupBy("q_id", "doc_id").agg(F.bool_or("is_summary").alias("has"))
    extra = per.where("not has").join(place.where("is_summary").select("doc_id", "chunk_id"), "doc_id")
    last = top.groupBy("q_id").agg(F.max("pos").alias("last"))
    extra = extra.join(last, "q_id").withColumn("pos", F.col("last") + F.row_number().over(Window.partitionBy("q_id").orderBy("chunk_id")))
    return top.select("q_id", "chunk_id", "pos", F.lit("top").alias("origin")).unionByName(extra.select("q_id", "chunk_id", "pos", F.lit("identity").alias("origin")))


def with_tables(top: DataFrame, chunks: DataFrame, *, most: int = TABLE_MOST, budget: int = TABLE_BUDGET) -> DataFrame:
    """Before the chosen chunks all others of their tables, by page and place; tables of more than ``most`` chunks aren't ones. ``(q_id, chunk_id, pos, origin)``"""
    tabled = chunks.where("coalesce(table_id, '') <> ''").select("chunk_id", "table_id", "page", "chunk_index")
    ids = top.join(tabled.select("chunk_id", "table_id"), "chunk_id").select("q_id", "table_id").distinct()
    all_ = ids.join(tabled, "table_id").withColumn("n", F.count("*").over(Window.partitionBy("q_id", "table_id"))).where(F.col("n") <= most)
    all_ = all_.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("page", "chunk_index", "chunk_id"))).where(F.col("r") <= budget)
    new = all_.join(top.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti").select("q_id", "chunk_id", F.lit(0).alias("g"), F.col("r").alias("p"), F.lit("table").alias("origin"))
    both = new.unionByName(top.select("q_id", "chunk_id", F.lit(1).alias("g"), F.col("pos").alias("p"), "origin"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("q_id").orderBy("g", "p"))).select("q_id", "chunk_id", "pos", "origin")


def blocks(top: DataFrame, chunks: DataFrame, around: int = AROUND) -> DataFrame:
    """``(q_id, pos, chunk_id, doc_id, filename, page, neighbours, block)``: each chosen text chunk with those around it on its page.

    A block is given unless all its chunks stand in earlier blocks. Chunks are found by
    an equality join on the places around them.
    """
    meta = chunks.select("chunk_id", "doc_id", "filename", "page", "chunk_index", "content")
    t = top.select("q_id", "pos", "chunk_id").join(meta.drop("content"), "chunk_id")
    near = F.when(F.col("chunk_index") >= 0, F.sequence(F.greatest(F.col("chunk_index") - around, F.lit(0)), F.col("chunk_index") + around)).otherwise(F.array("chunk_index"))
    at = t.withColumn("at", F.explode(near))
    n = meta.select(F.col("chunk_id").alias("n_id"), F.col("doc_id").alias("n_doc"), F.col("page").alias("n_page"), F.col("chunk_index").alias("n_index"), F.coalesce("content", F.lit("")).alias("n_text"))
    hit = at.join(n, (F.col("doc_id") == F.col("n_doc")) & (F.col("page") == F.col("n_page")) & (F.col("at") == F.col("n_index")))
    hit = hit.withColumn("fresh", F.min("pos").over(Window.partitionBy("q_id", "n_id")) == F.col("pos"))
    b = hit.groupBy("q_id", "pos", "chunk_id", "doc_id", "filename", "page").agg(F.bool_or("fresh").alias("fresh"), F.array_sort(F.collect_list(F.struct("n_index", "n_id", "n_text"))).alias("n"))
    b = b.where("fresh")
    return b.select("q_id", "pos", "chunk_id", "doc_id", "filename", "page", F.col("n.n_id").alias("neighbours"), text.context_block(F.col("filename"), F.col("page"), F.array_join(F.col("n.n_text"), "\n")).alias("block"))


def citations(given: DataFrame, chunks: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``(q_id, doc_id, filename, pages, page, figures, has_original, cited)``: sources by document, in the order they were first cited."""
    meta = chunks.select("chunk_id", "chunk_index", "chunk_type")
    g = given.select("q_id", "pos", "chunk_id", "doc_id", "filename", "page").join(meta, "chunk_id")
    fig = F.when(F.col("chunk_type") == "image", F.struct("page", text.figure_number(F.col("chunk_index")).alias("idx")))
    c = g.groupBy("q_id", "doc_id").agg(F.first("filename").alias("filename"), F.array_sort(F.collect_set("page")).alias("pages"), F.min("page").alias("page"), F.array_sort(F.collect_set(fig)).alias("figures"), F.min("pos").alias("first"))
    if originals is None:
        c = c.withColumn("has_original", F.lit(False))
    else:
        c = c.join(originals.select("doc_id").distinct().withColumn("_o", F.lit(True)), "doc_id", "left").withColumn("has_original", F.coalesce("_o", F.lit(False))).drop("_o")
    return c.withColumn("cited", F.row_number().over(Window.partitionBy("q_id").orderBy("first"))).drop("first")


def prompts(given: DataFrame, questions: DataFrame) -> DataFrame:
    """``(q_id, files, prompt)``: the blocks in their order behind an instruction to stay with them."""
    g = given.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pos", "filename", "block"))).alias("b"))
    files = F.array_distinct(F.col("b.filename"))
    system = F.concat(F.lit("Answer from the excerpts only. If they don't hold the answer, reply: " + text.NOT_FOUND + "\nFiles: "), F.array_join(files, ", "), F.lit("\n\n"), F.array_join(F.col("b.block"), "\n\n---\n\n"), F.lit("\n\nQuestion: "), F.col("text"))
    return g.join(questions.select("q_id", "text"), "q_id").select("q_id", files.alias("files"), system.alias("prompt"))


def augmented(questions: DataFrame, conversation: DataFrame) -> DataFrame:
    """Questions with the last user turn of their conversation before them, unless it is the same. ``conversation(q_id, turn, role, text)``"""
    last = conversation.where("role = 'user' and text is not null and text <> ''").groupBy("q_id").agg(F.max_by("text", "turn").alias("last"))
    return questions.join(last, "q_id", "left").withColumn("text", F.when(F.col("last").isNull() | (F.col("last") == F.col("text")), F.col("text")).otherwise(F.concat_ws(" ", "last", "text"))).drop("last")


def variants(questions: DataFrame, expand=None, most: int = 3) -> DataFrame:
    """``(q_id, variant, text)``: the question and at most ``most`` lines that ``expand(text)`` gives for it."""
    extra = F.array().cast("array<string>") if expand is None else F.slice(F.filter(F.transform(F.split(expand(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return questions.select("q_id", F.posexplode(F.concat(F.array("text"), extra)).alias("variant", "text"))


# -- the whole ----------------------------------------------------------------
def stages(questions: DataFrame, chunks: DataFrame, index, vectors: DataFrame, *, k: int = 15, dim: int = 64, reranker=None, originals: DataFrame | None = None, conversation: DataFrame | None = None, embed=None, until: str = "prompts") -> dict[str, DataFrame]:
    """The stages from candidates to prompts for all questions, as far as ``until`` (rrf, floors, boosted, top, context or all).

    Only what ``until`` needs is worked out: ``floors`` comes without the ranked lists.

    ``questions(q_id, text, vec, self_id [, folder_filter])``, ``chunks`` as stored,
    ``vectors(chunk_id, vec [, folder])``. With a ``folder_filter`` every list, floor and
    context chunk is of that folder. Questions about the catalogue get the catalogue's
    context instead of ranked chunks, unless it is empty. ``conversation`` puts the user's
    turn before in front of what keywords are sought for. ``embed(text)`` gives questions
    without ``vec`` theirs, and comparisons a second, dense list. ``index`` may be a function that
    gives it: it isn't called where no question is left for keywords.
    """
    from . import bm25, corpus, dense

    filtered = "folder_filter" in questions.columns
    if not filtered:
        questions = questions.withColumn("folder_filter", F.lit(None).cast("string"))
    if conversation is not None:
        questions = augmented(questions, conversation)
    if embed is not None and "vec" not in questions.columns:
        questions = materialize(questions.withColumn("vec", embed(F.col("text"))), "embedded")
    if "self_id" not in questions.columns:
        questions = questions.withColumn("self_id", F.lit(""))
    questions_text = questions.select("q_id", "text")
    # Catalogue questions leave the ranked lists if there is anything to show for them.
    about = questions.where(text.is_catalog_question(F.col("text")))
    listed = corpus.catalog_context(about, chunks)
    if about.isEmpty():
        listed = listed.sparkSession.createDataFrame([], listed.schema)
    else:
        listed = materialize(listed, "catalog")
        questions = questions.join(listed.select("q_id").distinct(), "q_id", "left_anti")

    def unsearched() -> dict[str, DataFrame]:
        """Nothing is left to rank: the catalogue is all there is."""
        spark, q_id = questions.sparkSession, f"q_id {questions.schema['q_id'].dataType.simpleString()}"
        none = lambda rest: spark.createDataFrame([], f"{q_id}, {rest}")
        scored = none("chunk_id string, score double, origin string")
        out = {"dense": none("chunk_id string, distance double, sem_rank int"), "named": none("filename string"), "lexical": none("chunk_id string, bm25 double, bm25_rank int"), "rrf": scored.drop("origin"), "catalog": listed, "floors": none("chunk_id string, floor double, origin string"), "boosted": scored, "reranked": scored}
        asked = listed.select("q_id").distinct().join(questions_text, "q_id")
        return out | {"top": none("chunk_id string, score double, pos int"), "context": none("chunk_id string, pos int, origin string"), "blocks": listed, "citations": citations(listed, chunks, originals), "prompts": prompts(listed, asked)}

    if questions.isEmpty():
        return unsearched()
    # Stages that several later ones read are written once; each has a bounded number of rows a question.
    sem = materialize(dense.top_k(questions if filtered else questions.drop("folder_filter"), vectors, k=k, dim=dim), "dense")
    # A question that names a document is open, so no name is left out later.
    named = materialize(named_documents(questions, chunks), "named")
    q = questions.join(open_questions(sem, named), "q_id", "left_semi")
    q = materialize(q.select("q_id", "text", "folder_filter").withColumn("for_value", text.is_value_question(F.col("text"))), "questions")
    if q.isEmpty():
        return unsearched() | {"dense": sem}
    if callable(index):
        index = index()
    # All keyword lists come from one pass over the index.
    no_file, ask = F.lit(None).cast("string"), ["q_id", "text", "filename", "k", "folder_filter"]
    lists = {}
    if until != "floors":
        lists["main"] = q.select("q_id", "text", no_file.alias("filename"), F.lit(2 * k).alias("k"), "folder_filter")
    if until != "rrf":
        digest = q.where(text.is_comparison(F.col("text"))).select("q_id", F.concat(F.lit("domain performance digest top performer "), "text").alias("text"), "folder_filter")
        lists["named"] = slots_of_named(named).where("filename is not null").join(q.select("q_id", "text", "folder_filter"), "q_id").withColumn("k", F.col("slots")).select(*ask)
        lists["subsystem"] = _subsystems(q).select(F.col("n_id").alias("q_id"), "text", no_file.alias("filename"), F.lit(1).alias("k"), "folder_filter")
        lists["comparison"] = digest.select("q_id", "text", no_file.alias("filename"), F.lit(k).alias("k"), "folder_filter")
    found = materialize(bm25.search_lists(index, reduce(DataFrame.unionByName, [x.withColumn("list", F.lit(name)) for name, x in lists.items()])), "scores")
    listing = lambda name: found.where(F.col("list") == name).drop("list")
    out = {"dense": sem, "named": named, "catalog": listed}
    if until != "floors":
        every = listing("main")
        best = every.join(q.select("q_id", "for_value"), "q_id")
        lexical = best.where(F.col("bm25_rank") <= F.when(F.col("for_value"), 2 * k).otherwise(k)).select("q_id", "chunk_id", "bm25", "bm25_rank")
        # Keyword hits that the dense list lacks stand behind it, in their own order.
        near = sem.join(q.select("q_id"), "q_id", "left_semi").select("q_id", "chunk_id", "sem_rank", F.lit(None).cast("int").alias("bm25_rank"))
        only = lexical.join(near.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti").select("q_id", "chunk_id", F.lit(None).cast("int").alias("sem_rank"), "bm25_rank")
        place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.asc_nulls_last("sem_rank"), "bm25_rank"))
        lists = near.unionByName(only).select("q_id", "chunk_id", place.alias("rank"), F.lit(False).alias("lexical"))
        lists = lists.unionByName(lexical.select("q_id", "chunk_id", F.col("bm25_rank").alias("rank"), F.lit(True).alias("lexical"))).join(q.select("q_id", "for_value"), "q_id")
        scores = rrf(lists, weight=F.when(F.col("lexical") & F.col("for_value"), 2.0).otherwise(1.0))
        out |= {"lexical": lexical, "rrf": scores}
    if until == "rrf":
        return out
    floors = inject_named(listing("named"), named, chunks, q).unionByName(inject_subsystems(q, chunks, lambda n: listing("subsystem")))
    framed = listing("comparison").select("q_id", "chunk_id", F.col("bm25_rank").alias("rank"))
    if embed is not None:
        asked = digest.select("q_id", embed(F.col("text")).alias("vec"), F.lit("").alias("self_id"), "folder_filter")
        asked = materialize(asked, "framed")
        framed = framed.unionByName(dense.top_k(asked if filtered else asked.drop("folder_filter"), vectors, k=k, dim=dim).select("q_id", "chunk_id", F.col("sem_rank").alias("rank")))
    floors = floors.unionByName(inject_comparison(framed))
    # Without folders there is nothing to keep out.
    out["floors"] = floors = bm25.in_folder(floors, q, chunks) if filtered else floors
    if until == "floors":
        return out
    boosted = materialize(boost(raise_scores(scores, floors), chunks, q), "boosted")
    ordered = rerank(boosted, chunks, q, reranker)
    out |= {"boosted": boosted, "reranked": ordered}
    if until == "boosted":
        return out
    out["top"] = top = materialize(diverse(ordered, chunks, named), "top")
    if until == "top":
        return out
    whole = with_tables(with_summaries(top, chunks), chunks)
    whole = materialize(bm25.in_folder(whole, q, chunks) if filtered else whole, "context")
    out["context"] = whole
    if until == "context":
        return out
    given = blocks(whole, chunks).unionByName(listed)
    asked = q.select("q_id", "text").unionByName(listed.select("q_id").distinct().join(questions_text, "q_id"))
    return out | {"blocks": given, "citations": citations(given, chunks, originals), "prompts": prompts(given, asked)}


def retrieve(questions: DataFrame, chunks: DataFrame, index, vectors: DataFrame, **kw) -> DataFrame:
    """Context blocks of every question that is answered at all."""
    return stages(questions, chunks, index, vectors, **kw)["blocks"]
