"""Keyword index as tables, and BM25 top-k for whole batches of questions.

The index is a row for each chunk, ``forward(chunk_id, folder, filename, dl, terms, tfs)``;
``postings(term, chunk_id, tf, dl)``, ``doclen(chunk_id, folder, dl)`` and ``terms(term, n,
idf)`` are plain DataFrames too. ``search`` gives the best chunks of each text: the texts go to
the index, block by block (``bm25_blocks``), so neither postings nor pairs of texts and chunks
are shuffled. ``score`` gives all pairs. Each version of a stored index
is a folder of its own: a pointer, set last, names the one to read. A term's inverse frequency that would be
negative is a quarter of the mean one.

Defined results: null texts have no tokens; a question without tokens finds nothing;
equal scores are ranked by chunk id; repeated chunk ids are one chunk.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem, text
from ..runtime import materialize
from . import bm25_blocks

K1, B, EPSILON = 1.5, 0.75, 0.25
#: A stored index of another version is built anew.
VERSION = 3
FORWARD = "chunk_id string, folder string, filename string, dl int, terms array<string>, tfs array<int>"


@dataclass
class Index:
    forward: DataFrame
    stemmed: bool = False
    #: ``terms()`` as stored; a changed index has none and works it out.
    known: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.forward.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("p.terms", "chunk_id", "p.tfs", "dl").toDF("term", "chunk_id", "tf", "dl")

    @property
    def doclen(self) -> DataFrame:
        return self.forward.select("chunk_id", "folder", "dl")

    def statistics(self) -> DataFrame:
        """One row: number of chunks and their mean length."""
        return self.doclen.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def terms(self) -> DataFrame:
        """``(term, n, idf)`` of every term of the index."""
        if self.known is not None:
            return self.known
        df = self.forward.select("terms").mapInArrow(bm25_blocks.frequencies, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        size = self.doclen.agg(F.count("*").alias("n_docs"))
        raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))  # one row
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        return raw.crossJoin(F.broadcast(mean)).select("term", "n", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))  # one row


def _terms_of(df: DataFrame, keys: list[str], tokens: Column, use_stem: bool) -> DataFrame:
    t = df.select(*keys, F.explode(tokens).alias("token"))
    if not use_stem:
        return t.withColumnRenamed("token", "term")
    counted = t.groupBy(*keys, "token").agg(F.count("*").alias("c"))
    stems = counted.select("token").distinct().withColumn("term", stem.stemmed(F.col("token")))
    return counted.join(stems, "token").select(*keys, "term", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("_i")).drop("_i")


def build(chunks: DataFrame, *, use_stem: bool = True, unique: bool = False) -> Index:
    """The index of ``chunks(chunk_id, filename, folder, content)``; the file name is part of a chunk's text. With ``unique`` no id repeats, so nothing is shuffled for that."""
    src = chunks.where("chunk_id is not null")
    src = (src if unique else src.dropDuplicates(["chunk_id"])).select("chunk_id", "folder", "filename", F.concat(F.lit("["), F.coalesce("filename", F.lit("")), F.lit("] "), F.coalesce("content", F.lit(""))).alias("t"))
    src = src.select("chunk_id", "folder", "filename", text.tokens(F.col("t")).alias("tokens")).withColumn("dl", F.size("tokens"))
    if not use_stem:
        return Index(src.mapInArrow(bm25_blocks.counted, FORWARD), use_stem)
    tf = _terms_of(src, ["chunk_id"], F.col("tokens"), use_stem).groupBy("chunk_id", "term").agg(F.count("*").cast("int").alias("tf"))
    p = tf.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("p"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return Index(src.join(p, "chunk_id", "left").select("chunk_id", "folder", "filename", "dl", none(F.col("p.term"), "string").alias("terms"), none(F.col("p.tf"), "int").alias("tfs")), use_stem)


#: Question terms (with their question) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: So many texts go through the index at a time.
ASKS = 100_000
#: In an index of more chunks than ``SEEDED`` one chunk of ``SEEDS`` is searched first, ``SEED_BLOCK`` of them together, for what the best of all reach at least.
SEEDED, SEEDS, SEED_BLOCK = 50_000, 16, 16_384
ASKED = "ask bigint, chunk_id string, bm25 double"


def search(index: Index, questions: DataFrame, k: int = 15) -> DataFrame:
    """``(q_id, chunk_id, bm25, bm25_rank)``: the best ``k`` chunks with a positive score for each of ``questions(q_id, text [, folder_filter])``, of the question's folder if it has one."""
    return _search(index, questions.withColumn("filename", F.lit(None).cast("string")).withColumn("k", F.lit(k)), ["q_id"])


def search_files(index: Index, questions: DataFrame) -> DataFrame:
    """``(q_id, filename, chunk_id, bm25, bm25_rank)``: of the chunks of a file the best ``k``, those without a common term too, for each of ``questions(q_id, text, filename, k [, folder_filter])``."""
    return _search(index, questions.where("filename is not null"), ["q_id", "filename"])


def search_lists(index: Index, questions: DataFrame) -> DataFrame:
    """``(list, q_id, filename, chunk_id, bm25, bm25_rank)``: several lists in one pass over the index, for ``questions(list, q_id, text, filename, k, folder_filter)``: as ``search_files`` where there is a file name, else as ``search``."""
    return _search(index, questions, ["list", "q_id", "filename"])


def _blocks(rows: DataFrame, forward: DataFrame, avgdl: float) -> DataFrame:
    """The best of each block for the asks in ``rows``, which are sent to the executors."""
    sent = rows.sparkSession.sparkContext.broadcast(bm25_blocks.asked(rows.toArrow()))
    return forward.mapInArrow(bm25_blocks.search(sent, avgdl, K1, B), ASKED)


def _search(index: Index, questions: DataFrame, keys: list[str]) -> DataFrame:
    if "folder_filter" not in questions.columns:
        questions = questions.withColumn("folder_filter", F.lit(None).cast("string"))
    spark, same = questions.sparkSession, ["text", "folder_filter", "filename", "k"]
    questions = materialize(questions.select(F.col("q_id").cast("bigint").alias("q_id"), *[c for c in keys if c not in ("q_id", *same)], *same), "searched")
    # Texts that are alike are asked once.
    asks = materialize(questions.groupBy(*same).agg(F.count("*").alias("times")).withColumn("ask", F.monotonically_increasing_id()), "asks")
    many = -(-asks.count() // ASKS)
    if not many:
        return spark.createDataFrame([], ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in keys) + ", chunk_id string, bm25 double, bm25_rank int")
    qtf = _terms_of(asks, ["ask"], text.tokens(F.col("text")), index.stemmed).groupBy("ask", "term").agg(F.count("*").alias("qtf"))
    weighed = qtf.join(index.terms().select("term", "idf"), "term").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight")))).alias("terms"))
    none = F.array().cast("array<struct<term:string,weight:double>>")
    rows = asks.join(weighed, "ask", "left").select("ask", F.col("k").cast("int").alias("k"), "folder_filter", "filename", F.coalesce("terms", none).alias("terms"))
    rows = materialize(rows, "asks")
    # One row.
    size = index.doclen.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    found = spark.createDataFrame([], ASKED)
    if size.n:
        cores, avgdl = spark.sparkContext.defaultParallelism, float(size.avgdl or 1) or 1.0
        over = index.forward.select("chunk_id", "folder", "filename", "dl", "terms", "tfs")
        for part in range(many):
            q = rows.where(F.pmod(F.xxhash64("ask"), F.lit(many)) == part).withColumn("least", F.lit(0.0))
            if size.n > SEEDED and keys != ["q_id", "filename"]:
                # The k-th best of some chunks: the k-th best of all is no worse, so most blocks have little to look at.
                some = _blocks(q.where("filename is null"), over.where(F.pmod(F.xxhash64("chunk_id"), F.lit(SEEDS)) == 0).coalesce(min(cores, -(-size.n // (SEEDS * SEED_BLOCK)))), avgdl)
                kth = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("bm25")))
                seeds = some.select("ask", "bm25").withColumn("r", kth).join(rows.select("ask", "k"), "ask").where("r = k").select("ask", F.col("bm25").alias("seed"))
                q = q.join(seeds, "ask", "left").withColumn("least", F.greatest(F.lit(0.0), F.coalesce("seed", F.lit(0.0))))
            # Every ask costs something in every block, so there are no more than the cores or the size of a block need.
            found = found.unionByName(_blocks(q, over.coalesce(max(cores, -(-size.n // bm25_blocks.BLOCK))), avgdl))
    r = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc(F.round("bm25", 9)), "chunk_id"))
    top = found.join(asks, "ask").withColumn("bm25_rank", r).where(F.col("bm25_rank") <= F.col("k"))
    top = top.where("filename is not null or bm25 > 0")
    alike = F.lit(True)
    t, a = questions.alias("t"), top.alias("a")
    for c in same:
        alike = alike & F.col(f"t.{c}").eqNullSafe(F.col(f"a.{c}"))
    return t.join(a, alike).select(*[F.col(f"t.{c}") for c in keys], "a.chunk_id", "a.bm25", "a.bm25_rank")


def score(index: Index, questions: DataFrame) -> DataFrame:
    """``(q_id, chunk_id, bm25)`` of all chunks that share a term with the question; a term counts as often as the question has it.

    What a posting gives doesn't depend on the question, so it is worked out beside it.
    ``questions`` may hold ``folder_filter``: then only chunks of that folder count.
    """
    q = _terms_of(questions, ["q_id"], text.tokens(F.col("text")), index.stemmed).groupBy("q_id", "term").agg(F.count("*").alias("qtf"))
    few = q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = q.join(index.terms().select("term", "idf"), "term").select("q_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    # A semi-join first, as most terms are in no question.
    p = index.postings.join(F.broadcast(q.select("term").distinct()) if few else q.select("term").distinct(), "term", "left_semi")
    p = p.crossJoin(F.broadcast(index.statistics()))  # one row
    p = p.select("term", "chunk_id", (tf * (K1 + 1) / (tf + norm)).alias("part"))
    hit = p.join(F.broadcast(wanted) if few else wanted, "term")
    scored = hit.groupBy("q_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("part")).alias("bm25"))
    return scored if "folder_filter" not in questions.columns else in_folder(scored, questions, index.doclen)


def in_folder(rows: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows ``(q_id, chunk_id, ...)`` whose chunk lies in the question's folder, all rows of questions without one."""
    r = rows.join(questions.select("q_id", F.col("folder_filter").alias("_want")), "q_id").join(chunks.select("chunk_id", F.col("folder").alias("_has")), "chunk_id")
    return r.where(F.col("_want").isNull() | (F.col("_want") == F.col("_has"))).select(*rows.columns)


def top_k(scores: DataFrame, k: int | Column = 15, *, most: int = 30, questions: DataFrame | None = None) -> DataFrame:
    """Positive scores ranked within the question: at most ``k`` (a number or a column of ``questions``) and never more than ``most``."""
    s = scores.where("bm25 > 0")
    if questions is not None:
        s = s.join(questions.drop("text"), "q_id")
    r = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id"))
    # The constant bound lets Spark prune ranks before the shuffle; the other may differ by question.
    return s.withColumn("bm25_rank", r).where(F.col("bm25_rank") <= most).where(F.col("bm25_rank") <= k).select("q_id", "chunk_id", "bm25", "bm25_rank")


def add(index: Index, chunks: DataFrame) -> Index:
    """The index with ``chunks`` added, in place of chunks of the same ids."""
    new = build(chunks, use_stem=index.stemmed)
    return Index(index.forward.join(new.forward.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.forward), index.stemmed)


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without the chunks in ``ids(chunk_id)``."""
    return Index(index.forward.join(ids.select("chunk_id"), "chunk_id", "left_anti"), index.stemmed)


def remove_document(index: Index, doc_id: str) -> Index:
    return Index(index.forward.where(~F.col("chunk_id").startswith(doc_id + "_")), index.stemmed)


def move(index: Index, updates: DataFrame) -> Index:
    """New folders by ``updates(chunk_id, folder)``."""
    d = index.forward.join(updates.select("chunk_id", F.col("folder").alias("_to")), "chunk_id", "left")
    return Index(d.withColumn("folder", F.coalesce("_to", "folder")).select(*index.forward.columns), index.stemmed, index.known)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(index: Index, path: str) -> None:
    """Write the index into a folder of its own below ``path``, then set the pointer to it and delete the version before.

    Whoever reads meanwhile finds the old index or the new one, never half of one.
    """
    spark = index.forward.sparkSession
    name = f"v{VERSION}-{uuid.uuid4().hex[:12]}"
    index.forward.write.parquet(f"{path}/{name}/forward")
    Index(_forward(spark, f"{path}/{name}")).terms().write.parquet(f"{path}/{name}/terms")
    spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(index.stemmed).alias("stemmed"), F.lit(name).alias("name")).coalesce(1).write.parquet(f"{path}/{name}/meta")
    # Names of versions that are whole; the largest number is the current one.
    number = 1 + max([n for n, _ in _versions(spark, path)], default=0)
    target, fs = _file(spark, f"{path}/current/{number:012d}-{name}")
    fs.mkdirs(target)
    for gone in _versions(spark, path):
        if gone[1] != name:
            for sub in (f"current/{gone[0]:012d}-{gone[1]}", gone[1]):
                p, fs = _file(spark, f"{path}/{sub}")
                fs.delete(p, True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    p, fs = _file(spark, f"{path}/current")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n[:12]), n[13:]) for n in names)


def _current(spark: SparkSession, path: str) -> str | None:
    found = _versions(spark, path)
    return found[-1][1] if found else None


def _forward(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(FORWARD).parquet(f"{at}/forward")


def load(spark: SparkSession, path: str) -> Index | None:
    """The stored index, or None if there is none of this version."""
    name = _current(spark, path)
    if name is None or not name.startswith(f"v{VERSION}-"):
        return None
    at = f"{path}/{name}"
    meta = spark.read.parquet(f"{at}/meta").first()
    return Index(_forward(spark, at), meta.stemmed, spark.read.parquet(f"{at}/terms"))


def load_or_build(spark: SparkSession, path: str, chunks, *, use_stem: bool = True, unique: bool = False) -> Index:
    """The stored index, built where there is none; ``chunks`` may be a function that gives them, called only then."""
    found = load(spark, path)
    if found is None or found.stemmed != use_stem:
        save(build(chunks() if callable(chunks) else chunks, use_stem=use_stem, unique=unique), path)
        found = load(spark, path)
    return found


def clear(spark: SparkSession, path: str) -> None:
    """Delete the stored index with all its versions; none there is no error."""
    p, fs = _file(spark, path)
    fs.delete(p, True)
