"""The stored corpus as tables: listings, upserts, deletes, moves.

A table is replaced as a whole or by partition through Spark's commit protocol; every
change is a DataFrame first, so it can be looked at before it is written. Storage keeps
nulls; defaults (folder ``General``, number ``—``) are put in by the listings only.

Defined results: of repeated rows with one id the last delivered counts (``upsert``), or
any (listings); a null ``chunk_type`` is not an image; deleting what isn't there changes
nothing; empty tables give empty listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


# -- reads ----------------------------------------------------------------------
def count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with the ids in ``ids(chunk_id)``; missing ids are simply absent."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def of_document(chunks: DataFrame, doc_id: str, folder: str | None = None) -> DataFrame:
    d = chunks.where(F.col("doc_id") == doc_id)
    return d if folder is None else d.where(F.col("folder") == folder)


def documents(chunks: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``(doc_id, filename, folder, doc_number, revision, chunks, has_original)``: each document by its head row (the summary, or else the first chunk) and its number of chunks."""
    fields = ["filename", "folder", "doc_number", "revision"]
    head = F.min_by(F.struct(*fields), F.struct("page", "chunk_index", "chunk_id"))
    heads = chunks.where("chunk_index in (-1, 0)").groupBy("doc_id").agg(head.alias("h"))
    d = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(heads, "doc_id")
    d = d.select("doc_id", "h.filename", F.coalesce("h.folder", F.lit("General")).alias("folder"), F.coalesce("h.doc_number", F.lit("—")).alias("doc_number"), F.coalesce("h.revision", F.lit("—")).alias("revision"), "chunks")
    if originals is None:
        return d.withColumn("has_original", F.lit(False))
    o = originals.select("doc_id").where("doc_id is not null").distinct().withColumn("_o", F.lit(True))
    return d.join(o, "doc_id", "left").withColumn("has_original", F.coalesce("_o", F.lit(False))).drop("_o")


def folders(chunks: DataFrame) -> DataFrame:
    """Distinct folders, empty ones left out, sorted."""
    return chunks.where("folder is not null and folder <> ''").select("folder").distinct().orderBy("folder")


def catalog(listing: DataFrame, folder: str | None = None) -> DataFrame:
    """``(pos, row)``: the listing as rows of a markdown table, by file name."""
    d = listing if folder is None else listing.where(F.col("folder") == folder)
    row = F.concat(F.lit("| "), F.col("filename"), F.lit(" | "), F.coalesce("doc_number", F.lit("—")), F.lit(" | "), F.coalesce("revision", F.lit("—")), F.lit(" |"))
    return d.select("doc_id", F.lower("filename").alias("sort_key"), row.alias("row")).orderBy("sort_key", "doc_id")


def front_matter(chunks: DataFrame, *, most: int = 3, otherwise: int = 2) -> DataFrame:
    """The first ``most`` text chunks of page 1 of each document; where it has none, the first ``otherwise`` other chunks with text."""
    from pyspark.sql import Window

    c = chunks.where("page = 1 and coalesce(chunk_type, '') <> 'image' and trim(coalesce(content, '')) <> ''").withColumn("body", F.col("chunk_index") >= 0)
    w = Window.partitionBy("doc_id", "body").orderBy("chunk_index", "chunk_id")
    c = c.withColumn("r", F.row_number().over(w)).withColumn("any_body", F.max("body").over(Window.partitionBy("doc_id")))
    keep = F.when(F.col("any_body"), F.col("body") & (F.col("r") <= most)).otherwise(F.col("r") <= otherwise)
    return c.where(keep).select("doc_id", "chunk_id", "r")


def catalog_context(questions: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """``(q_id, pos, chunk_id, doc_id, filename, page, neighbours, block)``: for questions about the catalogue the front matter of the first ``most`` documents (of the question's folder), by file name.

    ``questions(q_id, folder_filter)``. The number of documents is what a reader can take in.
    """
    from pyspark.sql import Window

    docs = chunks.where("chunk_index in (-1, 0)").groupBy("doc_id").agg(F.min_by(F.struct("filename", "folder"), F.struct("page", "chunk_index", "chunk_id")).alias("h"))
    docs = docs.select("doc_id", "h.filename", F.coalesce("h.folder", F.lit("General")).alias("folder"), F.lower("h.filename").alias("k"))
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("k", "doc_id"))).where(F.col("r") <= most)
    # The first of all documents are among the first of their folders.
    whole = first.orderBy("k", "doc_id").limit(most).select("doc_id", F.lit(None).cast("string").alias("want"), F.row_number().over(Window.orderBy("k", "doc_id")).alias("r"))
    listed = first.select("doc_id", F.col("folder").alias("want"), "r").unionByName(whole)
    q = questions.select("q_id", F.col("folder_filter").alias("want"))
    # Only the documents to be shown are looked into.
    shown = chunks.where("page = 1").join(listed.select("doc_id").distinct(), "doc_id", "left_semi")
    front = front_matter(shown).withColumnRenamed("r", "n").drop("doc_id").join(shown.select("chunk_id", "doc_id", "filename", "page", "content"), "chunk_id")
    rows = q.join(listed, q.want.eqNullSafe(listed.want)).select("q_id", "doc_id", "r").join(front, "doc_id")
    pos = F.row_number().over(Window.partitionBy("q_id").orderBy("r", "n"))
    return rows.select("q_id", pos.alias("pos"), "chunk_id", "doc_id", "filename", "page", F.array("chunk_id").alias("neighbours"), text.context_block(F.col("filename"), F.col("page"), F.col("content")).alias("block"))


# -- changes ----------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def without_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def without_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")


def without_text_of(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents' chunks except images go (they are written anew); images stay."""
    gone = docs.select("doc_id").where("doc_id is not null").distinct().withColumn("_gone", F.lit(True))
    j = chunks.join(gone, "doc_id", "left")
    return j.where(F.col("_gone").isNull() | (F.col("chunk_type").eqNullSafe("image"))).select(*chunks.columns)


def moved(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Chunks with new folders by ``moves(doc_id, folder)``."""
    m = moves.select("doc_id", text.clean_folder(F.col("folder")).alias("_to")).dropDuplicates(["doc_id"])
    return chunks.join(m, "doc_id", "left").withColumn("folder", F.coalesce("_to", "folder")).select(*chunks.columns)


def deleted_counts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, deleted)``: how many chunks go with each document, 0 for unknown ones."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").where("doc_id is not null").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("deleted"))


#: Fixed value: what stands for a figure's text until it is read.
PENDING = "(uncaptioned figure — pending vision pass)"


def figures(images: DataFrame, heads: DataFrame) -> DataFrame:
    """Chunks of images ``(doc_id, page, chunk_index, caption, caption_status)`` of the documents in ``heads(doc_id, title, filename, folder)``."""
    h = heads.select("doc_id", "title", "filename", "folder").dropDuplicates(["doc_id"])
    said = F.concat(F.lit("["), F.col("title"), F.lit("] [Figure on page "), F.col("page").cast("string"), F.lit("]: "), F.coalesce("caption", F.lit(PENDING)))
    j = images.select("doc_id", "page", "chunk_index", "caption", "caption_status").join(h, "doc_id")
    return j.select(text.chunk_id(F.col("doc_id"), F.col("page"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "filename", "folder", "page", "chunk_index", F.lit("image").alias("chunk_type"), "caption_status", said.alias("content"))


def still_there(late: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of documents that the corpus still has: what was deleted while its figures were read stays deleted."""
    return late.join(chunks.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").select(*late.columns)


class Corpus:
    """Chunks stored as parquet, partitioned by a bucket of the document, so a document's rewrite touches one bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def create(self, chunks: DataFrame) -> None:
        self._bucketed(chunks).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def _rewrite(self, result: DataFrame, touched: DataFrame) -> None:
        """Write the buckets of ``touched(doc_id)`` anew."""
        from ..runtime import materialize

        hit = self._bucketed(touched.select("doc_id").distinct()).select("bucket").distinct()
        todo = self._bucketed(result).join(hit, "bucket", "left_semi")
        # The rows come from the files that are replaced, so they are put aside first.
        todo = materialize(todo, "rewrite")
        emptied = [r.bucket for r in hit.join(todo.select("bucket").distinct(), "bucket", "left_anti").collect()]
        todo.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in emptied:  # at most ``buckets``
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}"), True)

    def write_documents(self, new: DataFrame) -> None:
        """Chunks of whole documents in place of their old text; images stay."""
        old = self.chunks()
        self._rewrite(upsert(without_text_of(old, new), new), new)

    def append_new(self, new: DataFrame) -> None:
        """Append the chunks of documents that aren't there yet; of what is there only their buckets are read."""
        new = self._bucketed(new)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
            there = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).select("doc_id").distinct()
            new = new.join(there, "doc_id", "left_anti")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def add_late(self, late: DataFrame) -> None:
        """Put chunks of documents that are still there in place of those of the same ids; buckets of other documents stay as they are."""
        from ..runtime import materialize

        late = materialize(still_there(late, self.chunks()), "late").dropDuplicates(["chunk_id"])
        self._rewrite(upsert(self.chunks(), late), late)

    def clear(self) -> int:
        """Take everything out; how many chunks there were. A corpus that isn't there has none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return 0
        n = self.chunks().count()
        fs.delete(p, True)
        return n

    def delete_documents(self, docs: DataFrame) -> None:
        self._rewrite(without_documents(self.chunks(), docs), docs)

    def move(self, moves: DataFrame) -> None:
        self._rewrite(moved(self.chunks(), moves), moves)
