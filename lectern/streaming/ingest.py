"""Directory ingest as a stream: micro-batches, a manifest, a breaker for dead mounts.

Every micro-batch extracts its files, appends the chunks of new documents and records the
files; the checkpoint and the manifest make a restart go on where it stopped. Files whose
path, size and time the manifest has are passed over before they are read, and bytes that
were seen under another name have the same document id, so they are written once. Of the
corpus a batch reads the buckets of its own documents only, and rewrites none.

Defined results: a file that can't be parsed is recorded as ``error`` and stops nothing;
one without text as ``empty``; more than ``most_errors`` unreadable files one after the
other (by path, from batch to batch) stop the stream; a batch that is replayed is done anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, corpus
from ..runtime import drop_path, materialize
from ..sources import files

FLUSH, MOST_ERRORS = 25, 10
FILES = "path string, modificationTime timestamp, length bigint, content binary"


class Unreachable(RuntimeError):
    """Too many files in a row could not be read."""


def chunks_of(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the files of a batch, and ``(path, doc_id, status, message)`` of each file."""
    f = batch.withColumn("filename", text.basename(F.col("path")))
    pages = files.extract(f)
    by_doc = f.select("path", text.content_id(F.col("content")).alias("doc_id"), "filename")
    good = pages.where("error is null and trim(text) <> ''").dropDuplicates(["doc_id", "page"])
    cut = chunking.tag_tables(chunking.split_pages(good), good)
    named = by_doc.groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("path").alias("path"))
    summary = chunking.summaries(good, named).withColumn("table_id", F.lit(None).cast("string"))
    rows = cut.unionByName(summary).join(named.drop("path"), "doc_id")
    out = rows.select(text.chunk_id(F.col("doc_id"), F.col("page"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "filename", "page", "chunk_index", "table_id", F.lit(None).cast("string").alias("chunk_type"), F.col("text").alias("content"))
    state = pages.groupBy("doc_id").agg(F.max("error").alias("message"), F.max(F.trim(F.coalesce("text", F.lit("")))).alias("_t"))
    status = F.when(F.col("message").isNotNull(), "error").when(F.coalesce("_t", F.lit("")) == "", "empty").otherwise("ok")
    return out, by_doc.join(state, "doc_id", "left").select("path", "doc_id", status.alias("status"), "message")


class Ingest:
    """A stream from a folder into a corpus and its manifest (both parquet)."""

    def __init__(self, spark: SparkSession, source: str, target: str, *, flush: int = FLUSH, most_errors: int = MOST_ERRORS):
        self.spark, self.source, self.target, self.flush, self.most_errors = spark, source, target, flush, most_errors
        self.corpus, self.failing = corpus.Corpus(spark, f"{target}/chunks"), 0

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/manifest")

    def _batch(self, batch: DataFrame, number: int) -> None:
        batch = batch.withColumnsRenamed({"length": "size", "modificationTime": "mtime"})
        if self._exists(f"{self.target}/manifest"):
            # What this batch recorded before a failure doesn't count.
            known = self.manifest().where(F.col("batch") != number).select("path", "size", "mtime").distinct()
            batch = batch.join(known, ["path", "size", "mtime"], "left_anti")
        if batch.isEmpty():
            return
        chunks, state = chunks_of(batch)
        state = materialize(state.join(batch.select("path", "size", "mtime"), "path"), "state")
        self.corpus.append_new(materialize(chunks, "batch"))
        state.write.mode("overwrite").parquet(f"{self.target}/manifest/batch={number}")
        # One word for each file of the batch, at most ``flush``.
        for r in state.select("path", "status").orderBy("path").collect():
            self.failing = self.failing + 1 if r.status == "error" else 0
            if self.failing > self.most_errors:
                raise Unreachable(f"more than {self.most_errors} unreadable files one after the other, up to batch {number}")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def start(self):
        stream = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.flush).load(self.source)
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.target}/checkpoint").trigger(availableNow=True).start()

    def late(self, images: DataFrame):
        """A second stream beside the first: image chunks that come after their documents' text, as ``corpus.figures`` makes them.

        Documents deleted meanwhile get none; a batch that is replayed writes the same chunks over.
        """
        return images.writeStream.foreachBatch(lambda batch, _: self.corpus.add_late(batch)).option("checkpointLocation", f"{self.target}/checkpoint-late").trigger(availableNow=True).start()

    def reindex(self, *, names=None, limit: int | None = None) -> int:
        """Clear corpus and manifest and take the source's files in again (those named, the first ``limit`` by path); the number of chunks."""
        self.corpus.clear()
        drop_path(self.spark, f"{self.target}/manifest")
        found = self.spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(self.source)
        take = files.to_reindex(found.select(F.col("path").alias("relpath")), names=names, limit=limit).withColumnRenamed("relpath", "path")
        batch = found.join(take, "path", "left_semi").withColumnsRenamed({"length": "size", "modificationTime": "mtime"})
        chunks, state = chunks_of(batch)
        self.corpus.create(materialize(chunks, "batch"))
        state.join(batch.select("path", "size", "mtime"), "path").write.mode("overwrite").parquet(f"{self.target}/manifest/batch=-1")
        return self.corpus.chunks().count()
