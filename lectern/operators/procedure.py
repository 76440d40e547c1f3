"""Documents as procedures of numbered steps.

A generator is asked for the steps of each document with its first chunks; a document for
which it gives no numbered line has its chunks as steps. Rows are kept long, so a document
of any length is no row of its own: its chunks are numbered page by page.

Defined results: blank and null chunks are no steps; image and summary chunks are left out;
repeated chunk ids count once; documents without text chunks have no steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import materialize

SHOWN = 20
ASK = "List the steps of this procedure as numbered lines, one for each step.\n\nDocument content:\n\n"


def in_order(chunks: DataFrame) -> DataFrame:
    """``(doc_id, page, chunk_index, chunk_id, content, n)``: text chunks numbered within their document by page and place."""
    c = chunks.where("doc_id is not null and chunk_index >= 0 and coalesce(chunk_type, '') <> 'image' and content is not null").dropDuplicates(["chunk_id"]).select("doc_id", "page", "chunk_index", "chunk_id", "content")
    # Only pages are sorted as wholes: what stands before a page is a sum of counts.
    pages = c.groupBy("doc_id", "page").agg(F.count("*").alias("m"))
    before = pages.select("doc_id", "page", (F.sum("m").over(Window.partitionBy("doc_id").orderBy("page")) - F.col("m")).alias("before"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("chunk_index", "chunk_id")))
    j = c.join(before.withColumnRenamed("doc_id", "_d").withColumnRenamed("page", "_p"), (F.col("doc_id") == F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")))
    return j.select("doc_id", "page", "chunk_index", "chunk_id", "content", (F.col("before") + F.col("r")).alias("n"))


def steps(chunks: DataFrame, write=None, *, shown: int = SHOWN) -> DataFrame:
    """``(doc_id, step, text)``, steps from 1: the numbered lines of ``write(prompt)`` about the first ``shown`` chunks, or else the chunks themselves."""
    c = materialize(in_order(chunks), "procedure")
    given = None
    if write is not None:
        # At most ``shown`` chunks of a document meet in a row.
        front = c.where(F.col("n") <= shown).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n\n").alias("t"))
        lines = front.select("doc_id", text.step_lines(write(F.concat(F.lit(ASK), F.col("t")))).alias("l"))
        given = materialize(lines.where(F.size("l") > 0), "steps")
    plain = c.where(F.trim("content") != "")
    if given is not None:
        plain = plain.join(given.select("doc_id"), "doc_id", "left_anti")
    # Blank chunks leave gaps in the numbers, so what is left is numbered anew.
    blank = c.where(F.trim("content") == "").select("doc_id", "page", "chunk_index", "chunk_id")
    if blank.isEmpty():
        out = plain.select("doc_id", F.col("n").alias("step"), F.trim("content").alias("text"))
    else:
        again = in_order(plain.withColumn("chunk_type", F.lit(None).cast("string")))
        out = again.select("doc_id", F.col("n").alias("step"), F.trim("content").alias("text"))
    if given is None:
        return out
    return given.select("doc_id", F.posexplode("l").alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("step"), "text").unionByName(out)


def go(at: Column, total: Column, *, step: Column | None = None, back: Column | None = None) -> Column:
    """The place (from 0) after a move: to ``step`` if it is given, else one back or on, never beyond the ends."""
    moved = at + F.when(F.coalesce(back, F.lit(False)) if back is not None else F.lit(False), -1).otherwise(1)
    to = moved if step is None else F.coalesce(step, moved)
    return F.greatest(F.lit(0), F.least(to, total - 1))
