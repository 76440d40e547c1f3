"""The manifest of ingested files: what is new, what to record.

Two records are of the same state of a file if path and size are equal and the times
differ by at most ``TOLERANCE`` seconds. Errors count as known, so a broken file is not
tried again until it changes.

Defined results: rows without a path are ignored; a null size or time is equal to none;
of several records of a path the last scanned counts; an empty manifest knows nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-3


def latest(manifest: DataFrame) -> DataFrame:
    """One row for each path: the one scanned last (equal times: larger size, then time of change)."""
    w = Window.partitionBy("relpath").orderBy(F.desc("scanned_at"), F.desc("size"), F.desc("mtime"), F.desc("doc_id"), F.desc("status"))
    return manifest.where("relpath is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _known(files: DataFrame, manifest: DataFrame) -> DataFrame:
    m = latest(manifest).select(F.col("relpath").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    return files.where("relpath is not null").join(m, (F.col("relpath") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) <= TOLERANCE), "left")


def new_files(files: DataFrame, manifest: DataFrame, *, again: bool = False) -> DataFrame:
    """Files of a scan that the manifest doesn't know in their present state; all of them with ``again``."""
    if again:
        return files.where("relpath is not null")
    return _known(files, manifest).where("_p is null").select(*files.columns)


def preview(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: new and unchanged files, and the bytes of the new ones."""
    k = _known(files, manifest)
    new = F.col("_p").isNull()
    return k.agg(F.count_if(new).alias("new_files"), F.count_if(~new).alias("unchanged"), F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("total_bytes"))


def record(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with ``rows`` in place of those of the same paths."""
    return manifest.join(rows.select("relpath").distinct(), "relpath", "left_anti").unionByName(latest(rows))


def forget(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select("relpath").distinct(), "relpath", "left_anti")


def results_with_files(results: DataFrame, files: DataFrame) -> DataFrame:
    """Batch results joined back to the files they came from, by path."""
    return results.join(files.select("relpath", "size", "mtime"), "relpath")


def capped_errors(errors: DataFrame, most: int = 200, *, order: str = "relpath", message: str = "message") -> DataFrame:
    """``(pos, message)``: the first ``most`` errors and one line that counts the rest (the cap is a report's length)."""
    n = errors.agg(F.count("*").alias("n"))
    first = errors.orderBy(order, message).limit(most).select(F.row_number().over(Window.orderBy(order, message)).alias("pos"), F.col(message).alias("message"))
    rest = n.where(F.col("n") > most).select(F.lit(most + 1).alias("pos"), F.format_string("... and %d more errors", F.col("n") - most).alias("message"))
    return first.unionByName(rest)
