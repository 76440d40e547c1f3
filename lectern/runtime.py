"""Where intermediate results live, and helpers that every operator shares.

A result that is read more than once is written as a table into the folder that
``spark.checkpoint.dir`` names, which all executors share, so a lost executor costs a
read, not the lineage. Only where a local session has no such setting (tests, a laptop)
is a folder of our own set; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lectern/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a cut of the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that occur more than once are sent to the executors up to this number.
REPEATED = 50_000


def once(df: DataFrame, key: str, choose=lambda rows: rows) -> DataFrame:
    """One row for each value of ``key``: keys are shuffled, and the rows of those that occur more than once (all rows if these are too many to send).

    Where a key has several rows, it is one of those that ``choose`` leaves, if any.
    """
    twice = materialize(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_twice")), "repeated")
    n = twice.count()
    if n > REPEATED:
        return choose(df).dropDuplicates([key])
    same, sent = F.col(key).eqNullSafe(F.col("_twice")), F.broadcast(twice)  # at most REPEATED keys
    return df.join(sent, same, "left_anti").unionByName(choose(df.join(sent, same, "left_semi")).dropDuplicates([key])) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_state(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A name for the present state of a table: its path, and the names, sizes and times of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(fs.resolvePath(path))] + sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(path))
    return hashlib.md5("\n".join(found).encode()).hexdigest()[:16]


def body_without_title(content):
    """Chunk text after its leading ``[title] ``."""
    return F.regexp_replace(content, r"^\[[^\]\n]*\] ", "")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lectern-')}/lectern", "zip", root.parent, root.name)
        sc.addPyFile(name)
        sc._lectern_shipped = sc.applicationId


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; one that isn't there is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote for this session's shared folder; results that still read them fail afterwards."""
    drop_path(spark, f"{shared_dir(spark)}/lectern")
