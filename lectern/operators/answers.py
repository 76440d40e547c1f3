"""How steady answers are over repeated runs, and what belongs to a conversation.

Defined results: zeros don't count in the variation, and fewer than two values (or runs
with values) vary by 0; refused runs have no values; groups without rows don't appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

REFUSAL = "not in the ingested documents"


def variation(x: Column) -> Column:
    """Coefficient of variation (population), zeros and nulls left out."""
    v = F.when(x != 0, x)
    return F.when((F.count(v) >= 2) & (F.avg(v) != 0), F.stddev_pop(v) / F.avg(v)).otherwise(0.0)


def run_statistics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Medians of ``ttft``, ``total`` and ``tok_s``, refusal rate and variation of ``total``."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.median("ttft").alias("ttft"), F.median("total").alias("total"), F.median("tok_s").alias("tok_s"),
        F.avg(F.col("refused").cast("double")).alias("refusal_rate"), variation(F.col("total")).alias("cv"),
    )


def drift(runs: DataFrame, by: list[str], run: str = "run") -> DataFrame:
    """1 - shared values / all values over the runs of a group that gave any and weren't refused. ``runs(by..., run, refused, values)``"""
    ok = runs.where(~F.col("refused") & (F.size("values") > 0))
    n = ok.groupBy(*by).agg(F.countDistinct(run).alias("n"))
    per = ok.select(*by, run, F.explode("values").alias("v")).distinct().groupBy(*by, "v").agg(F.count("*").alias("c"))
    d = per.join(n, by).groupBy(*by).agg(F.max("n").alias("n"), (1 - F.count_if(F.col("c") == F.col("n")) / F.count("*")).alias("drift"))
    return runs.select(*by).distinct().join(d, by, "left").select(*by, F.when(F.col("n") >= 2, F.col("drift")).otherwise(0.0).alias("drift"))


def last_messages(conversations: DataFrame, most: int = 6, *, by="conv_id", order=("turn",)) -> DataFrame:
    """The last messages of each conversation."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return conversations.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def newest_sessions(conversations: DataFrame, most: int = 200, *, by="conv_id", at="ts") -> DataFrame:
    """Sessions that stay when only the ``most`` newest (by first sight) are kept: a global top-k."""
    first = conversations.groupBy(by).agg(F.min(at).alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc(by)).limit(most)


def live(rows: DataFrame, now: Column, *, at: str = "created_at", seconds: int = 7200) -> DataFrame:
    """Rows begun at most ``seconds`` before ``now``; those without a time go."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def previous_user_turn(conversations: DataFrame, *, by="conv_id", order=("turn",), role="role", content="text") -> DataFrame:
    """Each message with the user message before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return conversations.withColumn("previous_user", F.last(F.when(F.col(role) == "user", F.col(content)), ignorenulls=True).over(w))


def placed(df: DataFrame, *order) -> DataFrame:
    """``df`` with its ``place`` in an order of all rows: ranges are sorted by themselves, and counts of the ranges before are added."""
    at = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    n = at.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row for each range.
    before = n.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return at.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + inside).drop("_p", "_before")


def report_rows(stats: DataFrame, name: str) -> DataFrame:
    """Markdown rows of run statistics, by total."""
    row = F.format_string("| %s | %.2f | %.2f | %.1f | %.0f%% |", F.col(name).cast("string"), F.col("ttft"), F.col("total"), F.col("tok_s"), F.col("refusal_rate") * 100)
    return stats.select(name, "total", row.alias("row")).orderBy("total", name)
