"""Sources mixed to target shares of all tokens, along a time-varying curriculum.

The total is the largest at which every source that has documents can give its share
without using one more often than ``max_repeats`` times; a source without documents gives
nothing, and the others keep their proportions. A source's weight over training time u
(0 to 1) is share * (1 + a * (2 u - 1)); the a of a mix average to 0 by share, so weights
sum to 1 at any time and each integrates to its share. Small sources come later (a > 0).
The integral of the weight is the source's cumulative token demand; inverting it at a
document's place in its source's own order gives the document's training position, and
documents are range-sorted by it.

A source's own order is by the hash of the id. The running sum over a source is made in
two steps, over ``buckets`` hash buckets and inside a bucket, so no task holds a source.

Defined results: source names are compared in lower case without blanks around them; a
null or unlisted source is in no mix; null texts and texts without tokens are not drawn;
repeated ids are one document; a mix none of whose sources has documents has a report
with zeros and no rows; shares that are null or not positive count as 0; ``max_repeats``
below 1 means the source is not used; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from . import tokens


#: Up to so many listed sources are broadcast; more are joined by a shuffle.
MOST_TARGETS = 10_000


def _plan(sized: DataFrame, targets: DataFrame, tilt: float) -> DataFrame:
    """A row for each mix and source: available tokens, demand and slope. Sources are few: the targets list them."""
    name = F.lower(F.trim("source"))
    want = targets.select("mix_id", name.alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("repeats")).where("mix_id is not null and source is not null")
    want = want.groupBy("mix_id", "source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    have = sized.groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("docs"))
    p = want.join(have, "source", "left").na.fill({"available": 0, "docs": 0})
    usable = (F.col("available") > 0) & (F.col("repeats") > 0) & (F.col("share") > 0)
    mix = Window.partitionBy("mix_id")
    p = p.withColumn("w", F.when(usable, F.col("share")).otherwise(0.0)).withColumn("w", F.when(F.sum("w").over(mix) > 0, F.col("w") / F.sum("w").over(mix)).otherwise(0.0))
    p = p.withColumn("total", F.coalesce(F.min(F.when(F.col("w") > 0, F.col("available") * F.col("repeats") / F.col("w"))).over(mix), F.lit(0.0)))
    # Slopes: from -1 for the largest share to 1 for the smallest, less their mean by share, scaled to ``tilt``.
    place = F.when(F.col("w") > 0, F.percent_rank().over(Window.partitionBy("mix_id").orderBy(F.desc("w"), "source")) * 2 - 1).otherwise(0.0)
    p = p.withColumn("r", place).withColumn("r", F.when(F.col("w") > 0, F.col("r") - F.sum(F.col("r") * F.col("w")).over(mix)).otherwise(0.0))
    most = F.max(F.abs("r")).over(mix)
    return p.withColumn("slope", F.when(most > 0, F.col("r") / most * tilt).otherwise(0.0)).withColumn("demand", F.col("w") * F.col("total")).drop("r")


def _ordered(sized: DataFrame, buckets: int) -> DataFrame:
    """Each document with the tokens before it in its source's own order."""
    rows = sized.withColumn("h", F.xxhash64("doc_id", F.lit(29))).withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = rows.groupBy("source", "b").agg(F.sum("size").alias("s"))
    start = sums.withColumn("start", F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s")).drop("s")  # at most ``buckets`` rows a source
    inside = F.sum("size").over(Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("inside", inside).join(start, ["source", "b"]).select("doc_id", "source", "size", (F.col("start") + F.col("inside")).alias("before"))


def sizes(docs: DataFrame, path: str = tokens.DEFAULT) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text").where("doc_id is not null and source is not null and text is not null").dropDuplicates(["doc_id"])
    return materialize(src.select("doc_id", "source", tokens.count(F.col("text"), path).alias("size")), "mixsizes").where("size > 0")


def mix(docs: DataFrame, targets: DataFrame, *, path: str = tokens.DEFAULT, tilt: float = 0.5, buckets: int = 1024, sized: DataFrame | None = None) -> DataFrame:
    """``(mix_id, position, doc_id, source, repeat, tokens)``, sorted by mix and training position (in tokens)."""
    sized = sizes(docs, path) if sized is None else sized
    plan = _plan(sized, targets, tilt).where("demand > 0")  # a row for each listed mix and source
    if targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS:
        plan = F.broadcast(plan)
    rows = _ordered(sized, buckets).join(plan.select("mix_id", "source", "available", "repeats", "demand", "total", "slope"), "source")
    copies = F.sequence(F.lit(0), F.greatest(F.least(F.col("repeats") - 1, F.floor(F.col("demand") / F.col("available")).cast("int")), F.lit(0)))
    rows = rows.withColumn("repeat", F.explode(copies)).withColumn("middle", F.col("repeat") * F.col("available") + F.col("before") + F.col("size") / 2).where("middle <= demand")
    y, a = F.col("middle") / F.col("demand"), F.col("slope")
    u = F.when(F.abs(a) < 1e-9, y).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * y)) / (2 * a))
    out = rows.select("mix_id", (u * F.col("total")).alias("position"), "doc_id", "source", "repeat", F.col("size").alias("tokens"))
    return out.orderBy("mix_id", "position", "doc_id", "repeat")


def report(docs: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """``(mix_id, source, target_share, actual_share, tokens, docs_drawn, most_repeats)`` for each listed source."""
    sized = sizes(docs, kw.pop("path", tokens.DEFAULT))
    drawn = mix(docs, targets, sized=sized, **kw).groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs_drawn"), F.max(F.col("repeat") + 1).alias("most_repeats"))
    want = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    r = want.join(drawn, ["mix_id", "source"], "left").na.fill({"tokens": 0, "docs_drawn": 0, "most_repeats": 0})
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return r.select("mix_id", "source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens", "docs_drawn", "most_repeats")
