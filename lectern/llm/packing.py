"""Documents packed into containers of fixed capacity, along a space-filling curve.

Each document's words are hashed into a vector that a fixed random projection brings to a
few dimensions; its cell's number on a Hilbert curve through these dimensions is the
document's key. Documents are range-sorted by key, so neighbours in the order are alike,
and each range is packed as a stream: of every ``window`` neighbours the longest come
first, and each goes into the fullest of the open containers that it fits. At most
``keep_open`` containers are open; the fullest is closed first. A document longer than
the capacity is cut into full containers and a rest; no other is cut.

A task holds one window and the open containers, whatever the range's size. Each range
leaves at most ``keep_open`` containers partly used.

Defined results: a null text is no item; an empty one is an item of size 0 that takes no
space; repeated ids are one item; a capacity that is null or below 1 gets no items; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import tokens

_WORD = re.compile(r"\w+")


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of cells (rows of whole coordinates below 2**bits) along the Hilbert curve: Gray-code walk from the top bit down (Skilling 2004)."""
    x = coords.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            has = (x[:, i] & q) != 0
            x[:, 0] = np.where(has, x[:, 0] ^ p, x[:, 0])
            t = np.where(has, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def _vector(text: str, dims: int, memo: dict) -> np.ndarray:
    """Projection of the hashed word counts, of unit variance for unrelated words."""
    import xxhash

    total, weight = np.zeros(dims), 0.0
    counts: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        v = memo.get(w)
        if v is None:
            if len(memo) > 200_000:
                memo.clear()
            v = memo[w] = np.random.default_rng(xxhash.xxh64_intdigest(w)).standard_normal(dims)
        f = 1 + math.log(n)
        total += f * v
        weight += f * f
    return total / math.sqrt(weight) if weight else total


def _sizes(dims: int, bits: int, path: str):
    def run(batches):
        memo: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack([_vector(t, dims, memo) for t in pdf["text"]])
            # By the normal distribution each coordinate fills its range evenly.
            u = np.array([[0.5 * math.erfc(-c / math.sqrt(2)) for c in row] for row in v])
            cell = np.clip((u * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "size": [tokens.length(t, path) for t in pdf["text"]], "key": hilbert(cell, bits)})

    return run


class _Open:
    """Open containers of one capacity, by free space."""

    def __init__(self, capacity: int, keep: int):
        self.capacity, self.keep, self.free, self.next = capacity, keep, [], 0

    def place(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, b = self.free.pop(at)
        else:
            free, b = self.capacity, self.next
            self.next += 1
        free -= size
        if free > 0:
            insort(self.free, (free, b))
            if len(self.free) > self.keep:
                self.free.pop(0)
        return b


def _pack(window: int, keep: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        bins: dict[int, _Open] = {}
        held: dict[int, list] = {}

        def flush(c):
            # Of neighbours the longest first; the id decides between equals.
            rows, box = [], bins[c]
            for size, doc, key in sorted(held.pop(c), key=lambda x: (-x[0], x[1])):
                piece = 0
                while size > box.capacity:
                    rows.append((c, (part << 33) + box.next, doc, piece, box.capacity, key))
                    box.next += 1
                    size -= box.capacity
                    piece += 1
                rows.append((c, (part << 33) + box.place(size), doc, piece, size, key))
            return pd.DataFrame(rows, columns=["container_id", "bin_id", "doc_id", "piece", "tokens", "key"])

        for pdf in batches:
            for c, cap, doc, size, key in zip(*(pdf[x].tolist() for x in ("container_id", "capacity", "doc_id", "size", "key"))):
                if c not in bins:
                    bins[c] = _Open(cap, keep)
                held.setdefault(c, []).append((size, doc, key))
                if len(held[c]) >= window:
                    yield flush(c)
        for c in list(held):
            yield flush(c)

    return run


def pack(docs: DataFrame, containers: DataFrame, *, path: str = tokens.DEFAULT, dims: int = 3, bits: int = 16, window: int = 2048, keep_open: int = 4096, keys: bool = False) -> DataFrame:
    """``(container_id, bin_id, doc_id, piece, tokens)``: where each document, or piece of a long one, goes for each capacity; with ``keys`` the documents' ``key`` along the curve too."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    # Written once: range-sorting reads its input twice.
    sized = materialize(src.mapInPandas(_sizes(dims, bits, path), "doc_id bigint, size bigint, key bigint"), "sizes")
    caps = containers.select(F.col("container_id").cast("int").alias("container_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).where("container_id is not null and capacity >= 1").distinct()
    # Every document is packed for each of the listed capacities: that product is what is asked for.
    todo = caps.select(F.collect_list(F.struct("container_id", "capacity")).alias("c"))
    listed = [tuple(x) for x in todo.first().c]
    if not listed:
        return sized.select(F.lit(0).alias("container_id"), F.lit(0).cast("bigint").alias("bin_id"), "doc_id", F.lit(0).alias("piece"), F.col("size").alias("tokens"), *(["key"] if keys else [])).limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in listed]))
    rows = sized.select("doc_id", "size", "key", each.alias("c")).select("c.container_id", "c.capacity", "doc_id", "size", "key")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "container_id", "key", "doc_id").sortWithinPartitions("container_id", "key", "doc_id")
    packed = ordered.mapInPandas(_pack(window, keep_open), "container_id int, bin_id bigint, doc_id bigint, piece int, tokens bigint, key bigint")
    return packed if keys else packed.drop("key")


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_id, capacity_tokens, bins, items, tokens, fill, spread)`` for each capacity, from ``pack`` with its keys.

    ``spread`` is how far apart along the curve the documents of a container lie: the mean
    deviation of their keys inside containers by that of all keys, 1 for containers that
    take no heed of the curve, 0 for copies only.
    """
    by_bin = packed.groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.var_pop("key").alias("v"))
    total = by_bin.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum(F.when(F.col("items") > 1, F.col("v") * F.col("items"))) / F.sum(F.when(F.col("items") > 1, F.col("items")))).alias("inside"))
    total = total.join(packed.groupBy("container_id").agg(F.var_pop("key").alias("all")), "container_id")
    total = total.join(containers.select("container_id", "capacity_tokens"), "container_id").withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
    return total.withColumn("spread", F.when(F.col("all") > 0, F.sqrt(F.col("inside") / F.col("all")))).drop("inside", "all")
