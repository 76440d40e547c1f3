"""The k most similar vectors of every vector, by multi-probe p-stable hashing.

Each of ``tables`` hash tables cuts space into cells by floor((a.v + b) / width) of a few
random (2-stable) projections. A vector stands in its own cell and also visits the cells
it reaches by the perturbations most likely to succeed: those whose boundaries lie
nearest, in the order of the sum of squared distances to them. Cells are joined by Spark;
inside a cell, block matrix products rank the visitors' candidates on codes of four
or eight bits a value, and what remains is reranked with the exact cosine of the full vectors.

Nothing is cut by codes alone: each code comes with an upper bound of the angle between the
vector and its code, so a pair's cosine lies between two proven bounds. A candidate is left
out only if k others have lower bounds above its upper bound. Copies of one vector stand in
the cells once, as a class, and are told apart by id at the end.

Crowded cells are split: residents into blocks, visitors into blocks, and each pair of
blocks is one group, so no task holds a whole cell however many rows share it. Nothing
is dropped: every visitor meets every resident of each cell it visits.

Defined results: vectors that are null, of another width, all zero or with a value that
is not finite (or null) take part in nothing; equal similarities go to the smaller id;
repeated ids count once (the larger of two differing vectors in byte order); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

RESIDENTS, VISITORS = 4096, 16384
#: Up to so many crowded cells are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _projections(seed: int, table: int, dim: int, m: int, width: float):
    rng = np.random.default_rng([seed, table])
    a = rng.normal(size=(dim, dim if dim > m else m))
    q = np.linalg.qr(a)[0][:, :m] if m <= dim else a[:, :m]
    return (q * math.sqrt(dim)).astype(np.float32), rng.uniform(0, width, m).astype(np.float32)


def _perturbations(m: int, probes: int) -> np.ndarray:
    """Rows of 0/1 over 2m boundaries (m lower ones, m upper ones): every set of up to three on different axes."""
    most = 1 if probes <= 1 else 2 if probes <= 8 else 3
    sets = [c for r in range(min(most, m) + 1) for c in combinations(range(2 * m), r) if len({i % m for i in c}) == r]
    out = np.zeros((len(sets), 2 * m), np.float32)
    for i, c in enumerate(sets):
        out[i, list(c)] = 1
    return out


def _cells(unit: np.ndarray, seed: int, table: int, m: int, width: float, probes: int) -> np.ndarray:
    """Cell keys of each row, its own cell first, then the visited ones in the order of estimated success."""
    a, b = _projections(seed, table, unit.shape[1], m, width)
    u = (unit @ a + b) / width
    own = np.floor(u).astype(np.int64)
    low = u - own
    boundary = np.concatenate([low, 1 - low], 1) ** 2
    sets = _perturbations(m, probes)
    best = np.argsort(boundary @ sets.T, axis=1, kind="stable")[:, :probes]
    moves = (sets[:, m:] - sets[:, :m]).astype(np.int64)
    mix = np.random.default_rng([seed, 977]).integers(1, 2**62, m, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return ((own[:, None, :] + moves[best]) * mix).sum(2)


def _clean(batch, dim: int):
    """ids, raw vectors and unit vectors of an Arrow batch's usable rows (columns id and v)."""
    ids, lists = batch.column("id"), batch.column("v")
    ok = np.asarray(ids.is_valid()) & np.asarray(pc.equal(pc.list_value_length(lists), dim).fill_null(False))
    at = np.nonzero(ok)[0]
    raw = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    wide = raw.astype(np.float64)
    size = np.sqrt((wide * wide).sum(1))
    good = np.isfinite(size) & (size > 0)
    return ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False).astype(np.int64), raw[good], (wide[good] / size[good][:, None]).astype(np.float32), at[good]


def _raw(dim):
    def run(batches):
        for b in batches:
            ids, raw, _, _ = _clean(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in raw], pa.binary())], ["id", "raw"])

    return run


#: Largest error of a cosine by codes that is allowed for: five standard deviations at 64 wide.
CODE_ERROR = 0.12


#: What float32 products of unit vectors may be off by.
ROUNDING = 1e-5


def _codes(unit: np.ndarray, bits: int = 4) -> list[bytes]:
    """Four or eight bits a value; the scale drops out, as decoded vectors are brought to unit length."""
    if bits == 8:
        scale = np.maximum(np.abs(unit).max(1), 1e-30).astype(np.float32) / 127
        return [c.tobytes() for c in np.rint(unit / scale[:, None]).astype(np.int8)]
    scale = np.maximum(np.abs(unit).max(1), 1e-30).astype(np.float32) / 7
    code = (np.rint(unit / scale[:, None]) + 8).astype(np.uint8)
    if code.shape[1] % 2:
        code = np.concatenate([code, np.full((len(code), 1), 8, np.uint8)], 1)
    packed = code[:, 0::2] << 4 | code[:, 1::2]
    return [c.tobytes() for c in packed]


def _decode(raw: np.ndarray) -> np.ndarray:
    """Unit vectors from rows of code bytes."""
    packed = raw
    out = np.empty((len(raw), 2 * packed.shape[1]), np.float32)
    out[:, 0::2] = packed >> 4
    out[:, 1::2] = packed & 15
    out -= 8
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-30)[:, None]
    return out


def _decode8(raw: np.ndarray) -> np.ndarray:
    out = raw.view(np.int8).astype(np.float32)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-30)[:, None]
    return out


def _bounded_codes(unit: np.ndarray, bits: int) -> list[bytes]:
    """Codes with one more byte: the angle between vector and code, rounded up, in steps of 1/256 or 1/4096; 255 is no bound."""
    codes = _codes(unit, bits)
    rows = np.frombuffer(b"".join(codes), np.uint8).reshape(len(unit), -1)
    d = (_decode(rows)[:, : unit.shape[1]] if bits == 4 else _decode8(rows)).astype(np.float64)
    u = unit.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    dot = (u * d).sum(1)
    angle = np.arctan2(np.sqrt(((u - dot[:, None] * d) ** 2).sum(1)), dot) + 1e-6
    step = np.minimum(np.ceil(angle * (256 if bits == 4 else 4096)), 255).astype(np.uint8)
    return [c + bytes([a]) for c, a in zip(codes, step.tolist())]


def _opened(rows: list[bytes], dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the bounds of their angles, of one group's codes or full vectors."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    if raw.shape[1] == 4 * dim:
        return raw.view(np.float32), np.zeros(len(rows))
    step = raw[:, -1].astype(np.float64)
    codes = np.ascontiguousarray(raw[:, :-1])
    return _decode(codes)[:, :dim] if bits == 4 else _decode8(codes), np.where(step == 255, np.pi, step / (256 if bits == 4 else 4096))


def _count(dim, seed, tables, m, width, probes):
    def run(batches):
        for b in batches:
            ids, _, unit, at = _clean(b, dim)
            if not len(ids):
                continue
            asks = np.asarray(b.column("asks"))[at]
            for t in range(tables):
                cells = _cells(unit, seed, t, m, width, probes)
                u, back = np.unique(cells, return_inverse=True)
                back = back.reshape(cells.shape)
                res, vis = np.bincount(back[:, 0], minlength=len(u)), np.bincount(back[asks].ravel(), minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(u), pa.array(res.astype(np.int64)), pa.array(vis.astype(np.int64))], ["t", "cell", "residents", "visitors"])

    return run


def _spread(dim, seed, tables, m, width, probes, bits, dense):
    """``dense``: by table the sorted cells whose rows carry the full vector beside the code; None is all cells."""

    def run(batches):
        for b in batches:
            ids, _, unit, at = _clean(b, dim)
            if not len(ids):
                continue
            asks = np.asarray(b.column("asks"))[at]
            codes = np.array(_bounded_codes(unit, bits), dtype=object)
            for t in range(tables):
                cells = _cells(unit, seed, t, m, width, probes)
                for p in range(cells.shape[1]):
                    keep = np.ones(len(ids), bool) if p == 0 else asks
                    n = int(keep.sum())
                    if n:
                        full = np.full(n, None, object)
                        here = np.ones(n, bool) if dense is None else np.isin(cells[keep, p], dense.get(t, ()))
                        full[here] = [x.tobytes() for x in unit[keep][here]]
                        cols = [pa.array(np.full(n, t, np.int32)), pa.array(cells[keep, p]), pa.array(ids[keep]), pa.array(np.full(n, p == 0)), pa.array(asks[keep]), pa.array(codes[keep], pa.binary()), pa.array(full, pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["t", "cell", "id", "home", "asks", "code", "full"])

    return run


def _exact(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64) if b.num_rows else np.zeros((0, 1)) for c in ("vq", "vn"))
        sim = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("n"), pa.array(sim)], ["q", "n", "sim"])


def _best(h, off, hid, ask, ask_off, ask_id, k: int, min_sim: float):
    """For each asking row, with both bounds of the cosine, the residents that may be among its best ``k`` with at least ``min_sim``."""
    widest = off.max()
    least = math.acos(max(-1.0, min(1.0, min_sim))) if min_sim >= -1 else math.pi
    for at in range(0, len(ask_id), 1024):
        qid, qoff = ask_id[at : at + 1024], ask_off[at : at + 1024]
        s = ask[at : at + 1024] @ h.T
        reach = np.full(len(qid), least)
        if min_sim < -1 and len(hid) > k + 1:
            # One more than k, as the row itself may be among them.
            kth = np.partition(s, len(hid) - k - 1, axis=1)[:, len(hid) - k - 1]
            reach = np.arccos(np.clip(kth.astype(np.float64) - ROUNDING, -1, 1)) + qoff + widest
        r, c = np.nonzero(s >= (np.cos(np.minimum(reach + qoff + widest, np.pi)) - 2 * ROUNDING)[:, None].astype(np.float32))
        other = qid[r] != hid[c]
        r, c = r[other], c[other]
        v, slack = s[r, c].astype(np.float64), qoff[r] + off[c]
        lo = np.cos(np.minimum(np.arccos(np.clip(v - ROUNDING, -1, 1)) + slack, np.pi)) - 1e-6
        hi = np.cos(np.maximum(np.arccos(np.clip(v + ROUNDING, -1, 1)) - slack, 0)) + 1e-6
        may = hi >= min_sim
        n = np.bincount(r, minlength=len(qid))
        if len(r) and n.max() > k:
            order = np.lexsort((-lo, r))
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            many = n > k
            bar = np.full(len(qid), -2.0)
            bar[many] = lo[order[first[many] + k - 1]]
            may &= hi >= bar[r]
        if may.any():
            yield qid[r[may]], hid[c[may]], lo[may].astype(np.float32), hi[may].astype(np.float32)


def _match(k: int, min_sim: float, dim: int, bits: int):
    """Of the rows of a partition those of a group meet; a group is a pair of blocks of one cell, so it is of bounded size."""

    def run(batches):
        cols: list[list] = [[], [], [], []]
        code: list = []
        for b in batches:
            n = b.num_rows
            if n:
                for x, name in zip(cols, ("g", "id", "resident", "visitor")):
                    x.append(b.column(name).to_numpy(zero_copy_only=False))
                code += b.column("code").to_pylist()
        if not cols[0]:
            return
        g, ids, resident, visitor = (np.concatenate(x) for x in cols)
        order = np.argsort(g, kind="stable")
        cut = np.concatenate([[0], np.nonzero(np.diff(g[order]))[0] + 1, [len(g)]])
        out, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "n", "lo", "hi"])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            rows = order[a:z]
            res, vis = rows[resident[rows]], rows[visitor[rows]]
            if not len(res) or not len(vis) or (len(res) == 1 and len(vis) == 1 and res[0] == vis[0]):
                continue
            res = res[np.unique(ids[res], return_index=True)[1]]  # a repeated row must not count twice among the best
            vectors, off = _opened([code[i] for i in res], dim, bits)
            ask, ask_off = _opened([code[i] for i in vis], dim, bits)
            for found in _best(vectors, off, ids[res], ask, ask_off, ids[vis], k, min_sim):
                out.append(found)
                held += len(found[0])
            if held > 500_000:
                yield pack()
                out, held = [], 0
        if out:
            yield pack()

    return run


def shape_for(rows: int) -> dict:
    """Projections, tables and probes for so many rows: cells grow in number with the rows, tables and probes with the projections."""
    m = max(4, min(24, round(math.log2(max(rows, 1) / 2300))))
    return {"projections": m, "tables": 4 if m <= 7 else 5 + (m - 8) // 2, "probes": 4 if m <= 6 else 6 + 2 * (m - 7)}


def _one_per_id(vecs: DataFrame, dim: int) -> DataFrame:
    """``vecs`` with each id once, of differing usable vectors the larger in byte order; nothing is done where no id is repeated."""
    if vecs.groupBy("id").count().where("count > 1").isEmpty():
        return vecs
    raw = vecs.mapInArrow(_raw(dim), "id bigint, raw binary").groupBy("id").agg(F.max("raw").alias("raw"))
    return materialize(raw.mapInArrow(_listed, "id bigint, v array<float>"), "vectors")


def _listed(batches):
    for b in batches:
        rows = [np.frombuffer(x, np.float32) for x in b.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float32()))], ["id", "v"])


def _copies(vecs: DataFrame) -> DataFrame | None:
    """``(id, rep)`` of the vectors that stand more than once, ``rep`` the smallest id of the class; None if there are none."""
    # 128 bits of hash decide whether two vectors are copies.
    keyed = vecs.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = keyed.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = materialize(classes, "classes")
    return None if classes.isEmpty() else materialize(keyed.join(classes, ["h", "h2"]).select("id", "rep"), "copies")


def top_k(vectors: DataFrame, *, id_col="vec_id", vec_col="embeddings", dim=64, k=5, min_sim=-2.0, queries: DataFrame | None = None, projections=None, tables=None, probes=None, width=1.6, seed=11) -> DataFrame:
    """``(q, n, sim, rank)``: for each query its k most similar other vectors with at least ``min_sim``.

    ``queries`` (a column ``q``) names the rows that ask; all rows do without it.
    Every candidate that the codes' proven bounds leave open is reranked. Without a threshold
    the codes have eight bits a value; with one they have four, and rows of crowded cells
    bring their full vectors, so that a crowded topic leaves few candidates open.
    """
    vecs = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null").where(F.size("v") == dim)
    chosen = shape_for(vectors.count())
    m, nt, np_ = projections or chosen["projections"], tables or chosen["tables"], probes or chosen["probes"]
    bits = 8 if min_sim < -1 else 4
    vecs = _one_per_id(vecs, dim)
    copies = _copies(vecs)
    asked = queries.select(F.col("q").cast("bigint").alias("id")).distinct() if queries is not None else None
    single, flags = vecs, asked
    if copies is not None:
        single = vecs.join(copies.where("id <> rep").select("id"), "id", "left_anti")
        if asked is not None:
            flags = asked.join(copies, "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct()
    asking = single.withColumn("asks", F.lit(True))
    if flags is not None:
        asking = single.join(flags.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    spec = (dim, seed, nt, m, width, np_)
    counts = asking.mapInArrow(_count(*spec), "t int, cell bigint, residents bigint, visitors bigint").groupBy("t", "cell").agg(F.sum("residents").alias("residents"), F.sum("visitors").alias("visitors"))
    crowded = counts.where((F.col("residents") > RESIDENTS) | (F.col("visitors") > VISITORS)).select(
        "t", "cell", F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("rb"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("vb")
    )
    # A cell in some thousands of rows is crowded at most; written once, as its number decides how it is joined.
    crowded = materialize(crowded, "crowded")
    dense: dict | None = {}
    if crowded.count() <= BROADCAST_CELLS:
        for t, cell in crowded.select("t", "cell").collect() if bits == 4 else ():
            dense.setdefault(t, []).append(cell)
        dense = {t: np.array(sorted(c), np.int64) for t, c in dense.items()}
        crowded = F.broadcast(crowded)
    elif bits == 4:
        dense = None
    rows = asking.mapInArrow(_spread(*spec, bits, dense), "t int, cell bigint, id bigint, home boolean, asks boolean, code binary, full binary").join(crowded, ["t", "cell"], "left")
    full_code = F.col("rb").isNotNull() & F.col("full").isNotNull()
    rows = rows.withColumn("code", F.when(full_code, F.col("full")).otherwise(F.col("code"))).drop("full")
    rb, vb = F.greatest(F.coalesce("rb", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("vb", F.lit(1)), F.lit(1))
    mine_r, mine_v = F.pmod(F.xxhash64("id"), rb).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), vb).cast("int")
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), rb - 1), lambda i: F.transform(F.sequence(F.lit(0), vb - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = rows.select(
        "t", "cell", "id", "code", "home", "asks", mine_r.alias("mr"), mine_v.alias("mv"), F.explode(blocks).alias("b")
    ).select(
        # The last bit tells full vectors from codes, so a group never has both.
        F.shiftleft(F.xxhash64("t", "cell", "b.i", "b.j"), 1).bitwiseOR((F.length("code") == 4 * dim).cast("bigint")).alias("g"), "id", "code",
        (F.col("home") & (F.col("b.i") == F.col("mr"))).alias("resident"), (F.col("asks") & (F.col("b.j") == F.col("mv"))).alias("visitor"),
    ).where("resident or visitor")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "g").mapInArrow(_match(k, min_sim, dim, bits), "q bigint, n bigint, lo float, hi float")
    # Of each question all that may be among the best by the bounds, then the exact cosine of those.
    best = found.groupBy("q", "n").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    order = Window.partitionBy("q").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = best.withColumn("bar", F.nth_value("lo", k).over(order)).where(F.col("bar").isNull() | (F.col("hi") >= F.col("bar"))).select("q", "n")
    full = single.mapInArrow(_raw(dim), "id bigint, raw binary").select("id", F.col("raw").alias("v")).repartition("id")
    pairs = best.join(full.select(F.col("id").alias("q"), F.col("v").alias("vq")), "q").join(full.select(F.col("id").alias("n"), F.col("v").alias("vn")), "n")
    ranked = lambda df, most: df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))).where(F.col("rank") <= most)
    exact = ranked(pairs.mapInArrow(_exact, "q bigint, n bigint, sim double").where(F.col("sim") >= min_sim), k)
    if copies is None:
        return exact
    # Classes of copies: k + 1 members are enough as neighbours, as one may be the asking row.
    near = copies.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).select(F.col("rep").alias("n"), F.col("id").alias("member"))
    own = single.join(copies.where("id = rep").select("id"), "id", "left_semi").mapInArrow(_raw(dim), "id bigint, raw binary")
    own = own.select(F.col("id").alias("q"), F.col("id").alias("n"), F.col("raw").alias("vq"), F.col("raw").alias("vn")).mapInArrow(_exact, "q bigint, n bigint, sim double").where(F.col("sim") >= min_sim)
    classed = exact.select("q", "n", "sim").unionByName(own).join(near, "n", "left").select("q", F.coalesce("member", "n").alias("n"), "sim")
    classed = ranked(classed, k + 1).drop("rank")
    members = classed.join(copies.select(F.col("rep").alias("q"), F.col("id").alias("asker")), "q", "left").select(F.coalesce("asker", "q").alias("q"), "n", "sim").where("q <> n")
    if asked is not None:
        members = members.join(asked.withColumnRenamed("id", "q"), "q", "left_semi")
    return ranked(members, k)


def similar_pairs(vectors: DataFrame, *, threshold=0.88, k=5, **kw) -> DataFrame:
    """``(vec_a, vec_b)``, the smaller first: at least ``threshold`` similar, one among the k best of the other."""
    near = top_k(vectors, k=k, min_sim=threshold, **kw)
    return near.select(F.least("q", "n").alias("vec_a"), F.greatest("q", "n").alias("vec_b")).distinct()
