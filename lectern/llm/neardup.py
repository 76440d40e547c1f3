"""Groups of texts that differ by small edits, insertions or reordering.

A text is the bag of its words: the n-th occurrence of a word is an element of its own,
so a bag is a sparse bit string and the similarity of two bags (sum of smaller counts by
sum of larger counts) is that of two sets. Bags at least ``threshold`` similar differ in
at most H = (1 - t) / (1 + t) * (|x| + |y|) bits. The bits are cut into m = H // 2 + 2
segments, so at least two segments differ by at most one bit each. Of each segment the
variants with one wildcard are indexed: the segment's bits fall into a few slots, and
the variant leaves one slot out. Whatever bit differs, the variant that leaves its slot
out is equal, so an equality join of the variants finds every pair; nothing is lost.

Which m holds for a pair depends on both sizes, so a text stands in the segments of every
m that a partner could bring. Segments are nested (one more segment cuts one in two), so
these are few more than those of one m.

A variant is weak if what it keeps is so common that more than ``crowd`` texts are expected
to share it (by the frequencies of elements in all texts). Weak variants are not indexed
alone: as two segments of every pair agree, either a variant that isn't weak agrees or two
weak ones do, so each two weak variants of a text are one index entry. Entries that come
out crowded all the same are not compared: their texts are cut anew by another hash, and
the entry together with the new variants is indexed once more; groups that are crowded
even then are compared in blocks.

Index entries are shuffled as packed arrays by partition: for each text its sketch and four
bytes for each entry. The sketch is the parity of 88 groups of bits, and the size's code: differing bits of two
sketches never exceed those of the bags, so sketches alone reject nearly all false
candidates; what is left is verified on the elements. 64 bits of the sketch are the text's
key. Texts that share a key are verified with each other, so a key need not be unique.

Exact copies are one row from the start (combined before the shuffle), and a group of
copies is a class with members: of a class only its representative is linked.

Defined results: null texts and texts without words belong to no group; repeated ids
count once; words are runs of ASCII letters and digits after lower-casing; a text that
equals another has similarity 1; an empty table gives no rows; extra columns are ignored.
Elements are 32 bits of the hash of a word and its number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")
_TITLE = re.compile(r"^\[[^\]\n]*\] ")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: So many of the most frequent elements are told to every task: they are dealt evenly over segments, and weigh what is weak.
FREQUENT = 4096
#: Segments finer than this have no weak variants: a long text would have too many pairs of them.
WEAK_WIDTH = 64
#: Bits of a sketch.
SKETCH = 88
#: Bytes of elements and of index entries in a partition.
PART_BYTES = 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _ratio(threshold: float) -> tuple[int, int]:
    """Similarity as a fraction of whole numbers, so that bounds are exact."""
    den = 10_000
    return round(threshold * den), den


def most_bits(total: np.ndarray, threshold: float) -> np.ndarray:
    """The most bits in which two bags with ``total`` elements together may differ."""
    num, den = _ratio(threshold)
    return np.asarray(total, np.int64) * (den - num) // (den + num)


# -- bags -------------------------------------------------------------------------
class _Words(dict):
    """Numbers of words in the order in which a task meets them, and the words' hashes."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, w):
        import xxhash

        n = self[w] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(w))
        return n


def _elements(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' bags, and the hashes of all their elements, text by text: the n-th occurrence of a word is an element of its own."""
    if len(words) > 500_000:
        words.clear()
        words.hashes.clear()
    found = [_WORD.findall(_TITLE.sub("", t, count=1).lower()) for t in texts]
    size = np.array([len(w) for w in found], np.int64)
    number = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.uint64, int(size.sum()))
    key = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(32), size) | number
    key.sort()
    at = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    h = np.array(words.hashes, np.uint64)[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] if len(key) else np.zeros(0, np.uint64)
    return size, _mix(h + nth.astype(np.uint64) * _C1)


_SIZES = np.concatenate([np.arange(201), np.ceil(200 * 1.1 ** np.arange(1, 55)).astype(np.int64)])


def _size_code(size: np.ndarray) -> np.ndarray:
    """Eight bits for a size: exact up to 200, then steps of a tenth; the last one is open."""
    return (np.searchsorted(_SIZES, size, side="right") - 1).astype(np.uint64)


def _keys(size: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the bags: 56 bits with codes of their sizes (8 bits), and the other 32."""
    n = len(size)
    bit = (_mix(short.astype(np.uint64) * _C3 + _C1) >> np.uint64(40)) % np.uint64(SKETCH)
    odd = (np.bincount(np.repeat(np.arange(n), size) * SKETCH + bit.astype(np.int64), minlength=n * SKETCH) & 1).reshape(n, SKETCH).astype(np.uint64)
    key = (odd[:, :56] << np.arange(8, 64, dtype=np.uint64)).sum(1, dtype=np.uint64) | _size_code(size)
    return key, (odd[:, 56:] << np.arange(SKETCH - 56, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.uint32)


def _bags(batches):
    """Rows (key, bag, item): copies within a batch are one row here, before the shuffle.

    An item is the number of elements, the rest of the sketch, the elements and the ids.
    """
    words = _Words()
    for b in batches:
        ids = b.column("id").to_pylist()
        size, e = _elements(b.column("text").to_pylist(), words)
        full = np.nonzero(size)[0]
        rows: dict[tuple[int, bytes], list[str]] = {}
        keys, more = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        if len(full):
            end = np.cumsum(size)
            start = end - size
            sums = np.add.reduceat(e, start[full])
            # Each bag's elements in their own order, so that copies are equal arrays.
            packed = np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(32), size) | (e >> np.uint64(32))
            packed.sort()
            short = packed.astype(np.uint32)
            keys, more = _keys(size[full], short)
            for at, (k, g) in enumerate(zip(full.tolist(), sums.view(np.int64).tolist())):
                head = int(size[k]).to_bytes(4, "big") + more[at].tobytes() + short[start[k] : end[k]].tobytes()
                rows.setdefault((g, head), (at, []))[1].append(ids[k])
        at = np.array([v[0] for v in rows.values()], np.int64)
        items = [k[1] + "\0".join(v[1]).encode() for k, v in rows.items()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array([k[0] for k in rows], pa.int64()), pa.array(items, pa.binary())], ["key", "bag", "item"])


def _unpack(items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, the rests of the sketches, and all elements one text after the other."""
    items = items.to_pylist()
    head = np.frombuffer(b"".join(x[:8] for x in items), np.uint32).reshape(-1, 2)
    size = head[:, 0].byteswap().astype(np.int64)
    return size, head[:, 1], np.frombuffer(b"".join(x[8 : 8 + 4 * n] for x, n in zip(items, size.tolist())), np.uint32)


def _counts(batches):
    """(element, n): in how many texts each element stands; -1 is the number of texts."""
    words, held, texts, total = _Words(), [], 0, 0

    def merged():
        v, inv = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return v, np.bincount(inv, np.concatenate([x[1] for x in held])).astype(np.int64)

    def given(v, n):
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], ["element", "n"])

    for b in batches:
        size, e = _elements(b.column("text").to_pylist(), words)
        texts += int((size > 0).sum())
        total += len(e)
        short = (e >> np.uint64(32)).astype(np.uint32)
        short.sort()
        held.append(np.unique(short, return_counts=True))
        if sum(len(x[0]) for x in held) > 2_000_000:
            held[:] = [merged()]
            if len(held[0][0]) > 1_000_000:
                yield given(*held.pop())
    if held:
        yield given(*merged())
    yield given(np.array([-1, -2]), np.array([texts, total]))


# -- segments -----------------------------------------------------------------------
def _whole(x):
    """Weights in steps of 1/1024, as sums must not depend on their order: what is weak in one text is so in all."""
    return np.rint(np.asarray(x) * 1024)


@dataclass
class Plan:
    """What every task knows: the threshold, the slots of a segment, and the most frequent elements with their shares."""

    threshold: float
    slots: int
    texts: int
    crowd: float
    elements: np.ndarray
    shares: np.ndarray

    def __post_init__(self):
        rank = np.arange(len(self.elements))
        order = np.argsort(self.elements)
        self.elements, self.shares, self.rank = self.elements[order], self.shares[order], rank[order]

    def weigh(self, els: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, slot and weight of each element; frequent ones are dealt in the order of their frequency."""
        h = _mix(els.astype(np.uint64) * _C1 + _C3 + np.uint64(level))
        place = (h >> np.uint64(8)).astype(np.int64) & 0xFFFFFF
        slot = ((h >> np.uint64(33)) % np.uint64(self.slots)).astype(np.int64)
        rare = max(1.0, self.texts * (self.shares.min() if len(self.shares) else 1.0))
        weight = np.full(len(els), _whole(np.log(max(1, self.texts) / rare)))
        if len(self.elements):
            at = np.minimum(np.searchsorted(self.elements, els), len(self.elements) - 1)
            often = self.elements[at] == els
            p = self.shares[at[often]]
            weight[often] = _whole(np.log((1 - p) / p))
            if level == 0:
                place[often] = (place[often] & ~63) | self._dealt(self.rank[at[often]])
                slot[often] = self.rank[at[often]] // 8 % self.slots
        return place, slot, weight

    @staticmethod
    def _dealt(rank):
        return np.where(rank // 64 % 2 == 0, rank % 64, 63 - rank % 64)

    def absent(self, level: int) -> np.ndarray:
        """By place (64) and slot: minus the logarithm of the chance that none of the frequent elements there stands in a text."""
        place, slot, _ = self.weigh(self.elements, level)
        return np.bincount((place & 63) * self.slots + slot, _whole(-np.log1p(-self.shares)), minlength=64 * self.slots).reshape(64, self.slots)


def _segments(low: int, high: int) -> np.ndarray:
    """All (width, number) that segmentations of ``low`` to ``high`` segments have.

    With m segments, those below m - k and from k on (k the power of two up to m) have the
    places equal modulo 2 k, the others those modulo k: one more segment cuts one in two.
    """
    out, width = [], 1
    while width // 2 < high:
        i = np.arange(width)
        half = max(width // 2, 1)
        there = (width // 2 + i % half + (width > 1) <= high) & (width + i >= low)
        out.append(np.stack([np.full(there.sum(), width), i[there]], 1))
        width *= 2
    return np.concatenate(out)


def _entries(plan: Plan, level: int, size: np.ndarray, els: np.ndarray, salt: np.ndarray | None):
    """(row, entry): the index entries of texts, given by their sizes and elements one after the other."""
    num, den = _ratio(plan.threshold)
    low = most_bits(size + -(-size * num // den), plan.threshold) // 2 + 2
    top = most_bits(size + size * den // num, plan.threshold)
    high = top // 2 + 2
    place, slot, weight = plan.weigh(els, level)
    value = _mix(els.astype(np.uint64) + _C1 + np.uint64(level))
    lo32, hi32 = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    absent = plan.absent(level)
    end = np.cumsum(size)
    odd = _mix(np.arange(1, plan.slots + 1, dtype=np.uint64) * _C1) | np.uint64(1)
    bar = _whole(np.log(max(1, plan.texts) / plan.crowd))

    def known(code):
        segs = _segments(code >> 32, code & 0xFFFFFFFF)
        return segs, np.stack([absent[i::width].sum(0) if width <= WEAK_WIDTH else np.zeros(plan.slots) for width, i in segs.tolist()])

    # A bag in which no bit may differ has copies only.
    groups, group = np.unique(np.where(top > 0, low << 32 | high, -1), return_inverse=True)
    for g, code in enumerate(groups.tolist()):
        if code < 0:
            continue
        segs, none = known(code)
        every = np.nonzero(group == g)[0]
        for part in np.array_split(every, max(1, len(every) * len(segs) // 400_000)):
            n, m = len(part), len(segs)
            own = np.concatenate([np.arange(end[r] - size[r], end[r]) for r in part])
            row = np.repeat(np.arange(n), size[part])
            cells, at = [], []
            for width in np.unique(segs[:, 0]).tolist():
                number = np.full(width, -1)
                here = segs[:, 0] == width
                number[segs[here, 1]] = np.nonzero(here)[0]
                s = number[place[own] & (width - 1)]
                inside = s >= 0
                cells.append((row[inside] * m + s[inside]) * plan.slots + slot[own[inside]])
                at.append(own[inside])
            cells, at = np.concatenate(cells), np.concatenate(at)
            shape = (n, m, plan.slots)
            # Whole numbers below 2**53 add up exactly; sums of 64 bits are put together from halves.
            sums = np.bincount(cells, lo32[at], minlength=n * m * plan.slots).astype(np.uint64) + (np.bincount(cells, hi32[at], minlength=n * m * plan.slots).astype(np.uint64) << np.uint64(32))
            sums = sums.reshape(shape) * odd
            kept = sums.sum(2, dtype=np.uint64, keepdims=True) - sums
            where = _mix((segs[:, 0].astype(np.uint64) << np.uint64(32) | segs[:, 1].astype(np.uint64))[:, None] * np.uint64(plan.slots) + np.arange(plan.slots, dtype=np.uint64) + _C2)
            entry = _mix(kept ^ where)
            if salt is not None:
                entry = _mix(entry + salt[part][:, None, None] * _C1)
            w = np.bincount(cells, weight[at], minlength=n * m * plan.slots).reshape(shape)
            told = w.sum(2, keepdims=True) - w + none.sum(1, keepdims=True) - none
            weak = (told < bar) & (segs[:, 0] <= WEAK_WIDTH)[:, None]
            r = np.nonzero(~weak)
            yield part[r[0]], entry[r]
            # Each two weak variants of segments that have no place in common.
            flat = weak.reshape(n, -1)
            count = flat.sum(1)
            r, c = np.nonzero(flat)
            first = np.cumsum(count) - count
            codes = entry.reshape(n, -1)
            for k in range(1, int(count.max(initial=0))):
                a = np.nonzero(np.arange(len(r)) - first[r] + k < count[r])[0]
                x, y = segs[c[a] // plan.slots], segs[c[a + k] // plan.slots]
                narrow = np.minimum(x[:, 0], y[:, 0])
                apart = x[:, 1] % narrow != y[:, 1] % narrow
                a = a[apart]
                p, q = codes[r[a], c[a]], codes[r[a], c[a + k]]
                yield part[r[a]], _mix(np.minimum(p, q) * _C1 + np.maximum(p, q))


def _index(plan: Plan, level: int, parts: int):
    """Rows (p, packed): for each partition the number of texts, their sketches, numbers of entries, and the entries."""

    def packed(key, more, texts, entries):
        p = (entries % np.uint64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        p, texts, entries = p[order], texts[order], (entries[order] >> np.uint64(32)).astype(np.uint32)
        cut = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1, [len(p)]])
        out = []
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            t = texts[a:z]
            new = np.concatenate([[0], np.nonzero(np.diff(t))[0] + 1, [len(t)]])
            run = np.diff(new)
            # A number of entries is one byte; a text with more of them in a partition stands there several times.
            times = -(-run // 255)
            lens = np.full(int(times.sum()), 255, np.uint8)
            lens[np.cumsum(times) - 1] = (run - 1) % 255 + 1
            who = np.repeat(t[new[:-1]], times)
            out.append(len(lens).to_bytes(4, "little") + key[who].tobytes() + more[who].tobytes() + lens.tobytes() + entries[a:z].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(p[cut[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["p", "packed"])

    def run(batches):
        key, more, texts, entries, known, held = [], [], [], [], 0, 0

        def given():
            return packed(*(np.concatenate(x) for x in (key, more, texts, entries)))

        for b in batches:
            size, rest, els = _unpack(b.column("item"))
            salt = b.column("salt").to_numpy().view(np.uint64) if level else None
            got = list(_entries(plan, level, size, els, salt))
            key.append(b.column("key").to_numpy().view(np.uint64))
            more.append(rest)
            if got:
                rows, found = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
                order = np.argsort(rows, kind="stable")
                texts.append(rows[order] + known)
                entries.append(found[order])
                held += len(rows)
            known += b.num_rows
            if held > 4_000_000:
                yield given()
                key, more, texts, entries, known, held = [], [], [], [], 0, 0
        if held:
            yield given()

    return run


def _opened(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of one partition and the sketches of their texts, in the order of the entries."""
    ks, ms, es = [], [], []
    for b in batches:
        for x in b.column("packed"):
            raw = np.frombuffer(x.as_buffer(), np.uint8)
            n = int(raw[:4].view(np.uint32)[0])
            lens = raw[4 + 12 * n : 4 + 13 * n]
            ks.append(np.repeat(np.frombuffer(raw[4 : 4 + 8 * n].tobytes(), np.uint64), lens))
            ms.append(np.repeat(np.frombuffer(raw[4 + 8 * n : 4 + 12 * n].tobytes(), np.uint32), lens))
            es.append(np.frombuffer(raw[4 + 13 * n :].tobytes(), np.uint32))
    if not ks:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, more, entries = np.concatenate(ks), np.concatenate(ms), np.concatenate(es)
    order = np.argsort(entries)
    return entries[order], keys[order], more[order]


def _runs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.nonzero(entries[1:] != entries[:-1])[0] + 1])
    return start, np.diff(np.concatenate([start, [len(entries)]]))


def _pairs_of_runs(start: np.ndarray, length: np.ndarray, block: int):
    """Index pairs (i, j), i < j, within runs of equal entries, in blocks of bounded size."""
    for n in np.unique(length[length > 1]):
        s = start[length == n]
        if n <= 512:
            i, j = (x.astype(np.int32) for x in np.triu_indices(int(n), 1))
            step = max(1, block // len(i))
            for a in range(0, len(s), step):
                x = s[a : a + step, None]
                yield (x + i).ravel(), (x + j).ravel()
        else:
            for x in s:
                for a in range(0, int(n), 512):
                    i = np.arange(a, min(a + 512, int(n)), dtype=np.int32)
                    for c in range(a, int(n), 512):
                        j = np.arange(c, min(c + 512, int(n)), dtype=np.int32)
                        p, q = np.meshgrid(i, j, indexing="ij")
                        keep = p < q
                        yield x + p[keep], x + q[keep]


def _candidates(threshold: float, most: int | None):
    """Pairs of keys that share an entry and that the keys' bounds leave open; entries of more than ``most`` texts are left to the next level."""
    num, den = _ratio(threshold)
    last = len(_SIZES) - 1
    upto = np.concatenate([_SIZES[1:] - 1, [1 << 40]])
    fits = (upto[:, None] * den >= _SIZES[None, :] * num) & (upto[None, :] * den >= _SIZES[:, None] * num)
    bound = np.where(fits, np.minimum(most_bits(upto[:, None] + upto[None, :], threshold), SKETCH), -1).astype(np.int16)
    widest = bound.max(1)

    def run(batches):
        entries, keys, more = _opened(batches)
        if not len(entries):
            return
        start, length = _runs(entries)
        if most is not None:
            start, length = start[length <= most], length[length <= most]
        code = np.minimum(keys & np.uint64(255), np.uint64(last)).astype(np.int16)
        bits = keys >> np.uint64(8)
        limit = widest[code]
        xs, ys, held = [], [], 0

        def given():
            u = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0].view(np.int64)), pa.array(u[:, 1].view(np.int64))], ["a", "b"])

        for i, j in _pairs_of_runs(start.astype(np.int32), length, 100_000):
            differ = np.bitwise_count(bits[i] ^ bits[j])
            near = differ <= limit[i]
            i, j, differ = i[near], j[near], differ[near]
            near = differ + np.bitwise_count(more[i] ^ more[j]) <= bound[code[i], code[j]]
            a, b = keys[i[near]], keys[j[near]]
            other = a != b
            a, b = a[other], b[other]
            xs.append(np.minimum(a, b))
            ys.append(np.maximum(a, b))
            held += len(a)
            if held > 2_000_000:
                yield given()
                xs, ys, held = [], [], 0
        if held:
            yield given()

    return run


def _crowded(most: int, parts: int):
    """(key, salt): the texts of entries with more than ``most`` of them; the salt tells the entry."""
    from pyspark import TaskContext

    def run(batches):
        entries, keys, _ = _opened(batches)
        if not len(entries):
            return
        start, length = _runs(entries)
        p = np.uint64(TaskContext.get().partitionId())
        for s, n in zip(start[length > most].tolist(), length[length > most].tolist()):
            k = np.unique(keys[s : s + n])
            salt = _mix(np.full(len(k), entries[s], np.uint64) * np.uint64(parts) + p)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(salt.view(np.int64))], ["key", "salt"])

    return run


# -- the operator -----------------------------------------------------------------
def _source(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def plan_for(texts: DataFrame, *, text_col="content", id_col="chunk_id", threshold=0.8, slots=3, crowd=300.0) -> tuple[Plan, int]:
    """The plan by the frequencies of elements in all texts, and the number of all elements."""
    counted = _source(texts, id_col, text_col).select("text").mapInArrow(_counts, "element bigint, n bigint").groupBy("element").agg(F.sum("n").alias("n"))
    # The report's two totals and a table of fixed length.
    rows = counted.orderBy(F.col("element") >= 0, F.desc("n"), "element").limit(FREQUENT + 2).collect()
    said = {r.element: r.n for r in rows}
    n, total = said.pop(-1, 0), said.pop(-2, 0)
    # Whoever stands in all texts (or in all but one) tells nothing.
    share = np.array([min(v / max(n, 1), 1 - 0.5 / max(n, 1)) for v in said.values()])
    return Plan(threshold, slots, n, crowd, np.array(list(said), np.uint32), share), total


def bags(texts: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """``(key, bag, item)``: bags of words, rows of equal keys together.

    All that follows reads these three columns, so Spark makes this exchange once.
    """
    return _source(texts, id_col, text_col).mapInArrow(_bags, "key bigint, bag bigint, item binary").where("key is not null and bag is not null and item is not null").repartition(partitions, "key")


def _verify(threshold: float):
    num, den = _ratio(threshold)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                (nx, _, x), (ny, _, y) = (_unpack(part.column(c)) for c in ("ia", "ib"))
                n = part.num_rows
                # One sort key for each (pair, element); elements of a bag differ, so what occurs twice is shared.
                k = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), size) << np.uint64(32) | e for size, e in ((nx, x), (ny, y))])
                k.sort()
                shared = np.bincount((k[1:][k[1:] == k[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n) if len(k) else np.zeros(n, np.int64)
                union = nx + ny - shared
                ok = pa.array(shared * den >= union * num)
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(ok) for c in ("ka", "ba", "kb", "bb")), pa.array(shared / np.maximum(union, 1)).filter(ok)], ["ka", "ba", "kb", "bb", "similarity"])

    return run


def _size_of(item: str):
    return F.conv(F.hex(F.substring(item, 1, 4)), 16, 10).cast("bigint")


def links(members: DataFrame, plan: Plan, total: int, *, most: int = 2048) -> DataFrame:
    """``(ka, ba, kb, bb, similarity)``: linked pairs of different bags (by key and bag) from the rows of ``bags``."""
    n = partitions_for(members, total)
    parts = max(n, total * 6 // PART_BYTES)
    reps = members.groupBy("key", "bag").agg(F.min("item").alias("item"))
    entries = reps.select("key", "item").mapInArrow(_index(plan, 0, parts), "p int, packed binary").repartitionById(parts, "p").select("packed")
    near = entries.mapInArrow(_candidates(plan.threshold, most), "a bigint, b bigint")
    again = entries.mapInArrow(_crowded(most, parts), "key bigint, salt bigint").join(reps.select("key", "item"), "key").select("key", "item", "salt")
    again = again.mapInArrow(_index(plan, 1, parts), "p int, packed binary").repartitionById(parts, "p").select("packed")
    near = near.unionAll(again.mapInArrow(_candidates(plan.threshold, None), "a bigint, b bigint"))
    near = near.repartition(n, "a").dropDuplicates(["a", "b"])
    side = lambda k, b, i: reps.select(F.col("key").alias(k), F.col("bag").alias(b), F.col("item").alias(i))
    columns = ["ka", "ba", "ia", "kb", "bb", "ib"]
    found = near.join(side("a", "ba", "ia"), "a").join(side("b", "bb", "ib"), "b").withColumnsRenamed({"a": "ka", "b": "kb"}).select(columns)
    # Bags that share a key are compared as they are; those so short that no bit may differ are left out.
    num, den = _ratio(plan.threshold)
    some = lambda i: _size_of(i) + F.floor(_size_of(i) * den / num) >= -(-(den + num) // (den - num))
    x, y = side("ka", "ba", "ia").where(some("ia")), side("kb", "bb", "ib").where(some("ib"))
    same = x.join(y, (F.col("ka") == F.col("kb")) & (F.col("ba") < F.col("bb"))).select(columns)
    return found.unionAll(same).mapInArrow(_verify(plan.threshold), "ka bigint, ba bigint, kb bigint, bb bigint, similarity double")


def partitions_for(df: DataFrame, total: int) -> int:
    """As many as the session has, or more if the elements are many."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * 4 // PART_BYTES)


def _ids(members: DataFrame) -> DataFrame:
    ids = F.split(F.decode(F.substring("item", _size_of("item") * 4 + 9, F.length("item")), "UTF-8"), "\0")
    return members.select("key", "bag", F.explode(ids).alias("id")).distinct()


#: Members of a class of copies meet in blocks of about so many.
BLOCK = 2048


def pairs(texts: DataFrame, *, id_col="chunk_id", text_col="content", threshold=0.8, most=2048, **kw) -> DataFrame:
    """``(chunk_a, chunk_b)``, smaller first in byte order: all pairs, those of copies included."""
    plan, total = plan_for(texts, id_col=id_col, text_col=text_col, threshold=threshold, **kw)
    members = bags(texts, id_col, text_col, partitions_for(texts, total))
    ids = _ids(members)
    x, y = ids.select("key", "bag", F.col("id").alias("x")), ids.select("key", "bag", F.col("id").alias("y"))
    near = links(members, plan, total, most=most)
    # Ids lie by key; the number of the bag is compared beside it, so that they stay where they are.
    same = lambda a, b: F.col(a).bitwiseXOR(F.col(b)) == 0
    linked = near.join(y, (F.col("kb") == F.col("key")) & same("bb", "bag")).select("ka", "ba", "y").join(x, (F.col("ka") == F.col("key")) & same("ba", "bag")).select("x", "y")
    many = ids.groupBy("key", "bag").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("bag").alias("b"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n"))
    copied = ids.join(many, (F.col("key") == F.col("k")) & same("bag", "b"))
    copied = copied.withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    copies = copied.select("key", "bag", "i", "j", F.col("id").alias("x")).join(copied.select("key", "bag", F.col("i").alias("j"), F.col("j").alias("i"), F.col("id").alias("y")), ["key", "bag", "i", "j"]).where("x < y").select("x", "y")
    return linked.where("x <> y").unionAll(copies).select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"))


def classes(texts: DataFrame, *, id_col="chunk_id", text_col="content", threshold=0.8, most=2048, **kw) -> DataFrame:
    """``(id, class_id, copies, links)``: one row for each text: its class of equal bags, their number, and how many other classes are linked to it."""
    plan, total = plan_for(texts, id_col=id_col, text_col=text_col, threshold=threshold, **kw)
    members = bags(texts, id_col, text_col, partitions_for(texts, total))
    near = links(members, plan, total, most=most)
    ends = F.explode(F.array(F.struct(F.col("ka").alias("key"), F.col("ba").alias("bag")), F.struct(F.col("kb").alias("key"), F.col("bb").alias("bag"))))
    degree = near.select(ends.alias("e")).groupBy("e.key", "e.bag").agg(F.count("*").alias("links"))
    size = _ids(members).groupBy("key", "bag").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(degree, ["key", "bag"], "left")
    size = size.select(F.col("key").alias("k"), F.col("bag").alias("b"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return _ids(members).join(size, (F.col("key") == F.col("k")) & (F.col("bag").bitwiseXOR(F.col("b")) == 0)).select("id", "class_id", "copies", "links")
