"""BM25 top-k of many asked texts in a block of chunks, with numpy.

A block's postings lie by term. An asked text adds its terms in the order of the most they
can give (largest first); once the terms that are left can't lift a chunk without the ones
before into the best k, they are only looked up for the chunks found so far, and of these
for those that can still be among the best. The result is exact: bounds hold for the block,
``least`` is a score that k chunks are known to reach, and where a weight is negative nothing is left out.

Chunks lie by folder within a block, so one folder is a range of every term's postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that are looked at together; a larger block has longer lists and fewer of them.
BLOCK = 131_072
#: Scores are ranked by nine decimals, so what is nearer than this may still change places.
NEAR = 2e-9


def counted(batches):
    """``tokens`` of each row as distinct ``terms`` and their numbers ``tfs``."""
    for b in batches:
        tokens, n = b.column("tokens"), b.num_rows
        words = pc.dictionary_encode(tokens.flatten())
        size = max(len(words.dictionary), 1)
        row = np.repeat(np.arange(n, dtype=np.int64), pc.fill_null(tokens.value_lengths(), 0).to_numpy())
        key, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
        at = pa.array(np.searchsorted(key // size, np.arange(n + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(at, words.dictionary.take(pa.array(key % size)))
        cols = [b.column(c) for c in ("chunk_id", "folder", "filename", "dl")]
        yield pa.RecordBatch.from_arrays([*cols, terms, pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))], ["chunk_id", "folder", "filename", "dl", "terms", "tfs"])


def frequencies(batches):
    """``(term, n)`` of the rows' distinct terms, for each batch."""
    for b in batches:
        c = pc.value_counts(b.column("terms").flatten())
        yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["term", "n"])


def asked(rows: pa.Table) -> dict:
    """Columns ``(ask, k, folder, filename, least, terms [(term, weight)])`` as the kernel takes them."""
    t = rows.column("terms").combine_chunks()
    t = t if isinstance(t, pa.ListArray) else pa.concat_arrays(t.chunks)
    flat = t.flatten()
    words = pc.dictionary_encode(flat.field("term"))
    at = np.concatenate([[0], np.cumsum(pc.fill_null(t.value_lengths(), 0).to_numpy(zero_copy_only=False))])
    return {
        "ask": rows.column("ask").to_numpy(), "k": rows.column("k").to_numpy(), "folder": rows.column("folder_filter").to_pylist(), "filename": rows.column("filename").to_pylist(),
        "at": at, "least": rows.column("least").to_numpy(), "code": words.indices.to_numpy(), "weight": flat.field("weight").to_numpy(zero_copy_only=False), "words": words.dictionary,
    }


class _Block:
    def __init__(self, parts: list, n_terms: int, avgdl: float, k1: float, b: float, by_file: bool):
        t = pa.Table.from_batches([x[0] for x in parts])
        n = self.n = t.num_rows
        order = pc.sort_indices(t, sort_keys=[("folder", "ascending"), ("chunk_id", "ascending")])
        t = t.take(order)
        place = np.empty(n, np.int64)
        place[order.to_numpy()] = np.arange(n)
        self.ids = t.column("chunk_id").combine_chunks()
        self.rank = pc.rank(t.column("chunk_id"), tiebreaker="first").to_numpy()
        runs = pc.run_end_encode(t.column("folder").combine_chunks())
        ends = [0, *runs.run_ends.to_pylist()]
        self.folders = {f: (a, z) for f, a, z in zip(runs.values.to_pylist(), ends, ends[1:])}
        self.files: dict = {}
        if by_file:
            names = pc.dictionary_encode(t.column("filename").combine_chunks())
            code = pc.fill_null(names.indices, -1).to_numpy()
            o = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[o], np.arange(len(names.dictionary) + 1))
            self.files = {f: o[a:z].astype(np.int32) for f, a, z in zip(names.dictionary.to_pylist(), cuts, cuts[1:])}
        first = np.cumsum([0, *[x[0].num_rows for x in parts]])
        doc = place[np.concatenate([x[1] + f for x, f in zip(parts, first)])]
        code, tf = (np.concatenate([x[i] for x in parts]) for i in (2, 3))
        o = np.argsort(code.astype(np.int64) * n + doc, kind="stable")
        code, doc, tf = code[o], doc[o], tf[o]
        norm = k1 * (1 - b + b * t.column("dl").to_numpy() / avgdl)
        self.doc, self.part = doc.astype(np.int32), tf * (k1 + 1) / (tf + norm[doc])
        self.at = np.searchsorted(code, np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        some = np.nonzero(self.at[1:] > self.at[:-1])[0]
        if len(some):
            self.most[some] = np.maximum.reduceat(self.part, self.at[some])
        self.acc = np.zeros(n)

    def best(self, s: np.ndarray, docs: np.ndarray, k: int):
        """The k largest of ``s`` by nine decimals, equal ones by chunk id."""
        r, m = np.round(s, 9), np.arange(len(s))
        if len(r) > k:
            m = np.nonzero(r >= np.partition(r, len(r) - k)[len(r) - k])[0]
        m = m[np.lexsort((self.rank[docs[m]], -r[m]))[:k]]
        return docs[m], s[m]

    def look(self, s: np.ndarray, docs: np.ndarray, weight: float, a: int, z: int) -> None:
        """Add to ``s`` what a term gives to ``docs``."""
        d = self.doc[a:z]
        at = np.minimum(np.searchsorted(d, docs), z - a - 1)
        hit = np.nonzero(d[at] == docs)[0]
        s[hit] += weight * self.part[a + at[hit]]

    def among(self, terms: list, docs: np.ndarray, k: int):
        """The best k of ``docs``, without a common term too."""
        s = np.zeros(len(docs))
        for _, w, a, z in terms:
            self.look(s, docs, w, a, z)
        return self.best(s, docs, k)

    def top(self, terms: list, k: int, least: float):
        prune = all(t[1] > 0 for t in terms)
        terms = sorted(terms, key=lambda t: -t[0])
        rest = np.append(np.cumsum([t[0] for t in terms][::-1])[::-1], 0.0)
        acc, docs, i = self.acc, np.empty(0, np.int32), 0
        while i < len(terms) and not (prune and rest[i] < least - NEAR):
            _, w, a, z = terms[i]
            d = self.doc[a:z]
            if prune:
                new = d[acc[d] == 0]
            else:
                new = d if not len(docs) else np.setdiff1d(d, docs, assume_unique=True)
            docs = np.concatenate([docs, new]) if len(docs) else new
            acc[d] += w * self.part[a:z]
            i += 1
            # What is found so far can't be above the bounds of its terms.
            if prune and i < len(terms) and len(docs) >= k and rest[0] - rest[i] > rest[i]:
                least = max(least, np.partition(acc[docs], len(docs) - k)[len(docs) - k])
        s = acc[docs]
        acc[docs] = 0.0
        for j in range(i, len(terms)):
            if len(docs) > 2 * k or len(docs) and least > 0:
                if len(docs) > 2 * k:
                    least = max(least, np.partition(s, len(s) - k)[len(s) - k])
                keep = np.nonzero(s + rest[j] >= least - NEAR)[0]
                docs, s = docs[keep], s[keep]
            self.look(s, docs, *terms[j][1:])
        if not prune:
            docs, s = docs[s > 0], s[s > 0]
        keep = np.nonzero(s >= least - NEAR)[0]
        return self.best(s[keep], docs[keep], k)


def _read(batches, words: pa.Array):
    """Parts of blocks: ids and lengths, and of the postings that some ask wants the row, the term's number and tf."""
    parts, n = [], 0
    for b in batches:
        t = b.column("terms")
        code = pc.fill_null(pc.index_in(t.flatten(), value_set=words), -1).to_numpy()
        keep = np.nonzero(code >= 0)[0]
        row = np.repeat(np.arange(b.num_rows), pc.fill_null(t.value_lengths(), 0).to_numpy())
        parts.append((b.select(["chunk_id", "folder", "filename", "dl"]), row[keep], code[keep], b.column("tfs").flatten().to_numpy()[keep]))
        n += b.num_rows
        if n >= BLOCK:
            yield parts
            parts, n = [], 0
    if n:
        yield parts


def search(asks, avgdl: float, k1: float, b: float):
    """A function for ``mapInArrow`` over an index's rows: ``(ask, chunk_id, bm25)`` of the best k of each ask in each block. ``asks`` is a broadcast of ``asked``."""

    def run(batches):
        q = asks.value
        named = any(f is not None for f in q["filename"])
        for parts in _read(batches, q["words"]):
            x = _Block(parts, len(q["words"]), avgdl, k1, b, named)
            code, weight, at, who, where, score = q["code"].tolist(), q["weight"].tolist(), q["at"].tolist(), [], [], []
            begin, most = x.at.tolist(), x.most.tolist()
            for i, (k, folder, name, least) in enumerate(zip(q["k"].tolist(), q["folder"], q["filename"], q["least"].tolist())):
                lo, hi = (0, x.n) if folder is None else x.folders.get(folder, (0, 0))
                docs = None
                if name is not None:
                    docs = x.files.get(name)
                    docs = docs[(docs >= lo) & (docs < hi)] if docs is not None else ()
                if lo == hi or docs is not None and not len(docs):
                    continue
                terms = []
                for j in range(at[i], at[i + 1]):
                    c, w = code[j], weight[j]
                    a, z = begin[c], begin[c + 1]
                    if folder is not None and a < z:
                        a, z = a + int(np.searchsorted(x.doc[a:z], lo)), a + int(np.searchsorted(x.doc[a:z], hi))
                    if a < z and w != 0:
                        terms.append((w * most[c], w, a, z))
                if not terms and docs is None:
                    continue
                found, s = x.top(terms, k, least) if docs is None else x.among(terms, docs, k)
                who.append(np.full(len(found), q["ask"][i]))
                where.append(found)
                score.append(s)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), x.ids.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(score))], ["ask", "chunk_id", "bm25"])

    return run
