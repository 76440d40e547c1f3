"""Texts that were decoded with the wrong character encoding, and their restoration.

Garbled sequences are precomputed for every pair of a true and a wrong encoding: what
each plausible character turns into when its UTF-8 bytes (once or twice) are read in a
one-byte encoding. A multi-pattern automaton finds them in one pass over each text, and
only matched spans are replaced, so correct text beside them stays as it is.

Pairs of two one-byte encodings garble one character into another one, so no sequence by
itself tells. For these the unit is the blank-separated word: all words with characters
beyond ASCII are counted over all documents, each one's possible originals come from the
precomputed character maps, and a word is garbled if an original is far more frequent in
the documents than it, or plain where it is oddly spelt and not far more frequent itself.
Where no word of a text is so sure, several that are half as frequent again in their original form tell
together. Such words are joined back to their documents by Spark.

Defined results: null and empty texts are no findings; a text with the replacement
character, or with the beginning of a garbled sequence whose rest is missing, has lost
characters, so its length is -1; repeated rows of a document count once; extra columns
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: One-byte encodings in which UTF-8 bytes are misread.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp852", "cp1254", "cp1257", "mac_cyrillic")
#: (true, wrong) pairs of one-byte encodings.
SINGLE = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp866"), ("cp1252", "koi8-r"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp850", "latin-1"), ("cp437", "latin-1"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("cp852", "cp1252"), ("cp1250", "cp852"), ("cp1250", "cp437"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("mac_roman", "cp437"), ("cp1250", "cp1251"),
)
#: Characters that texts of the covered languages hold: letters of two Latin blocks and of Cyrillic, signs and punctuation.
PLAUSIBLE = "".join(chr(c) for c in [*range(0xA0, 0x180), *range(0x391, 0x3CA), *range(0x401, 0x452), 0x490, 0x491, *range(0x2190, 0x21A0), *range(0x2500, 0x25D0)]) + "ȘșȚțˆ˜–—―‘’‚“”„†‡•…‰‹›€№™∂∆∏∑√∞∫≈≠≤≥◊′″ ̧́̈̂̀"
#: What may follow only in text that really is Cyrillic: pairs whose garbled form could be ordinary letters and marks.
_AMBIGUOUS = ("cp1251", "koi8-r", "cp866", "mac_cyrillic")


_RUN, _CYRILLIC = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[\u0400-\u04ff]")


def _decode(raw: bytes, encoding: str) -> str:
    """Undefined bytes come out as the control character of the same number, as lenient decoders do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(1)
def _patterns() -> dict[str, tuple[str, bool]]:
    """Garbled sequence -> (original, whether it needs a neighbour to be believed)."""
    found: dict[str, tuple[str, bool]] = {}
    for wrong in WRONG:
        for c in PLAUSIBLE:
            once = _decode(c.encode(), wrong)
            if once != c and not once.isascii():
                found.setdefault(once, (c, wrong in _AMBIGUOUS or once.isalpha()))
    for wrong in WRONG:
        for c in PLAUSIBLE:
            once = _decode(c.encode(), wrong)
            twice = _decode(once.encode(), wrong)
            if not once.isascii():
                found.setdefault(twice, (c, False))
    return found


@lru_cache(1)
def _automaton():
    import ahocorasick

    a, patterns = ahocorasick.Automaton(), _patterns()
    # Beginnings of sequences whose rest is missing; a single character is none, as it is often right.
    for seq in patterns:
        for n in range(2, len(seq)):
            if seq[:n] not in patterns:
                a.add_word(seq[:n], (n, None, False))
    for seq, (orig, weak) in patterns.items():
        a.add_word(seq, (len(seq), orig, weak))
    a.make_automaton()
    return a


def _hits(text: str, beginnings: bool) -> list[tuple[int, int, str | None, bool]]:
    """Sequences (start, end, original, weak) from left to right, of several at one place the longest."""
    hits = [(end - n + 1, end + 1, orig, weak) for end, (n, orig, weak) in _automaton().iter(text) if beginnings or orig is not None]
    hits.sort(key=lambda h: (h[0], -h[1]))
    out, at = [], 0
    for h in hits:
        if h[0] >= at:
            out.append(h)
            at = h[1]
    return out


def repair(text: str) -> tuple[str, int, bool]:
    """The text with garbled spans replaced, how many there were, and whether one had lost its end."""
    if text.isascii():
        return text, 0, False
    spans = _hits(text, False)
    if any(h[3] for h in spans):
        # Sequences that could be ordinary letters count only where the whole run of characters
        # beyond ASCII is made of sequences; Cyrillic ones not alone, unless the text has many.
        covered = {}
        for m in _RUN.finditer(text):
            inside = [h for h in spans if m.start() <= h[0] < m.end()]
            if inside and sum(h[1] - h[0] for h in inside) == m.end() - m.start():
                covered |= {h[0]: len(inside) for h in inside}
        many = len(covered) >= 4
        spans = [h for h in spans if not h[3] or (h[0] in covered and (many or covered[h[0]] > 1 or not _CYRILLIC.search(text[h[0] : h[1]])))]
    out, at = [], 0
    for start, end, orig, _ in spans:
        out += [text[at:start], orig]
        at = end
    out.append(text[at:])
    fixed = "".join(out)
    # A beginning that is left beside garbled sequences had lost its rest; one of letters only where none follows.
    lost = bool(spans) and any(orig is None and (fixed[end : end + 1] in ("", "\ufffd") or fixed[end].isascii() or not fixed[start:end].isalpha()) for start, end, orig, _ in _hits(fixed, True))
    return fixed, len(spans), lost


@lru_cache(1)
def _single_maps() -> list[dict[int, str]]:
    maps = []
    for true, wrong in SINGLE:
        m = {}
        for b in range(0x80, 0x100):
            try:
                good = bytes([b]).decode(true)
            except UnicodeDecodeError:
                continue
            bad = _decode(bytes([b]), wrong)
            if bad != good:
                m[ord(bad)] = good
        maps.append(m)
    return maps


def _multi(batches):
    for pdf in batches:
        got = [repair(t) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "fixed": [g[0] for g in got], "spans": [g[1] for g in got], "lost": [g[2] or "�" in t for g, t in zip(got, pdf["text"])]})


def _originals(batches):
    for pdf in batches:
        rows = []
        for w, n in zip(pdf["word"], pdf["n"]):
            for k, m in enumerate(_single_maps()):
                o = w.translate(m)
                if o != w and not any("\x80" <= c <= "\x9f" for c in o):
                    rows.append((w, n, k, o))
        yield pd.DataFrame(rows, columns=["word", "n", "pair", "original"]).astype({"n": "int64", "pair": "int32"})


def _core(word):
    """A word without ASCII marks at its ends."""
    return F.regexp_replace(word, r"^[\x00-/:-@\[-`{-~]+|[\x00-/:-@\[-`{-~]+$", "")


def _odd(word):
    """Whether a word is spelt as in no language: a sign among letters, a capital behind a small letter, two scripts side by side, or Latin letters none of which is ASCII."""
    sign = r"[^\x00-\x7f\p{L}\p{M}‘’“”„‚«»‹›‐‑–—―…·•]"
    mixed = rf"\p{{L}}{sign}|{sign}\p{{L}}|[\p{{Ll}}&&[^a-z]]\p{{Lu}}|\p{{Ll}}[\p{{Lu}}&&[^A-Z]]|\p{{IsLatin}}[\p{{IsCyrillic}}\p{{IsGreek}}]|[\p{{IsCyrillic}}\p{{IsGreek}}]\p{{IsLatin}}"
    return word.rlike(mixed) | word.rlike(r"^[^A-Za-z]*(?:[\p{IsLatin}&&[^A-Za-z]][^A-Za-z]*){3}$")


def restored(docs: DataFrame, *, id_col="doc_id", text_col="text", ratio=4, least=3) -> DataFrame:
    """``(id, fixed, lost)`` of the documents that hold wrongly decoded characters.

    ``ratio``: so many times as often as a garbled word its original must occur in all
    documents, and ``least`` times at least; an oddly spelt word may occur ``ratio * ratio``
    times as often as its original.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").where(F.col("text").rlike(r"[^\x00-\x7f]")).dropDuplicates(["id"])
    # Written once, as its words are read several times.
    multi = materialize(src.mapInPandas(_multi, "id bigint, fixed string, spans int, lost boolean"), "multi")

    # Words of all documents, as they read after the first repair.
    parts = multi.select("id", "spans", F.explode(F.array_distinct(F.regexp_extract_all("fixed", F.lit(r"\S*[^\x00-\x7f\s]\S*"), F.lit(0)))).alias("w")).select("id", _core(F.col("w")).alias("word")).where("word <> ''")
    parts = materialize(parts, "words")
    counts = parts.groupBy("word").agg(F.count("*").alias("n"))
    pairs = counts.mapInPandas(_originals, "word string, n bigint, pair int, original string")
    known = counts.select(F.col("word").alias("original"), F.col("n").alias("known"))
    bad = pairs.join(known, "original", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    # An oddly spelt word with a plain original may be frequent itself, as where a whole source is garbled.
    has, odd = F.col("known") >= least, _odd(F.col("word")) & ~_odd(F.col("original"))
    sure = has & ((F.col("known") >= ratio * F.col("n")) | (odd & (ratio * ratio * F.col("known") >= F.col("n"))))
    letters = F.col("word").rlike(r"[\p{L}\p{N}]")
    undone = _odd(F.col("original")) & ~_odd(F.col("word"))
    leans, against = has & (2 * F.col("known") >= 3 * F.col("n")) & letters & ~undone, (F.col("n") >= least) & ((F.col("n") > F.col("known")) | undone) & letters
    bad = bad.select("word", "pair", "original", "n", "known", sure.alias("sure"), (sure & letters).alias("speaks"), leans.alias("leans"), against.alias("against"))
    bad = materialize(bad, "originals")
    seen = parts.join(bad.where(F.col("sure") | F.col("leans") | (F.col("n") < least) | (has & (ratio * F.col("known") >= F.col("n")))), "word")
    votes = seen.groupBy("id", "pair").agg(F.count_if("speaks").alias("votes"), F.count_if("leans").alias("leaning"), F.sum(F.when(F.col("sure"), F.col("known")).otherwise(0)).alias("weight"))
    votes = materialize(votes.where((F.col("votes") > 0) | (F.col("leaning") >= least)), "votes")
    # Where no word is sure, several that lean to their originals tell together, if hardly one of the text leans back.
    mild = votes.where(F.col("votes") == 0)
    back = parts.join(mild.select("id", "pair"), "id").join(bad.where("against").select("word", "pair"), ["word", "pair"]).groupBy("id", "pair").agg(F.count("*").alias("back"))
    mild = mild.join(back, ["id", "pair"], "left").where(F.col("leaning") >= 4 * F.coalesce("back", F.lit(0))).drop("back")
    votes = votes.where("votes > 0").unionByName(mild)
    # Of a text's pairs of encodings the one that most of its words speak for. A mark alone (no letter, no digit) doesn't.
    votes = votes.groupBy("id").agg(F.max(F.struct("votes", "weight", "leaning", (-F.col("pair")).alias("p"))).alias("v")).select("id", (-F.col("v.p")).alias("pair"), "v.votes")
    mine = seen.join(votes, ["id", "pair"]).where(F.col("sure") | (F.col("votes") >= 3) | (F.col("votes") == 0))
    hits = mine.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "original"))).alias("words"))
    all_ = multi.join(hits, "id", "left").where((F.col("spans") > 0) | F.col("lost") | F.col("words").isNotNull())
    # Whole blank-separated words are replaced, marks at their ends kept.
    tokens = F.split("fixed", r"(?<=\s)|(?=\s)")
    swapped = F.array_join(F.transform(tokens, lambda t: F.when(F.col("words")[_core(t)].isNotNull(), F.replace(t, _core(t), F.col("words")[_core(t)])).otherwise(t)), "")
    return all_.select("id", F.when(F.col("words").isNull(), F.col("fixed")).otherwise(swapped).alias("fixed"), "lost")


def found(docs: DataFrame, **kw) -> DataFrame:
    """``(doc_id, fixed_len)``: code points of the restored text, -1 where characters are lost."""
    r = restored(docs, **kw)
    return r.select(F.col("id").alias("doc_id"), F.when(F.col("lost"), F.lit(-1)).otherwise(F.length("fixed")).cast("bigint").alias("fixed_len"))
