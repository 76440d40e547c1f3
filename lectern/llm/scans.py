"""Text of scanned pages: divided words, misread characters, page furniture, reflow.

Candidates for a word that is not in the vocabulary come from the intersection of the
Levenshtein automaton of the word (one edit: a character or a pair for another, one
more, one less) with the trie of the vocabulary, so none is missed. An edit counts as a
misreading only if the two shapes are alike (``SHAPES``); letters swapped, lost or added
by editors are left as they are. Among several candidates the record's own other words
decide (context), then fewer changed characters, then the alphabet.

Words divided at a line end or blank are joined if the vocabulary has the whole word,
with its own hyphen where it has one. First lines that stand on at least ``pages`` pages
of their document (digits aside) are headers; this count is a Spark aggregate over
(document, line), so a document with any number of pages is no single group. First and
last lines that hold only a page number are page numbers. The repaired text has none of
these and its lines are joined into paragraphs; tables, list items and blank lines keep
their line ends.

The vocabulary is a fixed list (``MAX_WORDS`` at most) that every task holds as a trie.

Defined results: null and empty texts have no defects and stay as they are; a repeated
row counts once; a record with several different texts is looked at in each; words with
fewer than five letters are not corrected; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 200_000
#: Into so many parts the pages of a document are spread where they meet its headers.
SPREAD = 32

#: Fixed values: (right, misread) of similar shape, one character or pair for another.
SHAPES = frozenset(
    {
        ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("o", "0"), ("t", "f"), ("f", "t"), ("i", "1"), ("i", "l"), ("l", "i"), ("l", "1"), ("s", "5"), ("g", "9"), ("g", "q"), ("q", "g"), ("b", "6"), ("b", "8"), ("z", "2"), ("i", "!"), ("l", "|"), ("i", "|"), ("l", "!"), ("s", "8"), ("a", "@"), ("s", "$"), ("c", "("), ("e", "€"), ("u", "v"), ("v", "u"), ("h", "b"), ("b", "h"), ("i", "j"), ("j", "i"),
        ("d", "cl"), ("cl", "d"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("ii", "u"), ("h", "li"), ("li", "h"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("vv", "w"), ("k", "lc"), ("lc", "k"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("n", "ii"), ("m", "nn"), ("nn", "m"), ("in", "m"), ("m", "in"),
    }
)

_TITLE = re.compile(r"^\[[^\]\n]*\] ")
_DIVIDED = re.compile(r"([A-Za-z0-9ﬀ-ﬆ]+(?:-[A-Za-z0-9ﬀ-ﬆ]+)*)([-¬­‐‑])(\s+)(?=([A-Za-z0-9ﬀ-ﬆ]+(?:-[A-Za-z0-9ﬀ-ﬆ]+)*))")
_TOKEN = re.compile(r"[A-Za-z0-9ﬀ-ﬆ!|@$€]+(?:-[A-Za-z0-9ﬀ-ﬆ!|@$€]+)*")
PAGE_NUMBER = r"^\s*(?:[-–—]\s*\d+\s*[-–—]|(?:page|pages|p\.|pg\.?)\s*\d+(?:\s*(?:/|of)\s*\d+)?|\d+(?:\s*(?:/|of)\s*\d+)?)\s*$"
_PAGE = re.compile(PAGE_NUMBER, re.I)
_KEEP_LINE = re.compile(r"^\s*(?:\||\d+\.\s|[-*•]\s|Table \d)|\S {3,}\S")


class Trie:
    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within_one(self, word: str):
        """All (vocabulary word, right piece, seen piece) that one edit turns into ``word``.

        The automaton's states are positions in ``word`` before the edit, and after it;
        its edits put one or two characters for one or two, add one or leave one out.
        """
        out, n = set(), len(word)

        def rest(node, at):  # after the edit only the word's own characters may follow
            while at < n:
                node = node.get(word[at])
                if node is None:
                    return None
                at += 1
            return node.get("")

        def walk(node, at):
            for c, child in node.items():
                if c == "":
                    if at == n - 1:
                        out.add((child, "", word[at]))
                    continue
                for right, after in ((c, child), *((c + c2, g) for c2, g in child.items() if c2)):
                    for k in (0, 1, 2):
                        if at + k <= n and (len(right) == 1 or k):
                            seen = word[at : at + k]
                            if seen != right and (len(right), k) != (2, 2) and (k < 2 or seen[0] != right) and (len(right) < 2 or seen != right[0]):
                                w = rest(after, at + k)
                                if w:
                                    out.add((w, right, seen))
                if at < n and word[at] == c:
                    walk(child, at + 1)
            if at < n:
                w = rest(node, at + 1)
                if w:
                    out.add((w, "", word[at]))

        walk(self.root, 0)
        return out


class Reader:
    """Finds the defects of one text; the memo keeps what was looked up before."""

    def __init__(self, words):
        self.words = frozenset(words)
        self.trie = Trie(w for w in self.words if sum(map(str.isalpha, w)) >= 5)
        self.memo: dict[str, tuple] = {}

    def candidates(self, token: str) -> tuple:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = {(w, len(a) + len(b)) for w, a, b in self.trie.within_one(token) if (a, b) in SHAPES}
            got = self.memo[token] = tuple(sorted(found, key=lambda x: (x[1], x[0])))
        return got

    def best(self, token: str, text: str) -> str | None:
        c = self.candidates(token)
        if len({w for w, _ in c}) > 1:
            low = text.lower()
            c = sorted(c, key=lambda x: (-len(re.findall(r"(?<!\w)" + re.escape(x[0]) + r"(?!\w)", low)), x[1], x[0]))
        return c[0][0] if c else None

    def _whole(self, *pieces: str) -> str | None:
        low = [p.lower() for p in pieces]
        for glue in ("", "-"):
            if glue.join(low) in self.words:
                return glue.join(low)
        return None

    def divided(self, text: str):
        """(start, end, whole word) of divided words."""
        at = 0
        while m := _DIVIDED.search(text, at):
            a, b = m.group(1), m.group(4)
            end = m.end() + len(b)
            w = self._whole(a, b)
            if w is None:
                m2 = _DIVIDED.match(text, m.end())
                if m2:
                    for ab in (a + b, a + "-" + b):
                        w = w or self._whole(ab, m2.group(4))
                    end = m2.end() + len(m2.group(4)) if w else end
            if w:
                yield m.start(), end, w
            at = end if w else m.end()

    def misread(self, text: str):
        """(start, end, right word) of misread words; ``text`` has no divided ones."""
        for m in _TOKEN.finditer(text):
            t = m.group().lower()
            if t in self.words or len(t) < 4 or t.isdigit():
                continue
            w = self.best(t, text)
            if w:
                yield m.start(), m.end(), w
            elif "-" in t:
                at = m.start()
                for part in t.split("-"):
                    if len(part) >= 4 and part not in self.words and (w := self.best(part, text)):
                        yield at, at + len(part), w
                    at += len(part) + 1

    def joined(self, text: str):
        """Text with divided words joined, and those words."""
        out, at, words = [], 0, []
        for a, b, w in self.divided(text):
            shown = w.capitalize() if text[a].isupper() and not text[a : a + 2].isupper() else w.upper() if text[a:b].isupper() else w
            # A line end inside the word moves behind it.
            out += [text[at:a], shown, "\n" if "\n" in text[a:b] else ""]
            words.append(w)
            at = b
        return "".join([*out, text[at:]]), words

    def defects(self, text: str) -> set:
        body = _TITLE.sub("", text, count=1)
        whole, words = self.joined(body)
        found = {("hyphen", w) for w in words} | {("char", w) for *_, w in self.misread(whole)}
        lines = body.strip("\n").split("\n")
        found |= {("pageno", x.strip()) for x in (lines[0], lines[-1]) if _PAGE.match(x)}
        return found

    def repair(self, text: str, header: str | None) -> str:
        m = _TITLE.match(text)
        title, body = (m.group(), text[m.end() :]) if m else ("", text)
        lines = body.strip("\n").split("\n")
        if header is not None and lines and lines[0].strip() == header:
            lines = lines[1:]
        if lines and _PAGE.match(lines[0]):
            lines = lines[1:]
        if lines and _PAGE.match(lines[-1]):
            lines = lines[:-1]
        body, _ = self.joined("\n".join(lines))
        out, at = [], 0
        for a, b, w in self.misread(body):
            shown = w.upper() if body[a:b].isupper() and not body[a:b].isdigit() and sum(map(str.isalpha, body[a:b])) > 1 else w.capitalize() if body[a].isupper() else w
            out += [body[at:a], shown]
            at = b
        body = "".join([*out, body[at:]])
        flow = ""
        for line in body.split("\n"):
            line = line.rstrip()
            keep = not line.strip() or _KEEP_LINE.search(line)
            if flow and not flow.endswith("\n") and not keep and not _KEEP_LINE.search(flow.rsplit("\n", 1)[-1]):
                flow += " " + line.lstrip()
            else:
                flow += ("\n" if flow else "") + line
        return title + flow.rstrip("\n")


def vocabulary(lexicon: DataFrame) -> list[str]:
    words = [r[0] for r in lexicon.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        raise ValueError("the vocabulary is larger than a task may hold")
    return words


def records(store: DataFrame, ingest: DataFrame) -> DataFrame:
    """``(tbl, rec_key, text)`` of text and image chunks and of captions, repeats once."""
    chunks = store.where("chunk_index >= 0 or chunk_type = 'image'").select(F.lit("store").alias("tbl"), F.col("chunk_id").alias("rec_key"), F.col("content").alias("text"))
    captions = ingest.select(F.lit("ingest").alias("tbl"), F.col("vec_id").cast("string").alias("rec_key"), F.col("caption").alias("text"))
    return chunks.unionAll(captions).where("rec_key is not null and text is not null")


def headers(store: DataFrame, pages: int = 3) -> DataFrame:
    """``(chunk_id, header)``: first lines of text chunks that stand on at least ``pages`` pages of the document."""
    body = F.regexp_replace("content", r"^\[[^\]\n]*\] ", "")
    line = F.trim(F.regexp_replace(F.substring_index(F.regexp_replace(body, r"^\n+", ""), "\n", 1), r"\s+", " "))
    raw = F.trim(F.substring_index(F.regexp_replace(body, r"^\n+", ""), "\n", 1))
    first = store.where("chunk_index >= 0 and chunk_type is null and doc_id is not null").select("chunk_id", "doc_id", "page", raw.alias("header"), F.xxhash64(F.regexp_replace(line, r"\d+", "0")).alias("k"))
    first = first.where((F.col("header") != "") & ~F.col("header").rlike("(?i)" + PAGE_NUMBER))
    often = first.select("doc_id", "k", "page").distinct().groupBy("doc_id", "k").agg(F.count("page").alias("n")).where(F.col("n") >= pages)
    # A document's pages are spread, its few headers repeated for each part of them.
    first = first.withColumn("s", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)))
    often = often.select("doc_id", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).alias("s"))
    return first.join(often, ["doc_id", "k", "s"]).select("chunk_id", "header").distinct()


def _defects(words):
    def run(batches):
        r = Reader(words)
        for pdf in batches:
            rows = [(t, k, d, f) for t, k, x in zip(pdf["tbl"], pdf["rec_key"], pdf["text"]) for d, f in r.defects(x)]
            yield pd.DataFrame(rows, columns=["tbl", "rec_key", "defect", "fixed"])

    return run


def _repair(words):
    def run(batches):
        r = Reader(words)
        for pdf in batches:
            yield pd.DataFrame({"tbl": pdf["tbl"], "rec_key": pdf["rec_key"], "text": [r.repair(x, h) for x, h in zip(pdf["text"], pdf["header"])]})

    return run


def found(store: DataFrame, ingest: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(tbl, rec_key, defect, fixed)``: one row for each distinct defect."""
    words = vocabulary(lexicon)
    inside = records(store, ingest).mapInPandas(_defects(words), "tbl string, rec_key string, defect string, fixed string")
    heads = headers(store).select(F.lit("store").alias("tbl"), F.col("chunk_id").alias("rec_key"), F.lit("header").alias("defect"), F.col("header").alias("fixed"))
    return inside.unionAll(heads).distinct()


def repaired(store: DataFrame, ingest: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(tbl, rec_key, text)``: the records as continuous paragraphs."""
    words = vocabulary(lexicon)
    head = headers(store).groupBy(F.lit("store").alias("tbl"), F.col("chunk_id").alias("rec_key")).agg(F.min("header").alias("header"))
    rec = records(store, ingest).dropDuplicates(["tbl", "rec_key"]).join(head, ["tbl", "rec_key"], "left").select("tbl", "rec_key", "text", "header")
    return rec.mapInPandas(_repair(words), "tbl string, rec_key string, text string")
