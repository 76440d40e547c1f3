import random

import pytest

from lectern.llm import scans as S

WORDS = ["bracket", "heat-resistant", "connector", "filter", "governor", "clamp", "the", "in-line", "terminal", "corner", "modified"]


def close(a, b):
    """Whether one edit (one or two characters for one or two, or added, or left out) turns a into b."""
    return any(a[:i] + x + a[i + n :] == b for i in range(len(a) + 1) for n in (0, 1, 2) for k in (0, 1, 2) if (n, k) not in ((2, 2), (0, 0), (0, 2), (2, 0)) and i + n <= len(a) for x in [b[i : i + k]] if len(x) == k)


def test_candidates_are_complete():
    rng, trie = random.Random(1), S.Trie(WORDS)
    for w in WORDS:
        for _ in range(60):
            t = list(w)
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 2)] = rng.choice(["", "x", "rn", "l", "c"])
            t = "".join(t)
            found = {c for c, *_ in trie.within_one(t)} | ({t} & set(WORDS))
            assert {v for v in WORDS if v != t and close(v, t)} <= found | {t}, t
            assert all(close(v, t) for v in found)


@pytest.mark.parametrize("text,want", [
    ("[T] the brac-\nket", {("hyphen", "bracket")}), ("heat-\nresistant", {("hyphen", "heat-resistant")}), ("term- inal", {("hyphen", "terminal")}), ("in¬\nline clam­\np", {("hyphen", "in-line"), ("hyphen", "clamp")}),
    ("a g0vernor", {("char", "governor")}), ("conriector", {("char", "connector")}), ("FI1TER", {("char", "filter")}), ("modiﬁed", {("char", "modified")}), ("damp", {("char", "clamp")}), ("heat-resisfant", {("char", "heat-resistant")}),
    ("govrenor goveror", set()), ("text\n- 12 -", {("pageno", "- 12 -")}), ("Page 3\ntext", {("pageno", "Page 3")}), ("x\n p. 9 / 14", {("pageno", "p. 9 / 14")}), ("12 bar", set()), ("", set()),
])
def test_defects(text, want):
    assert S.Reader(WORDS).defects(text) == want


def test_repair():
    r = S.Reader(WORDS)
    assert r.repair("[T] HEAD 1\nthe g0vernor in the brac-\nket stays\nclamp\n\n| a | b |\n| 1 | 2 |\n- 4 -", "HEAD 1") == "[T] the governor in the bracket stays clamp\n\n| a | b |\n| 1 | 2 |"


def test_headers_and_tables(spark):
    schema = "chunk_id string, doc_id string, page int, chunk_index int, chunk_type string, content string, tbl int"
    rows = [(f"d_{p}_0", "d", p, 0, None, f"[T] Manual {p}\nbody", 1) for p in range(1, 4)] + [(f"e_{p}_0", "e", p, 0, None, "[T] Rare\nx", 1) for p in (1, 2)] + [(f"f_{p}_0", "f", p, 0, None, f"{p}\nx", 1) for p in range(1, 5)]
    rows += [("d_1_-1", "d", 1, -1, None, "[T] the g0vernor", 1), ("d_1_-100", "d", 1, -100, "image", "the g0vernor", 1), ("n", None, None, 0, None, None, 1)]
    store = spark.createDataFrame(rows + rows[:2], schema)
    ing = spark.createDataFrame([(1, "brac-\nket"), (2, None)], "vec_id long, caption string")
    lex = spark.createDataFrame([(w,) for w in [*WORDS, None]], "word string")
    got = {tuple(r) for r in S.found(store, ing, lex).collect()}
    assert {g for g in got if g[2] == "header"} == {("store", f"d_{p}_0", "header", f"Manual {p}") for p in range(1, 4)}
    assert {g for g in got if g[2] in ("char", "hyphen")} == {("store", "d_1_-100", "char", "governor"), ("ingest", "1", "hyphen", "bracket")}
    assert len([g for g in got if g[2] == "pageno"]) == 4
    fixed = {(r.tbl, r.rec_key): r.text for r in S.repaired(store, ing, lex).collect()}
    assert fixed[("store", "d_1_0")] == "[T] body" and fixed[("ingest", "1")] == "bracket" and len(fixed) == 11
    assert S.found(store.limit(0), ing.limit(0), lex).count() == 0
