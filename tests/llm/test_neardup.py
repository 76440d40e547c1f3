import random
import re
from collections import Counter

import pytest

from lectern.llm import neardup as N


def brute(rows, t=0.8):
    bags = [(i, Counter(re.findall("[a-z0-9]+", re.sub(r"^\[[^\]\n]*\] ", "", x).lower()))) for i, x in sorted(set(rows))]
    out = set()
    for a in range(len(bags)):
        for b in range(a):
            (i, x), (j, y) = bags[a], bags[b]
            union = sum((x | y).values())
            if union and sum((x & y).values()) >= t * union - 1e-12:
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("seed,threshold", [(1, 0.8), (2, 0.8), (3, 0.6), (4, 0.9)])
def test_no_pair_is_lost(spark, seed, threshold):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "the"]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 20, 45, 90]))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 5))):
                k = rng.random()
                if k < 0.4 and t:
                    t.pop(rng.randrange(len(t)))
                elif k < 0.8:
                    t.insert(rng.randint(0, len(t)), rng.choice(words))
                else:
                    rng.shuffle(t)
            texts.append("[Title x] " + " ".join(t))
    rows = [(f"c{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:5]], "chunk_id string, content string, bag int")
    got = [tuple(r) for r in N.pairs(df, threshold=threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_nulls_copies_and_long(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [("a", None), ("b", ""), ("c", "  . "), ("d", "same text"), ("e", "Same, text!"), ("f", "[T] same text"), ("g", long), ("h", long + " more"), (None, "same text")]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    assert {tuple(r) for r in N.pairs(df).collect()} == {("d", "e"), ("d", "f"), ("e", "f"), ("g", "h")}
    c = {r.id: (r.class_id, r.copies, r.links) for r in N.classes(df).collect()}
    assert c == {"d": ("d", 3, 0), "e": ("d", 3, 0), "f": ("d", 3, 0), "g": ("g", 1, 1), "h": ("h", 1, 1)}
    assert N.pairs(df.limit(0)).count() == 0
