"""Hooks for models: text to vectors, prompts to replies.

A model is a plain function on a list of texts. It is wrapped as a function of columns,
called on Arrow batches in the tasks, never with more than ``batch`` texts at once; one
call runs at a time in a task, so the number of partitions bounds the calls.

Defined results: a null text gives a null vector or reply and is not shown to the model; a
model that fails on a batch of prompts gives null replies for it (who asks has another way),
while a failing embedder fails the job; no model is brought along but ``hashed``.
"""

from __future__ import annotations

import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What embedding models of this family are told about a text.
PREFIX = {"document": "search_document: ", "query": "search_query: "}
EMBED_BATCH = 32


def embed_input(text: Column, kind: str = "document") -> Column:
    return F.concat(F.lit(PREFIX[kind]), text)


def hashed(dim: int = 64):
    """An embedder without a model: signed hashing of words, of length 1 (all 0 for a text without words). For tests and for running offline."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % dim] += 1 if h & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    return run


def _in_batches(texts: pd.Series, batch: int, call) -> pd.Series:
    out = pd.Series([None] * len(texts), dtype=object)
    there = np.flatnonzero(texts.notna().to_numpy())
    for i in range(0, len(there), batch):
        at = there[i : i + batch]
        for k, v in zip(at, call([texts.iloc[j] for j in at])):
            out.iloc[k] = v
    return out


def embedder(model, *, kind: str = "document", batch: int = EMBED_BATCH):
    """``model(texts) -> vectors`` as a function of a text column; the kind's prefix is put in front."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield _in_batches(texts, batch, model)

    udf = F.pandas_udf(run, "array<float>")
    return lambda text: udf(embed_input(text, kind))


def generator(model, *, batch: int = 1):
    """``model(prompts) -> replies`` as a function of a prompt column; a reply of None counts as empty."""

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            return [r or "" for r in model(prompts)]
        except Exception:  # noqa: BLE001 - one failing call must not fail the job
            return [None] * len(prompts)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield _in_batches(prompts, batch, ask)

    return F.pandas_udf(run, "string")


def messages(system: Column, user: Column, history: Column | None = None) -> Column:
    """An array of ``(role, content)``: the instruction, the turns before if any, and the question."""
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    before = F.array().cast("array<struct<role:string,content:string>>") if history is None else F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(one("system", system), before, one("user", user))
