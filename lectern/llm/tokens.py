"""Text sizes in tokens of a public tokenizer.

``path`` names a rank file (one base64 token and its number in each line) of a byte-level
BPE; the file is read by each Python worker and never copied. Null texts have no size and
empty ones have 0 tokens.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer cuts text before merging.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blanks of so long a run are encoded by themselves: the library's pattern search can't take back that many.
RUN = 5_000
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def length(text: str, path: str = DEFAULT) -> int:
    """Tokens of the whole text.

    A text is cut beside very long runs of blanks only, where the tokenizer cuts it too:
    before the run, and before its last blank, which belongs to what follows.
    """
    enc, total, at = encoder(path), 0, 0
    for m in re.finditer(_BLANK + "{%d,}" % RUN, text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(enc.encode_ordinary(text[at:]))


def count(text: Column, path: str = DEFAULT) -> Column:
    def sizes(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else length(t, path) for t in texts], dtype="Int64")

    return F.pandas_udf(sizes, "bigint")(text)
