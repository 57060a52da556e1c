"""Token estimators.

T2 (characters // 4) and T3 (words + characters // 4) are Catalyst
expressions. T1 (BPE) is the one Python piece: an Arrow-batched pandas UDF
with the encoder built once per Python worker, never per row.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context.functions.util import col_of

# Python str.split() whitespace: Unicode White_Space plus the four separators \x1c-\x1f.
_WS = r"(?U)[\s\x1c-\x1f]+"


def tokens_chars4(text) -> Column:
    """len(text) // 4 (code points)."""
    return F.floor(F.char_length(col_of(text)) / 4).cast("long")


def word_count(text) -> Column:
    return F.size(F.filter(F.split(col_of(text), _WS), lambda x: x != "")).cast("long")


def tokens_words_chars4(text) -> Column:
    """Whitespace-separated words + len(text) // 4."""
    return word_count(text) + tokens_chars4(text)


ESTIMATORS: dict[str, Callable[[Column], Column]] = {
    "chars4": tokens_chars4,
    "words_chars4": tokens_words_chars4,
}


def estimator(name_or_fn) -> Callable[[Column], Column]:
    if callable(name_or_fn):
        return name_or_fn
    return ESTIMATORS[name_or_fn]


_ENCODERS: dict = {}


def _cached_encoder(factory):
    key = id(factory)
    enc = _ENCODERS.get(key)
    if enc is None:
        enc = factory()
        _ENCODERS[key] = enc
    return enc


def tokens_bpe(encoder_factory: Callable[[], object]) -> Callable[[Column], Column]:
    """BPE token count, as a column function.

    ``encoder_factory()`` must return an object with ``encode(text, disallowed_special=())``
    (tiktoken's interface); it is called once per Python worker. Empty text or a
    failing encode counts 0; special-token text is encoded as ordinary text.
    """

    @F.pandas_udf(T.LongType())
    def _count(texts: pd.Series) -> pd.Series:
        enc = _cached_encoder(encoder_factory)
        out = []
        for t in texts:
            if t is None or t == "":
                out.append(0)
                continue
            try:
                out.append(len(enc.encode(t, disallowed_special=())))
            except Exception:
                out.append(0)
        return pd.Series(out, dtype="int64")

    return lambda text: _count(col_of(text))


def cl100k_factory():
    """tiktoken's cl100k_base; needs its vocabulary file on the executors."""
    import tiktoken

    return tiktoken.get_encoding("cl100k_base")
