"""Perceptual hash of grey frames, and the balanced JSON span: the two functions that SQL can't express."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEPT = 32, 8


def _basis(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


_DCT = _basis(SIDE)[:KEPT]


def phash(frame) -> int | None:
    """64 bits of a 32 x 32 grey frame: which low-frequency DCT terms exceed their median. Signed."""
    if frame is None or len(frame) != SIDE * SIDE:
        return None
    low = _DCT @ np.asarray(frame, float).reshape(SIDE, SIDE) @ _DCT.T
    bits = (low > np.median(low)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def phash_column(frames: pd.Series) -> pd.Series:
    return pd.Series([phash(f) for f in frames], dtype="Int64")


def balanced(text: str | None) -> str | None:
    """The text if it is JSON, else its first span of balanced braces (quotes don't matter) if that is."""
    if not text:
        return None
    depth, start = 0, text.find("{")
    span = None
    for i in range(max(start, 0), len(text)) if start >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            span = text[start : i + 1]
            break
    for candidate in (text, span):
        try:
            json.loads(candidate)
            return candidate
        except (TypeError, ValueError):
            continue
    return None


@F.pandas_udf(T.StringType())
def balanced_column(text: pd.Series) -> pd.Series:
    return text.map(balanced)
