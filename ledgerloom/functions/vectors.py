"""Vectors as arrays of floats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """Unit length, as floats; an error where the length is zero or no number."""
    n = norm(a)
    good = F.when((n > 0) & ~F.isnan(n), n).otherwise(F.raise_error(F.lit("vector without length")).cast("double"))
    return F.transform(a, lambda x: (x.cast("double") / good).cast("float"))


def encode(text: Column, encoder: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 64) -> Column:
    """Unit vectors of texts behind a model's prefix, encoded in batches inside the tasks; null for null and blank texts."""

    def each(s: pd.Series) -> pd.Series:
        out: list = [None] * len(s)
        full = [i for i, t in enumerate(s) if t is not None and t.strip()]
        for at in range(0, len(full), batch):
            part = full[at : at + batch]
            found = np.asarray(encoder([prefix + s.iloc[k] for k in part]), np.float64)
            lengths = np.linalg.norm(found, axis=1, keepdims=True)
            if not (lengths > 0).all():
                raise ValueError("vector without length")
            for i, v in zip(part, found / lengths, strict=True):
                out[i] = v.astype(np.float32)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "array<float>")(text)
