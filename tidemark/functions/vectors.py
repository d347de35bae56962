"""Vectors as arrays of numbers: native higher-order functions in DOUBLE, in a fixed order of summation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .sites import _col
from .text import once


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column | str) -> Column:
    """Unit length; null if the length is under 1e-12."""
    # the length is taken once: inside the inner function it would be taken for each component
    return once(norm(v), lambda n: F.when(n >= 1e-12, F.transform(doubles(v), lambda x: x / n)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(normalize(a), normalize(b))


def valid(v: Column | str, dimensions: int) -> Column:
    """Of the given size, all components finite."""
    fine = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(_col(v)) == dimensions) & fine, F.lit(False))


def mix(title: Column | str, query: Column | str, title_weight: float = DEFAULTS.title_weight, query_weight: float = DEFAULTS.query_weight) -> Column:
    """Weighted sum of both, of unit length; if one is missing, the other."""
    both = normalize(F.zip_with(doubles(title), doubles(query), lambda t, q: title_weight * t + query_weight * q))
    return F.when(_col(query).isNull(), doubles(title)).when(_col(title).isNull(), doubles(query)).otherwise(both)


def facet_bonus(best: Column | str, most: float = DEFAULTS.facet_bonus) -> Column:
    """Bonus of the best facet's cosine."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_col(best), F.lit(0.0)))) * most


def quantize(v: Column | str) -> Column:
    """struct(scale, q): symmetric 8-bit quantisation of a row, halves to even; a zero row has scale 1."""
    top = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(doubles(v), lambda x: F.rint(x / scale).cast("int")).alias("q"))


def dequantize(quantized: Column | str) -> Column:
    q = _col(quantized)
    return F.transform(q["q"], lambda x: x * q["scale"])


def encoder(encode: Callable[[list[str]], list[list[float] | None]]) -> Callable[[Column | str], Column]:
    """A column function from any batch encoder of texts; weights are the caller's."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(encode(s.fillna("").tolist()))

    return lambda c: run(_col(c))


def static_encoder(vocabulary: dict[str, int], weights: object, scales: object, most: int = 1024) -> Callable[[Column | str], Column]:
    """Sum of quantised rows of a text's tokens (at most ``most``), of unit length; null for a text without known tokens."""
    import re

    import numpy as np

    rows, size = np.asarray(weights), np.asarray(scales, np.float64)

    def run(texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            ids = [vocabulary[w] for w in re.findall(r"[^\W_]+", t.lower()) if w in vocabulary][:most]
            total = (rows[ids].astype(np.float64) * size[ids][:, None]).sum(0) if ids else None
            length = None if total is None else float(np.sqrt((total**2).sum()))
            out.append((total / length).tolist() if length and length >= 1e-12 else None)
        return out

    return encoder(run)
