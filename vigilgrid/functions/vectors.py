"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

PROJECTION_SEED = 42


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def with_each(v: Column, shared: Column, combine) -> Column:
    """Combine every element with one per-row value.

    A value used inside a lambda is computed again for each element; repeated into an array first,
    it is computed once per row.
    """
    return F.zip_with(v, F.array_repeat(shared, F.size(v)), combine)


def normalise(v: Column) -> Column:
    """Unit vector; null for the zero vector."""
    length = norm(v)
    return F.when(length > 0, with_each(as_double(v), length, lambda x, n: x / n))


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def is_valid(v: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """Right length, no NaN or infinity, unit norm within the tolerance."""
    finite = ~F.exists(as_double(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) == dim) & finite & (F.abs(norm(v) - 1.0) <= tolerance)


def softmax(values: Column) -> Column:
    """Softmax with the maximum subtracted first."""
    powers = with_each(values, F.array_max(values), lambda x, top: F.exp(x - top))
    return with_each(powers, F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x), lambda x, total: x / total)


def orthogonal_projection(source_dim: int, target_dim: int, seed: int = PROJECTION_SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((source_dim, target_dim)).astype(np.float32))
    return q


def project(source_dim: int, target_dim: int, seed: int = PROJECTION_SEED):
    """Pandas UDF projecting vectors to a lower dimension and renormalising them.

    The matrix depends only on the two dimensions, so it ships inside the task closure.
    """
    matrix = orthogonal_projection(source_dim, target_dim, seed)

    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        block = np.stack(vectors.to_numpy()).astype(np.float64) @ matrix.astype(np.float64)
        lengths = np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-6)
        return pd.Series(list((block / lengths).astype(np.float32)))

    return run


def embedder(encode: Callable[[list[str]], np.ndarray]):
    """Iterator pandas UDF around any batch encoder (a model, or the hashing double below)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = encode(batch.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors], index=batch.index)

    return run


def hashing_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a model: a unit Gaussian vector seeded by the content hash."""
    import hashlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(dim)
            out[i] = v / np.linalg.norm(v)
        return out

    return encode
