"""Folds over ordered rows, run chunk by chunk with ``chunk_fixpoint``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilgrid.operators.greedy import chunk_fixpoint
from vigilgrid.operators.ordered import CHUNK


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [T.StructField(n, kinds[n]) for n in names]


def drop_near_duplicates(df: DataFrame, keys: Sequence[str], order: str, sketch: str, chunk: Column,
                         distance: int = 4, window: int = 300) -> DataFrame:
    """Keep a row unless its 64-bit sketch is within ``distance`` bits of one of the key's last
    ``window`` kept rows. Returns ``keys, order`` of kept rows."""
    keys = list(keys)
    rows = df.select(*keys, order, sketch).withColumn(CHUNK, chunk)
    schema = T.StructType(_fields(rows, keys + [order]))

    def fold(pdf: pd.DataFrame, state: bytes | None):
        pdf = pdf.sort_values(order)
        values = pdf[sketch].to_numpy(np.int64)
        before = np.frombuffer(state or b"", dtype=np.int64)
        kept = np.empty(len(before) + len(values), dtype=np.int64)
        kept[:len(before)] = before
        n, flags = len(before), np.zeros(len(values), dtype=bool)
        for i, v in enumerate(values):
            recent = kept[max(0, n - window):n]
            if not (np.bitwise_count((recent ^ v).view(np.uint64)) <= distance).any():
                kept[n] = v
                n += 1
                flags[i] = True
        return pdf.loc[flags, schema.names], kept[max(0, n - window):n].tobytes()

    return chunk_fixpoint(rows, keys, CHUNK, fold, schema)


def keyframes(df: DataFrame, keys: Sequence[str], order: str, vector: str, chunk: Column,
              limit: float = 0.95) -> DataFrame:
    """Keep a frame when its similarity to the last kept one is below ``limit``.

    Returns ``keys, order, motion`` of kept frames; motion is 1 - similarity, 0 for the first.
    """
    keys = list(keys)
    rows = df.select(*keys, order, F.col(vector).cast("array<double>").alias("_v")).withColumn(CHUNK, chunk)
    schema = T.StructType(_fields(rows, keys + [order]) + [T.StructField("motion", T.DoubleType())])

    def fold(pdf: pd.DataFrame, state: bytes | None):
        pdf = pdf.sort_values(order)
        last = np.frombuffer(state, dtype=np.float64) if state else None
        flags, motion = [], []
        for v in pdf["_v"]:
            v = np.asarray(v, dtype=np.float64)
            sim = None if last is None else float(v @ last / (np.linalg.norm(v) * np.linalg.norm(last)))
            keep = sim is None or sim < limit
            flags.append(keep)
            if keep:
                motion.append(0.0 if sim is None else 1.0 - sim)
                last = v
        out = pdf.loc[np.array(flags, dtype=bool), keys + [order]].assign(motion=motion)
        return out, b"" if last is None else last.tobytes()

    return chunk_fixpoint(rows, keys, CHUNK, fold, schema)


def moving_average(df: DataFrame, keys: Sequence[str], order: str, vector: str, chunk: Column,
                   keep: float = 0.9) -> DataFrame:
    """Exponential average of unit vectors in order, renormalised at each step.

    Returns ``keys, embedding`` after the last row of each key.
    """
    keys = list(keys)
    rows = df.select(*keys, order, F.col(vector).cast("array<double>").alias("_v")).withColumn(CHUNK, chunk)
    schema = T.StructType(_fields(rows, keys + [CHUNK]) + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def fold(pdf: pd.DataFrame, state: bytes | None):
        pdf = pdf.sort_values(order)
        mean = np.frombuffer(state, dtype=np.float64) if state else None
        for v in pdf["_v"]:
            v = np.asarray(v, dtype=np.float64)
            if mean is None:
                mean = v
                continue
            mean = keep * mean + (1.0 - keep) * v
            length = np.linalg.norm(mean)
            mean = mean / length if length > 0 else mean
        out = pdf[keys + [CHUNK]].head(1).assign(embedding=[mean.tolist()])
        return out, mean.tobytes()

    per_chunk = chunk_fixpoint(rows, keys, CHUNK, fold, schema)
    return per_chunk.groupBy(*keys).agg(F.max_by("embedding", CHUNK).alias("embedding"))
