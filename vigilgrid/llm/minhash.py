"""Near duplicates by MinHash with tensored banding.

A plain banding of T tables needs its own minhashes for each. Here two collections of ``SIDE`` short
keys are made, each from ``DEPTH`` minhashes, and a table's key combines one key of either collection:
SIDE * SIDE tables of 2 * DEPTH minhashes from 2 * SIDE * DEPTH of them, about the square root. Two
sets meet in a table exactly if they share a key of each collection. A set none of whose keys of one
collection occurs twice meets nobody, so it is left out before the tables' keys are formed.

At similarity 0.85 a pair misses a collection with probability (1 - 0.85 ** 3) ** 14 = 1.6e-6.
Links are confirmed on whole sets (``links``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilgrid.llm import links
from vigilgrid.llm.jaccard import _sets, members, text_rows
from vigilgrid.llm.words import mixed, slices
from vigilgrid.session import cut_lineage

PERCENT = 85
#: Keys of one collection and minhashes of one key.
SIDE, DEPTH = 14, 3

_DRAW = np.random.default_rng(20240613)
_FLIP = _DRAW.integers(0, 1 << 63, 2 * SIDE * DEPTH, dtype=np.uint64)
_FACTOR = _DRAW.integers(1, 1 << 63, 2 * SIDE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def collection_keys(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``2 * SIDE`` keys for each row, which has the next ``n`` > 0 tokens; the lowest bit tells the collection."""
    keys = np.zeros((2 * SIDE, len(n)), np.uint64)
    if len(n):
        starts = np.cumsum(n) - n
        for k in range(2 * SIDE):
            for f in range(k * DEPTH, (k + 1) * DEPTH):
                least = np.minimum.reduceat((tokens ^ _FLIP[f]) * _FACTOR[f], starts)
                keys[k] = mixed(keys[k] + least)
            keys[k] = mixed(keys[k] + np.uint64(k)) & ~np.uint64(1) | np.uint64(k % 2)
    return keys.T


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        tokens, _, n, prints = _sets(batch.column("text"))
        keys = collection_keys(tokens, n[n > 0])
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * SIDE, 0))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        yield pa.record_batch([batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(prints.view(np.int64)), lists],
                              ["id", "hash", "n", "set", "keys"])


def tables(sets: DataFrame) -> DataFrame:
    """``set, key, n, rem, marks``: a row for every table in which ``sets(set, n, keys)`` may meet another."""
    each = sets.select("set", "n", F.explode("keys").alias("part"))
    often = each.groupBy("part").count().where("count > 1").select("part")
    odd = F.col("part").bitwiseAND(F.lit(1)) == 1
    shared = each.join(often, "part").groupBy("set", "n").agg(
        F.collect_list(F.when(odd, F.col("part"))).alias("a"), F.collect_list(F.when(~odd, F.col("part"))).alias("b"))
    pairs = shared.select("set", "n", F.explode("a").alias("a"), "b").select("set", "n", "a", F.explode("b").alias("b"))
    return pairs.select("set", F.xxhash64("a", "b").alias("key"), "n", F.col("n").alias("rem"), F.array("a", "b").alias("marks"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, hash, n, set, component, component_id`` of every row; ``hash`` is its text's."""
    rows = text_rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    summary = cut_lineage(rows.mapInArrow(_signatures, f"id {kind}, hash bigint, n bigint, set bigint, keys array<bigint>"))
    sets = summary.where("n > 0").groupBy("set").agg(*(F.first(c).alias(c) for c in ("hash", "n", "keys")))
    met = links.crowded(tables(sets), PERCENT)
    wanted = cut_lineage(sets.select("set", "hash").join(met.select("set").distinct(), "set", "left_semi"))
    # Both collections in order of value, which is the same order for all sets.
    orders = sets.select("set", F.expr("array(array_sort(filter(keys, k -> (k & 1) = 1)), array_sort(filter(keys, k -> (k & 1) = 0)))").alias("orders"))
    found = links.components(met, cut_lineage(members(rows, wanted).join(orders, "set")), PERCENT)
    return links.named(summary.drop("keys"), found)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    A component is named by its smallest id and ``kept`` marks the rows with that id. A text without
    words links with nothing, null counts as empty; rows with a null id link as others do, and are
    kept only where their component has no id. Rows that repeat an id and a text repeat its result.
    No rows give no rows; other columns are not read.
    """
    return grouped(docs, id_col, text_col).select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
