"""Exact deduplication: a Bloom filter of repeated hashes decides which rows need to move.

First pass: every task turns the hashes of its texts into filter slots and keeps apart the slots it
met once and the slots it met again; merging the tasks' slots leaves the filter of slots met twice.
Second pass: rows whose slots were all met twice are possibly repeated. Only they are shuffled and
compared by SHA-256; every other row is certainly unique and passes straight through.

The filter has a fixed size, so its broadcast is bounded; beyond its capacity more unique rows are
shuffled needlessly, never fewer repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Filter blocks of 2**16 slots. 2048 blocks are 16 MB of bits, good for about 30 million rows.
BLOCKS = 2048
_SLOTS = 1 << 16
SALTS = 16


def _block(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(BLOCKS)).cast("int")


def _slots(h: Column) -> list[Column]:
    """Two slots inside the row's block."""
    return [F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_SLOTS - 1)).cast("int") for shift in (0, 20)]


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of a task by block: met once, met again. Two equal slots of one row count once."""
    seen: list[np.ndarray] = []
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64) * _SLOTS
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
        seen += [block + a, (block + b)[a != b]]
    if not seen:
        return
    slot, count = np.unique(np.concatenate(seen), return_counts=True)
    block = slot // _SLOTS
    cuts = np.flatnonzero(np.diff(block)) + 1
    for where, times in zip(np.split(slot, cuts), np.split(count, cuts)):
        if len(where):
            low = (where % _SLOTS).astype(np.uint16)
            yield pa.record_batch({"block": pa.array([int(where[0] // _SLOTS)], pa.int32()),
                                   "once": pa.array([low[times == 1].tobytes()], pa.binary()),
                                   "again": pa.array([low[times > 1].tobytes()], pa.binary())})


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap of 64-bit words per block, from its rows, which come in order of block."""
    current, once, again = None, np.zeros(_SLOTS, bool), np.zeros(_SLOTS, bool)

    def bitmap() -> pa.RecordBatch:
        words = np.packbits(again, bitorder="little").view(np.int64)
        return pa.record_batch({"block": pa.array([current], pa.int32()), "bits": pa.array([words.tolist()], pa.list_(pa.int64()))})

    for batch in batches:
        for block, first, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "again"))):
            if block != current:
                if current is not None:
                    yield bitmap()
                current = block
                once[:] = again[:] = False
            low, high = np.frombuffer(first, np.uint16), np.frombuffer(more, np.uint16)
            again[low[once[low]]] = True
            again[high] = True
            once[low] = True
            once[high] = True
    if current is not None:
        yield bitmap()


def repeated_filter(hashes: DataFrame) -> DataFrame:
    """``block, bits``: the slots met by two rows or more, from a column ``h`` of 64-bit hashes."""
    slots = hashes.select(_block(F.col("h")).alias("block"), *(s.alias(n) for s, n in zip(_slots(F.col("h")), "ab")))
    met = slots.mapInArrow(_met, "block int, once binary, again binary")
    return (met.repartition("block").sortWithinPartitions("block")
            .mapInArrow(_merged, "block int, bits array<bigint>"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its columns (or those of ``carry``) and ``_dedup`` (keep_id, group_size, kept, sha256).

    Equal texts form a group (null counts as empty) and the largest id stays; null ids are smaller
    than any other. Rows that repeat an id and a text are marked alike, so both are kept here. No
    rows give no rows. Other columns, whatever their names, are carried unread; one named ``_dedup``
    is replaced.
    """
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    repeated = repeated_filter(docs.select(F.xxhash64(text).alias("h"))).withColumnRenamed("block", "_block")
    row = _row([c for c in (docs.columns if carry is None else carry) if c != "_dedup"])
    keyed = docs.select(row.alias("row"), ident.alias("id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"))
    # At most BLOCKS bitmaps of 8 KB.
    probed = keyed.join(F.broadcast(repeated), _block(F.col("h")) == F.col("_block"), "left")
    hit = F.lit(True)
    for slot in _slots(F.col("h")):
        word = F.get("bits", F.shiftright(slot, 6))
        hit = hit & (F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)))) == 1)
    probed = probed.select("row", "id", "sha", F.coalesce(hit, F.lit(False)).alias("maybe"))
    alone = probed.where(~F.col("maybe")).select("row", F.struct(
        F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("sha256")).alias("_dedup"))
    again = probed.where("maybe")
    groups = again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Every group is offered under each salt, so the rows of a very large group spread over that many tasks.
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = again.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    decided = salted.join(spread, ["sha", "salt"]).select("row", F.struct(
        "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("sha256")).alias("_dedup"))
    return alone.union(decided).select("row.*", "_dedup")


def _row(columns: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; one row where an id and a text are repeated."""
    kept = marked(docs, id_col, text_col).where("_dedup.kept").select(
        _row(docs.columns).alias("row"), F.col("_dedup.group_size").alias("size"), F.col("_dedup.sha256").alias("sha"))
    many = kept.where("size > 1").groupBy("sha").agg(F.first("row").alias("row"))
    return kept.where("size = 1").select("row").union(many.select("row")).select("row.*")
