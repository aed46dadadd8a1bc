"""Removal of long repeated byte strings by minimiser anchors and fingerprints.

This is not prefix doubling: no ranks are paired and no offset doubles. A name is a 64-bit fingerprint of
the bytes, which Spark groups, and only sampled positions take part: of every window of ``length`` bytes the
place with the least hash of ``GRAM`` bytes is its anchor. Equal windows have their anchors at the same
distance, so a window can only be repeated if its anchor's gram is. The lengths grow in turn:

1. grams: anchors whose gram occurs once drop out with all their windows;
2. the stretch that holds all windows of an anchor: where it is repeated all of them are;
3. for the rest, blocks of up to ``BLOCK`` windows: repeated as a whole they are done, and if even the
   bytes they have in common are unique so is each of them;
4. the windows that are still open, one by one.

Counting occurrences never gathers a group: a name is repeated if the least and greatest of its places differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from vigilgrid.llm.words import _BYTE_VALUES, mixed, powers, slices, text_bytes
from vigilgrid.session import cut_lineage

LENGTH, GRAM, BLOCK = 200, 24, 16
# Bytes of text a task works on at a time: its arrays hold some 60 bytes for each, and a Python worker keeps what it once took.
PART = 1 << 19
WHOLE = 1 << 40  # Above the last window of any text.
_UPPER = np.uint64(0xFFFFFFFF00000000)


class Prints:
    """Fingerprints of any slice of a run of bytes."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[raw] * powers(len(raw))[:len(raw)], out=self.sums[1:])
        self.back = powers(len(raw), inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(value + mixed(((end - start).astype(np.uint64) << np.uint64(20)) + np.asarray(salt).astype(np.uint64)))

    def each(self, width: int) -> np.ndarray:
        """Fingerprints of the slices of ``width`` bytes at every place."""
        value = self.sums[width:] - self.sums[:-width]
        value *= self.back[:len(value)]
        value += mixed(np.array([width << 20], np.uint64))
        return mixed(value)


def anchors(raw: np.ndarray, offsets: np.ndarray, prints: Prints, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie in one text: place, first and last window, gram name."""
    width = length - GRAM + 1
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = prints.each(GRAM)
    # Keys order by half of the hash and then by place, so the least key of a window tells its place.
    # Least key of every stretch of ``width`` grams: heads and tails of blocks of that width.
    m = len(grams)
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(grams, _UPPER, out=padded[:m])
    padded[:m] |= np.arange(m, dtype=np.uint64)
    tail = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    np.minimum.accumulate(padded.reshape(-1, width), axis=1, out=padded.reshape(-1, width))
    windows = n - length + 1
    place = (np.minimum(tail[:windows], padded[width - 1:width - 1 + windows]) & ~_UPPER).view(np.int64)
    inside = np.arange(length, n + 1) <= np.repeat(offsets[1:], np.diff(offsets))[:windows]
    starts, place = np.flatnonzero(inside), place[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    cut = np.flatnonzero(np.append([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)))
    last = np.append(cut[1:], len(starts)) - 1
    return place[cut], starts[cut], starts[last], grams[place[cut]]


def _text(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Prints]:
    raw, offsets = text_bytes(frame.column("text"))
    return raw, offsets, Prints(raw)


def _columns(schema: list[tuple[str, pa.DataType]], *arrays) -> pa.RecordBatch:
    return pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, t)
                            for a, (_, t) in zip(arrays, schema)], [n for n, _ in schema])


def _grams(length: int):
    schema = [("name", pa.int64()), ("key", pa.int64()), ("place", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            raw, offsets, prints = _text(batch)
            place, _, _, name = anchors(raw, offsets, prints, length)
            row = np.searchsorted(offsets, place, "right") - 1
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield _columns(schema, name, key[row], place - offsets[row])

    return run, "name bigint, key bigint, place bigint"


def _stretches(length: int):
    schema = [("key", pa.int64()), ("name", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("whole", pa.int64()),
              ("blocks", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("all", pa.int64()), ("core", pa.int64())])))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            raw, offsets, prints = _text(batch)
            place, low, high, name = anchors(raw, offsets, prints, length)
            row = np.searchsorted(offsets, place, "right") - 1
            wanted = batch.column("places")
            held = pa.compute.list_parent_indices(wanted).to_numpy(zero_copy_only=False)
            flat = wanted.flatten().to_numpy(zero_copy_only=False) + offsets[held]
            keep = np.isin(place, flat)
            place, low, high, name, row = place[keep], low[keep], high[keep], name[keep], row[keep]
            if not len(place):
                continue
            whole = prints.of(low, high + length, place - low + (1 << 16))
            # Blocks lie at fixed distances before the anchor, so partners cut theirs alike.
            far, near = (place - low) // BLOCK, (place - high) // BLOCK
            count = far - near + 1
            at = np.repeat(np.arange(len(place)), count)
            index = near[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            first, last = np.maximum(low[at], place[at] - index * BLOCK - BLOCK + 1), np.minimum(high[at], place[at] - index * BLOCK)
            every = prints.of(first, last + length, place[at] - first + (2 << 16))
            core = prints.of(place[at] - index * BLOCK, place[at] - index * BLOCK - BLOCK + 1 + length, index + (3 << 16))
            base = offsets[row]
            blocks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(first - base[at]), pa.array(last - base[at]), pa.array(every.view(np.int64)), pa.array(core.view(np.int64))],
                ["low", "high", "all", "core"]))
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield _columns(schema, key[row], name, low - base, high - base, whole, blocks)

    return run, ("key bigint, name bigint, low bigint, high bigint, whole bigint, "
                 "blocks array<struct<low:bigint,high:bigint,all:bigint,core:bigint>>")


def _windows(length: int):
    schema = [("name", pa.int64()), ("key", pa.int64()), ("low", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            raw, offsets, prints = _text(batch)
            held = pa.compute.list_parent_indices(batch.column("spans")).to_numpy(zero_copy_only=False)
            spans = batch.column("spans").flatten()
            low, high = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            count = high - low + 1
            at = np.repeat(np.arange(len(low)), count)
            start = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            row = held[at]
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield _columns(schema, prints.of(start + offsets[row], start + offsets[row] + length), key[row], start)

    return run, "name bigint, key bigint, low bigint"


def _repeated(rows: DataFrame, name: str, place: str) -> DataFrame:
    """Names met at two places or more; copies of a text have its places. A place is told by its hash,
    which keeps the rows that are shuffled flat."""
    where = F.xxhash64("key", place)
    return rows.groupBy(name).agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo <> hi").select(name)


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, low, high``: runs of window starts whose strings start elsewhere too; ``texts(key, text)``."""
    run, schema = _grams(length)
    grams = cut_lineage(texts.mapInArrow(run, schema))
    hits = grams.join(_repeated(grams, "name", "place"), "name").groupBy("key").agg(F.collect_set("place").alias("places"))
    run, schema = _stretches(length)
    stretches = cut_lineage(texts.join(hits, "key").select("key", "text", "places").mapInArrow(run, schema))
    whole = _repeated(stretches, "whole", "low").withColumn("done", F.lit(True))
    known = stretches.join(whole, "whole", "left").select("*", F.coalesce("done", F.lit(False)).alias("is_done")).drop("done")
    done = known.where("is_done").select("key", "low", "high")
    # Names with open stretches; a stretch that is done still is a partner for them, once.
    open_names = known.where("NOT is_done").select("name").distinct()
    partners = stretches.join(open_names, "name", "left_semi").join(whole, "whole", "left").groupBy("whole", "done").agg(
        F.min_by(F.struct("key", "blocks"), F.struct("key", "low")).alias("p"))
    blocks = cut_lineage(partners.select("p.key", F.col("done").isNull().alias("open"), F.explode("p.blocks").alias("b")).select("key", "open", "b.*"))
    every = _repeated(blocks, "all", "low").withColumn("all_done", F.lit(True))
    core = _repeated(blocks, "core", "low").withColumn("core_met", F.lit(True))
    judged = cut_lineage(blocks.join(core, "core").join(every, "all", "left"))
    more = judged.where("open AND all_done").select("key", "low", "high")
    # Of equal cores with an undecided block, all blocks take part, equal ones once.
    undecided = judged.where("open AND all_done IS NULL").select("core").distinct()
    last = judged.join(undecided, "core", "left_semi").groupBy("all").agg(F.min_by(
        F.struct("key", "low", "high", (F.col("open") & F.col("all_done").isNull()).alias("ask")), F.struct("key", "low")).alias("p"))
    spans = last.select("p.*").groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    run, schema = _windows(length)
    windows = cut_lineage(texts.join(spans, "key").select("key", "text", "spans").mapInArrow(run, schema))
    single = windows.join(_repeated(windows, "name", "low"), "name").select("key", "low", F.col("low").alias("high"))
    return done.unionByName(more).unionByName(single)


def _covered(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            raw, offsets = text_bytes(batch.column("text"))
            runs = batch.column("runs")
            row = pa.compute.list_parent_indices(runs).to_numpy(zero_copy_only=False)
            low, high = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            # Covered bytes: starts of runs less ends of runs so far; runs end with their text.
            begin, stop = offsets[row] + low, np.minimum(offsets[row] + high + length, offsets[row + 1])
            edges = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(stop, minlength=len(raw) + 1)
            gone = np.cumsum(edges)[:-1] > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            at = offsets[:-1][np.diff(offsets) > 0]
            first[at] = gone[at]
            removed, spans = (np.append(0, np.cumsum(x))[offsets] for x in (gone, first))
            # Texts that go as a whole come without their bytes.
            size = batch.column("n_bytes").to_numpy(zero_copy_only=False)
            whole = size > np.diff(offsets)
            ends = (offsets - removed).astype(np.int64)
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw[~gone])])
            yield pa.record_batch([batch.column("row"), pa.array(size, pa.int64()), pa.array(np.where(whole, size, np.diff(removed)), pa.int64()),
                                   pa.array(np.diff(spans) + whole, pa.int64()), kept.cast(pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (columns of ``docs``), n_bytes, n_removed, n_spans and ``kept``, the remaining bytes.

    Every byte of a string of ``length`` bytes that also starts elsewhere, in any row, goes; strings are
    judged on the input and never cross rows. Null text is empty. Repeated rows are each other's repeats.
    Removal may cut a character, so ``kept`` is binary. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))).alias("row")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    long_ = texts.where(F.octet_length("text") >= length)
    copies = long_.groupBy("key").count().where("count > 1").select("key", F.lit(0).cast("long").alias("low"), F.lit(WHOLE).alias("high"))
    # Every copy of a text lists the same runs under one key, so they are taken once; copies go as a whole and
    # need neither runs nor bytes. Else each of n copies would carry the runs of all n.
    runs = repeated_windows(long_, length).unionByName(copies).groupBy("key").agg(
        F.collect_set(F.struct("low", "high")).alias("runs"), F.max("high").alias("far"))
    part = F.col("far").isNull() | (F.col("far") < WHOLE)
    rows = docs.select(row, F.xxhash64(text).alias("key"), text.alias("text")).join(runs, "key", "left").select(
        "row", F.octet_length("text").cast("long").alias("n_bytes"), F.when(part, F.col("text")).alias("text"), F.when(part, F.col("runs")).alias("runs"))
    schema = T.StructType([rows.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
                          + [T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(_covered(length), schema)
