"""Exact nearest neighbours by blocked matrix products.

Vectors are packed into blocks of bounded size. A block of candidates meets blocks of probes as one
group, where one matrix product each yields the best ``k`` per probe; only those leave the
task, and a final per-probe ranking merges blocks. Pairs are never written out as rows.
Which block meets which is decided by grouping both sides on (group, candidate block, salt), so a group
holding most of the table still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigilgrid.functions import vectors as V
from vigilgrid.session import cut_lineage

PROBE_ROWS = 1024
CANDIDATE_ROWS = 4096
BLOCKS_PER_SALT = 64
MAX_GROUPS = 100_000


def nearest(probes: DataFrame, candidates: DataFrame, k: int, groups: Sequence[str] = (),
            probe_id: str = "probe_id", candidate_id: str = "candidate_id",
            vector: str = "embedding", threshold: float | None = None, earlier_only: bool = False,
            probe_rows: int = PROBE_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """Top ``k`` candidates by cosine per probe: ``probe_id, candidate_id, similarity, rank``.

    Ids are longs, unique per side. Ties go to the smaller candidate id. With ``threshold`` only
    similarities at or above it count. ``groups`` are columns both sides must agree on.
    ``earlier_only`` admits only candidates whose id is below the probe's.
    """
    on = list(groups) or ["_one"]
    left_rows, right_rows = (_unit(d, groups, i, vector) for d, i in ((probes, probe_id), (candidates, candidate_id)))
    left_size, right_size = _sizes(left_rows, on, "_pb", probe_rows), _sizes(right_rows, on, "_cb", candidate_rows)
    salts = F.ceil(F.col("_pb") / BLOCKS_PER_SALT).cast("long")
    left = _blocks(left_rows, left_size, on, "_pb", "p")
    probe_side = (left.join(right_size, on).withColumn("_salt", F.pmod(F.xxhash64("_block"), salts))
                  .withColumn("_cblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cb") - 1))))
    candidate_side = (_blocks(right_rows, right_size, on, "_cb", "c").withColumnRenamed("_block", "_cblock").join(left_size, on)
                      .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))))
    at = on + ["_cblock", "_salt"]
    floor = -np.inf if threshold is None else threshold

    def multiply(probes: pa.Table, block: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for cid, cv in _vectors(block, "c"):
            for pid, pv in _vectors(probes, "p"):
                scores = pv @ cv.T
                if earlier_only:
                    scores[cid[None, :] >= pid[:, None]] = -np.inf
                for out, more in zip(found, _best(scores, pid, cid, k, floor)):
                    out.append(more)
        return pa.table([pa.array(np.concatenate(x)) for x in found], [probe_id, candidate_id, "similarity"])

    # A block of candidates and its share of the probe blocks, at most about BLOCKS_PER_SALT, are in memory at once.
    # Both sides may come from one table, so the columns of one get names of their own.
    other = candidate_side.select(*[F.col(c).alias(f"c{c}") for c in at], "c_ids", "c_vecs")
    dealt = probe_side.select(*at, "p_ids", "p_vecs").groupBy(*at).cogroup(other.groupBy(*[f"c{c}" for c in at]))
    partial = dealt.applyInArrow(multiply, f"{probe_id} long, {candidate_id} long, similarity double")
    order = Window.partitionBy(probe_id).orderBy(F.desc("similarity"), candidate_id)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(df: DataFrame, groups: Sequence[str], id_col: str, vector: str) -> DataFrame:
    rows = df.select(*groups, F.col(id_col).alias("_id"), V.normalise(F.col(vector)).alias("_v")).where(F.col("_v").isNotNull())
    return rows if groups else rows.withColumn("_one", F.lit(1))


def _sizes(rows: DataFrame, on: list[str], name: str, block_rows: int) -> DataFrame:
    """Number of blocks per group. One row per group: broadcast once counted to be few, so that a
    hot group's vectors are never shuffled by group alone; left to Spark otherwise."""
    sizes = cut_lineage(rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias(name)))
    return F.broadcast(sizes) if sizes.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else sizes


def _blocks(rows: DataFrame, sizes: DataFrame, on: list[str], name: str, side: str) -> DataFrame:
    """Pack unit vectors into blocks: ``on, _block, <side>_ids, <side>_vecs`` and the block count."""
    spread = rows.join(sizes, on).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col(name)))
    packed = spread.groupBy(*on, "_block", name).agg(F.collect_list(F.struct("_id", "_v")).alias("_rows"))
    keep = [name] if side == "p" else []
    return packed.select(*on, "_block", *keep, F.col("_rows._id").alias(f"{side}_ids"), F.flatten("_rows._v").alias(f"{side}_vecs"))


def _vectors(blocks: pa.Table, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids in order and vectors of every block."""
    for ids, vecs in zip(blocks.column(f"{side}_ids"), blocks.column(f"{side}_vecs")):
        ids, vecs = np.asarray(ids.values), np.asarray(vecs.values, dtype=np.float64)
        order = np.argsort(ids, kind="stable")
        yield ids[order].astype(np.int64), vecs.reshape(len(ids), -1)[order]


def _best(scores: np.ndarray, pid: np.ndarray, cid: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of every row from ``floor`` on, the smaller id first among equals."""
    width = scores.shape[1]
    least = np.full(len(pid), floor)
    if k < width:
        # The k-th best of the stretches' best is at most the k-th best of all; few scores lie above it.
        stretches = np.maximum.reduceat(scores, np.arange(0, width, max(1, width // max(64, 2 * k))), axis=1)
        if k < stretches.shape[1]:
            least = np.maximum(least, np.partition(stretches, -k, axis=1)[:, -k])
        else:
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    score = scores[row, at]
    order = np.lexsort((at, -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    kept = place < k
    return pid[row[kept]], cid[at[kept]], score[kept]
