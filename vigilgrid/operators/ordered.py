"""Order-dependent row features that survive hot keys.

A plain window partitioned by a track or camera puts the whole key into one task.
Here every key is also cut into chunks of its order (usually stretches of time). Windows run
inside (key, chunk); one small summary row per chunk carries the last rows or the last value
forward, so results equal the unchunked window while a key of any size spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"


def time_chunk(ts_ms: str | Column, width_ms: int) -> Column:
    c = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.floor(c / F.lit(width_ms)).cast("long")


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 n: int, chunk: Column, name: str = "history") -> DataFrame:
    """Add the last ``n`` rows of the key (oldest first, this row last) as an array of structs.

    ``chunk`` must not decrease along ``order``.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = df.withColumn(CHUNK, chunk).withColumn(
        name, F.collect_list(F.struct(*cols)).over(w.rowsBetween(-(n - 1), Window.currentRow)))
    if n == 1:
        return local.drop(CHUNK)
    tails = local.groupBy(*keys, CHUNK).agg(F.max_by(name, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-(n - 1), -1)
    carried = tails.select(*keys, CHUNK, F.flatten(F.collect_list("_tail").over(across)).alias("_carry"))
    joined = local.join(carried, keys + [CHUNK], "left")
    full = F.concat(F.coalesce("_carry", F.slice(name, 1, 0)), F.col(name))
    return joined.withColumn(
        name, F.when(F.size(name) >= n, F.col(name))
        .otherwise(F.slice(full, F.greatest(F.size(full) - (n - 1), F.lit(1)), n))
    ).drop("_carry", CHUNK)


def back(history: str | Column, steps: int) -> Column:
    """The struct ``steps`` rows before the current one, null when the key is shorter."""
    h = F.col(history) if isinstance(history, str) else history
    return F.when(F.size(h) > steps, F.element_at(h, -(steps + 1)))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                 chunk: Column, name: str, include_current: bool = True) -> DataFrame:
    """Add the latest non-null ``value`` at (or strictly before) each row of the key."""
    keys = list(keys)
    end = Window.currentRow if include_current else -1
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    local = local.withColumn(
        name, F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end)))
    # Rows without a value have a null order, which max_by passes over.
    tails = local.groupBy(*keys, CHUNK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
    across = (Window.partitionBy(*keys).orderBy(CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = tails.select(*keys, CHUNK, F.last("_tail", ignorenulls=True).over(across).alias("_carry"))
    return (local.join(carried, keys + [CHUNK], "left")
            .withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_value", CHUNK))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, ts: str,
            chunk: Column, name: str = "since") -> DataFrame:
    """For rows where ``flag`` holds, the ``ts`` at which the current unbroken run began."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    marked = with_history(marked, keys, order, ["_flag"], 2, chunk, "_flags")
    prev = F.coalesce(back("_flags", 1)["_flag"], F.lit(False))
    starts = F.when(F.col("_flag") & ~prev, F.col(ts))
    filled = forward_fill(marked, keys, order, starts, chunk, name)
    return filled.withColumn(name, F.when(F.col("_flag"), F.col(name))).drop("_flag", "_flags")


def trailing_count(df: DataFrame, keys: Sequence[str], ts_ms: str, width_ms: int, name: str,
                   chunk_ms: int = 3_600_000) -> DataFrame:
    """Rows of the key in (ts - width, ts], counted per chunk with a copied-in lead of one width."""
    keys = list(keys)
    home = time_chunk(ts_ms, chunk_ms)
    until = time_chunk(F.col(ts_ms) + F.lit(width_ms - 1), chunk_ms)
    spread = df.withColumn("_home", home).withColumn(CHUNK, F.explode(F.sequence(home, until)))
    w = Window.partitionBy(*keys, CHUNK).orderBy(ts_ms).rangeBetween(-(width_ms - 1), 0)
    return (spread.withColumn(name, F.count(F.lit(1)).over(w))
            .where(F.col(CHUNK) == F.col("_home")).drop("_home", CHUNK))
