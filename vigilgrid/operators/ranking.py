"""Sorts, pages and top-k. Every order ends in a key, so pages and cuts are repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigilgrid.functions.text import next_cursor


def top(df: DataFrame, score: str, id_col: str, k: int, floor: float | None = None) -> DataFrame:
    """Best ``k`` rows; each task keeps its own best ``k`` before anything moves."""
    rows = df if floor is None else df.where(F.col(score) >= floor)
    return rows.orderBy(F.desc(score), id_col).limit(k)


def over_fetch(df: DataFrame, score: str, id_col: str, k: int, factor: int = 4) -> DataFrame:
    return top(df, score, id_col, factor * k)


def page(df: DataFrame, score: str, id_col: str, k: int, offset: int) -> DataFrame:
    return df.orderBy(F.desc(score), id_col).offset(offset).limit(k)


def page_with_cursor(df: DataFrame, score: str, id_col: str, k: int, cursor: str | None) -> DataFrame:
    """One page plus the cursor of the next, null on a short page. The cursor holds an offset."""
    import base64

    try:
        offset = int(base64.b64decode(cursor).decode()) if cursor else 0
    except ValueError:
        offset = 0
    rows = page(df, score, id_col, k, offset)
    given = F.lit(cursor).cast("string")
    size = rows.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(1).alias("_one"), next_cursor(F.col("_n"), k, given).alias("next_cursor"))
    return rows.withColumn("_one", F.lit(1)).join(size, "_one").drop("_one")


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by ``order``, as a partial aggregation rather than a sort."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(
        *key, *[f"_r.{c}" for c in others])


def recent_queries(searches: DataFrame, text: str, ts: str, id_col: str, keep: int = 10) -> DataFrame:
    """Newest entry per case-insensitive text of two or more characters, newest ``keep`` of them."""
    usable = searches.where(F.length(F.trim(text)) >= 2).withColumn("_key", F.lower(F.trim(text)))
    newest = latest_per_key(usable, ["_key"], [ts, id_col]).drop("_key")
    return newest.orderBy(F.desc(ts), F.desc(id_col)).limit(keep)


def last_turns(turns: DataFrame, keep: int = 20) -> DataFrame:
    """Newest ``keep`` turns of each session; the rank filter is applied before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def repeatable_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order: random-looking, the same every time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), id_col).limit(n)


def random_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
