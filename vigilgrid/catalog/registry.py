"""Register of runnable queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigilgrid.sources.standin import table, view, view_sql

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    sql: str | None
    ids: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


class Inputs:
    """The driver's tables and the stand-in views of one scale factor, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(ids: str, views: str = "", sql: str | None = None, ctes: str = "", name: str | None = None):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` selects from ``views`` and ``ctes``."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        text = None
        if sql is not None:
            parts = [p for p in (view_sql(*views.split()) if views else "", ctes.strip().rstrip(",")) if p]
            text = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
        key = name or fn.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times in the driver's tables carry no zone and are read as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Inputs(spark, sf_dir))

        ENTRIES[key] = Entry(run, text, tuple(ids.split()))
        return fn

    return wrap
