"""A stored inverted file of product-quantised vectors, for approximate nearest neighbours.

Cells are k-means centres, their number follows the rows. A row is stored in its nearest cell as one
byte per stretch of its residual. A search visits the cells nearest to each probe, scores their codes by
table lookups in blocks, and compares the short list with the stored vectors exactly. Centres and codebooks
are fitted on bounded samples; every row is indexed. How many cells a search visits is measured when the
index is built: as many as hold the wanted share of the exact neighbours of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigilgrid.functions import vectors as V
from vigilgrid.operators.nearest import nearest
from vigilgrid.session import cut_lineage

#: Rows fitted per cell and for the codebooks at most; dimensions of one code; rows of one stored block.
CELL_SAMPLE, CODE_SAMPLE, STRETCH, BLOCK_ROWS = 256, 16_384, 4, 4_096
LEAST_CELLS, MOST_CELLS = 8, 4_096
#: Rows and neighbours of each by which visits are measured, the share that they must hold, and candidates
#: scored exactly per wanted neighbour.
TRIED, TRIED_NEIGHBOURS, TARGET, SHORT = 256, 10, 0.98, 20


@dataclass(frozen=True)
class Inverted:
    """Where an index lies: ``cells``, ``books``, ``blocks``, ``vectors`` and ``visits`` below one folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def cells_for(rows: int) -> int:
    """About the square root of the rows, within bounds."""
    return int(min(MOST_CELLS, max(LEAST_CELLS, round(rows ** 0.5))))


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), V.normalise(F.col(vector)).alias("v")).where(F.col("v").isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _books(residuals: np.ndarray, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """A codebook of 256 entries for every stretch of dimensions, by Lloyd's rounds."""
    parts = np.stack(np.split(np.pad(residuals, ((0, 0), (0, -residuals.shape[1] % STRETCH))), -(-residuals.shape[1] // STRETCH), axis=1))
    draw = np.random.default_rng(seed)
    books = parts[:, draw.choice(parts.shape[1], 256, replace=parts.shape[1] < 256)].copy()
    for _ in range(rounds):
        for book, part in zip(books, parts):
            near = _nearest_entry(part, book)
            n = np.bincount(near, minlength=256)
            sums = np.stack([np.bincount(near, part[:, d], 256) for d in range(part.shape[1])], axis=1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def _nearest_entry(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book ** 2).sum(axis=1) - 2.0 * part @ book.T).argmin(axis=1)


def _stretches(x: np.ndarray) -> list[np.ndarray]:
    return np.split(np.pad(x, ((0, 0), (0, -x.shape[1] % STRETCH))), -(-x.shape[1] // STRETCH), axis=1)


def _placed(centres: np.ndarray, books: np.ndarray | None):
    """Cell, id, vector and codes (residuals if there are no codebooks yet) of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            x = _matrix(batch.column("v"))
            cell = (x @ centres.T).argmax(axis=1)
            rest = x - centres[cell]
            if books is None:
                yield pa.record_batch([pa.array(rest.tolist(), pa.list_(pa.float64()))], ["rest"])
                continue
            codes = np.stack([_nearest_entry(p, b) for p, b in zip(_stretches(rest), books)], axis=1).astype(np.uint8)
            yield pa.record_batch([pa.array(cell, pa.int64()), batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())],
                                  ["cell", "id", "v", "codes"])

    return run


def build(candidates: DataFrame, path: str, id_col: str = "candidate_id", vector: str = "embedding", cells: int | None = None, seed: int = 42) -> Inverted:
    """Index every row of ``candidates`` that has a direction below ``path``; ids are unique longs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = candidates.sparkSession
    rows = cut_lineage(_units(candidates, id_col, vector))
    n = rows.count()
    cells = min(cells or cells_for(n), n)
    by_hash = F.xxhash64("id", F.lit(seed))
    # The rows of least hash are a repeatable sample of bounded size.
    sample = cut_lineage(rows.orderBy(by_hash).limit(CELL_SAMPLE * max(1, cells)))
    features = sample.select(array_to_vector("v").alias("features"))
    if cells > 1:
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=12).fit(features).clusterCenters(), float)
    else:
        centres = np.array([r.v for r in sample.limit(cells).collect()] or np.zeros((0, 1)), float)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    rest = sample.limit(CODE_SAMPLE).mapInArrow(_placed(centres, None), "rest array<double>").toPandas()["rest"] if n else []
    books = _books(np.array(list(rest), float)) if n else np.zeros((0, 256, STRETCH))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell long, embedding array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, bytes(b.astype("<f8").tobytes()), b.shape[1]) for i, b in enumerate(books)], "stretch int, book binary, width int").write.mode("overwrite").parquet(f"{path}/books")
    placed = cut_lineage(rows.mapInArrow(_placed(centres, books), "cell long, id long, v array<double>, codes binary"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = dealt.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("id", "codes"))).alias("r")).select(
        "cell", "part", F.col("r.id").alias("ids"), F.expr("aggregate(r.codes, X'', (a, c) -> a || c)").alias("codes"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    placed.select("id", "v").repartition(F.pmod("id", F.lit(1024))).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vectors")
    _measured(sample.limit(TRIED), rows, placed, spark.read.parquet(f"{path}/cells")).write.mode("overwrite").parquet(f"{path}/visits")
    return Inverted(spark, path)


def _measured(tried: DataFrame, rows: DataFrame, placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``visit``: the least number of nearest cells that hold ``TARGET`` of the exact neighbours of ``tried``."""
    probes = cut_lineage(tried.toDF("probe", "embedding"))
    exact = nearest(probes, rows.toDF("id", "embedding"), TRIED_NEIGHBOURS + 1, (), "probe", "id").where("probe <> id").select("probe", "id")
    order = nearest(probes, cells.withColumnRenamed("cell", "cell_id"), MOST_CELLS, (), "probe", "cell_id").select("probe", F.col("cell_id").alias("cell"), "rank")
    ranks = exact.join(placed.select("id", "cell"), "id").join(order, ["probe", "cell"])
    return ranks.agg(F.coalesce(F.expr(f"percentile_disc({TARGET}) WITHIN GROUP (ORDER BY rank)"), F.lit(1)).cast("int").alias("visit"))


def search(index: Inverted, probes: DataFrame, k: int, visit: int | None = None, short: int | None = None, probe_id: str = "probe_id",
           candidate_id: str = "candidate_id", vector: str = "embedding") -> DataFrame:
    """Approximate top ``k`` per probe: ``probe_id, candidate_id, similarity, rank``; similarities are exact.

    A probe without direction finds nothing. Ties go to the smaller candidate id.
    """
    cells = index.table("cells")
    books = np.array([np.frombuffer(bytes(r.book), "<f8").reshape(256, r.width) for r in index.table("books").orderBy("stretch").collect()])
    visit, short = visit or index.table("visits").first().visit, short or SHORT * k
    units = cut_lineage(_units(probes, probe_id, vector))
    near = nearest(units.toDF("probe", "embedding"), cells.withColumnRenamed("cell", "cell_id"), visit, (), "probe", "cell_id")
    visits = near.select(F.col("probe").alias("id"), F.col("cell_id").alias("cell"), F.col("similarity").alias("base")).join(units, "id")
    crowd = visits.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(64)))
    packs = crowd.groupBy("cell", "pack").agg(F.collect_list(F.struct("id", "base", "v")).alias("p")).select(
        "cell", F.col("p.id").alias("probes"), F.col("p.base").alias("bases"), F.flatten("p.v").alias("vectors"))
    met = packs.join(index.table("blocks"), "cell").select("probes", "bases", "vectors", "ids", "codes")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probes, bases, vectors, ids, codes in zip(*(batch.column(c) for c in ("probes", "bases", "vectors", "ids", "codes"))):
                own, ids = np.asarray(probes.values), np.asarray(ids.values)
                x = np.asarray(vectors.values, dtype=np.float64).reshape(len(own), -1)
                code = np.frombuffer(codes.as_py(), np.uint8).reshape(len(ids), -1)
                total = np.repeat(np.asarray(bases.values, dtype=np.float64)[:, None], len(ids), axis=1)
                for m, (part, book) in enumerate(zip(_stretches(x), books)):
                    total += (part @ book.T)[:, code[:, m]]
                keep = min(short, len(ids))
                best = np.argpartition(-total, keep - 1, axis=1)[:, :keep]
                yield pa.record_batch([pa.array(np.repeat(own, keep)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(total, best, axis=1).ravel())],
                                      ["probe", "id", "score"])

    scored = met.mapInArrow(score, "probe long, id long, score double")
    listed = scored.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))).where(F.col("r") <= short).select("probe", "id")
    exact = listed.join(index.table("vectors"), "id").join(units.toDF("probe", "q"), "probe").select(
        F.col("probe").alias(probe_id), F.col("id").alias(candidate_id), V.dot(F.col("v"), F.col("q")).alias("similarity"))
    order = Window.partitionBy(probe_id).orderBy(F.desc("similarity"), candidate_id)
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
