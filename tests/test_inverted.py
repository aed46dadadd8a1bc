"""The inverted file beside exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilgrid.catalog.registry import Inputs
from vigilgrid.operators import inverted
from vigilgrid.operators.nearest import nearest
from vigilgrid.plans.evaluation import neighbour_recall

SCHEMA = "candidate_id bigint, embedding array<double>"


def rows(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def test_recall_of_the_stated_query_set(spark, tmp_path):
    crops = Inputs(spark, "/root/testdata/sf0.01").crops.select(F.col("crop_id").alias("candidate_id"), "embedding")
    asked = crops.where("candidate_id % 100 = 0").withColumnRenamed("candidate_id", "probe_id")
    index = inverted.build(crops, str(tmp_path / "index"))
    assert index.table("vectors").count() == crops.count() == index.table("blocks").select(F.explode("ids")).count()
    got = inverted.search(index, asked, 10)
    assert neighbour_recall(got, nearest(asked, crops, 10)).first().recall >= 0.95
    # Reported similarities are exact.
    both = got.alias("a").join(nearest(asked, crops, 500).alias("b"), ["probe_id", "candidate_id"]).select(F.max(F.abs(F.col("a.similarity") - F.col("b.similarity"))))
    assert both.first()[0] < 1e-9


def test_clustered_vectors_need_few_visits(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    table = rows(spark, [centres[i % 40] + rng.normal(0, 0.1, 16) for i in range(1600)])
    index = inverted.build(table, str(tmp_path / "index"))
    asked = table.where("candidate_id % 20 = 0").withColumnRenamed("candidate_id", "probe_id")
    assert index.table("cells").count() == 40 and index.table("visits").first().visit <= 12
    assert neighbour_recall(inverted.search(index, asked, 10), nearest(asked, table, 10)).first().recall >= 0.95


@pytest.mark.parametrize("vectors,want", [([], 0), ([[0.0, 0.0]], 0), ([[1, 0, 0, 0, 0]], 1), ([[1, 0], [1, 0], None, [0, 0], [0, 1]], 3)])
def test_awkward_tables(spark, tmp_path, vectors, want):
    index = inverted.build(rows(spark, vectors), str(tmp_path / "index"))
    width = len(vectors[0]) if vectors else 2
    probes = spark.createDataFrame([(7, [1.0] + [0.0] * (width - 1)), (8, [0.0] * width)], "probe_id bigint, embedding array<double>")
    got = inverted.search(index, probes, 5).collect()
    assert len(got) == want and {r.probe_id for r in got} <= {7}
    assert [r.candidate_id for r in sorted(got, key=lambda r: r["rank"])] == ([0, 1, 4] if want == 3 else [0] * want)
