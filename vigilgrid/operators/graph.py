"""Connected components by hooking roots and jumping pointers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from vigilgrid.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, near: Sequence[str] = ()) -> DataFrame:
    """``nodes(node)`` and undirected ``edges(a, b)`` to ``(node, component)``, the smallest member.

    Each round every root hooks onto the root among its neighbours that a fresh hash ranks lowest, if
    that ranks below its own; trees flatten by jumping pointers, and edges shrink to those between
    the remaining roots. Roots that stay are lowest in their neighbourhood, at most half of those
    with an edge and in expectation fewer, whatever the order of the ids, so rounds grow with the
    logarithm of the nodes. Rounds are checkpointed and stop when no edge is left; there is no cap.

    With ``near``, columns of the edges such as a camera and a stretch of its time, the edges of each value are joined
    in one task first, so they must fit one; rounds then run over what nodes that lie in several of them connect. Any
    choice gives the same components, one that keeps most edges of a component together shuffles them once.
    """
    return _contracted(nodes, edges, list(near)) if near else labelled(nodes, edges)[0]


def _contracted(nodes: DataFrame, edges: DataFrame, near: list[str]) -> DataFrame:
    """Components from those inside each value of ``near``, joined where they share a node."""
    kind = edges.schema["a"].dataType
    inner = edges.where("a <> b").select("a", "b", *near).groupBy(*near).applyInPandas(
        _joined, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    each = cut_lineage(inner.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")).select(
        "node", "root", F.when(F.size("roots") > 1, F.col("roots")).alias("roots")))
    shared = each.where("roots IS NOT NULL").select(F.col("root").alias("a"), F.explode("roots").alias("b")).where("a <> b")
    ends = shared.select(F.col("a").alias("node")).union(shared.select("b")).distinct()
    across = labelled(ends, shared)[0].select(F.col("node").alias("root"), "component")
    named = each.select("node", "root").join(across, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    """``node, root`` of one group's edges, the root its smallest member."""
    names, at = np.unique(edges[["a", "b"]].to_numpy().T.ravel(), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        least, hooked = np.minimum(label[a], label[b]), label.copy()
        for ends in (label[a], label[b]):
            np.minimum.at(hooked, ends, least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == label).all():
            return pd.DataFrame({"node": names, "root": names[label]})
        label = hooked


def labelled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Components and the number of hooking rounds."""
    live = cut_lineage(_between(edges.select("a", "b")))
    labels = None
    rounds = 0
    while not live.isEmpty():
        roots = _hooked(live, rounds)
        labels = roots if labels is None else cut_lineage(
            labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("onward")), "root", "left")
            .select("node", F.coalesce("onward", "root").alias("root"))
            .unionByName(roots.join(labels.select("node"), "node", "left_anti")))
        ends = live.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        live = cut_lineage(_between(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        rounds += 1
    if labels is None:
        return nodes.select("node", F.col("node").alias("component")), rounds
    # The smallest member names the component; a root is a member of its own.
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    named = labels.join(smallest, "root").select("node", "component")
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), rounds


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the smaller end first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hooked(edges: DataFrame, seed: int) -> DataFrame:
    """``(node, root)`` of every node with an edge after one hooking, trees flattened."""
    def rank(node: str):
        return F.struct(F.xxhash64(node, F.lit(seed)).alias("h"), F.col(node).alias("n"))

    both = edges.select(F.col("a").alias("own"), rank("b").alias("near")).unionByName(
        edges.select(F.col("b").alias("own"), rank("a").alias("near")))
    parents = cut_lineage(both.groupBy("own").agg(F.min("near").alias("near")).select(
        F.col("own").alias("node"), F.least(rank("own"), "near")["n"].alias("root")))
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        jumped = cut_lineage(parents.join(up, "root").select("node", F.col("onward").alias("root"), (F.col("onward") != F.col("root")).alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents
