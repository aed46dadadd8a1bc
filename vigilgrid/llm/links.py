"""Components of similar sets that meet under keys, without emitting all pairs of a group.

Sets that share a key are to be compared. In a few rounds every set meets two pivots of each of its
keys, one of the key's largest component and one drawn anew, and the best of them are compared: what
links is one component. Keys whose sets are then all in one component are done. In the others, the
pairs between components are joined; that join carries bounds of the overlap, so a pair that cannot
link is no row. No link is lost: every pair that shares a key and is not in one component by then is
either excluded by a bound or compared on whole sets.

Bounds: sizes; ``rem``, the tokens from the key on under a global order (0-based place, so at most
that many can be shared); and parity bitmaps, whose Hamming distance is at most the size of the
symmetric difference. A pair that shares several keys is a row under the first of them only: a key's
``marks`` are the first common entries of the sets' ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.operators.graph import connected_components
from vigilgrid.session import cut_lineage

#: 64-bit words of a parity bitmap; rounds with pivots; pivots that a set is compared with in one.
WORDS, ROUNDS, MET = 8, 3, 2


def parities(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bitmap for each row, which has the next ``n`` tokens: bit b tells whether an odd number fall on it."""
    out = np.zeros((len(n), WORDS), np.int64)
    ends = np.cumsum(n)
    for a in range(0, len(n), 4096):
        b = min(len(n), a + 4096)
        own = tokens[(ends[a] - n[a]):ends[b - 1]]
        at = np.repeat(np.arange(b - a), n[a:b]) * (64 * WORDS) + (own % np.uint64(64 * WORDS)).astype(np.int64)
        odd = (np.bincount(at, minlength=(b - a) * 64 * WORDS) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd, bitorder="little").view(np.int64).reshape(b - a, WORDS)
    return out


def least_shared(n: str, m: str, percent: int) -> Column:
    """Tokens that similar sets of these sizes share at least."""
    return F.floor((percent * (F.col(n) + F.col(m)) + 99 + percent) / (100 + percent))


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _bits_fit(n: str, m: str, a: str, b: str, percent: int) -> Column:
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)), F.lit(0))
    return apart <= F.col(n) + F.col(m) - 2 * least_shared(n, m, percent)


def crowded(keys: DataFrame, percent: int) -> DataFrame:
    """``keys(set, key, n, rem)`` without the rows that meet no other set: the smaller set of a pair
    needs a key from which on twice its size allows the overlap."""
    index = F.col("rem") * (100 + percent) >= 2 * percent * F.col("n")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(index).alias("i")).where("c > 1 AND i").select("key")
    return cut_lineage(keys.join(held, "key"))


def components(keys: DataFrame, sets: DataFrame, percent: int, further: Callable[[DataFrame, DataFrame], DataFrame] = lambda pairs, sets: pairs) -> DataFrame:
    """``set, component`` of all ``sets(set, n, bits, tokens, orders)``; ``keys(set, key, n, rem, marks)``
    as ``crowded`` returns them; ``further`` takes pairs away that cannot link, before whole sets are
    compared. ``orders`` and ``marks`` are arrays of equal length, of lists and of entries of these."""
    label = sets.select("set", F.col("set").alias("component"))
    now = keys.withColumn("component", F.col("set"))
    for turn in range(ROUNDS):
        met = _bounded(_met(now, turn, percent), sets, percent)
        label = _joined(label, cut_lineage(_verified(further(met, sets), sets, percent)))
        now = cut_lineage(_open(now.drop("component").join(label, "set")))
        if now.isEmpty():
            return label
    return _joined(label, cut_lineage(_verified(further(_between(now, sets, percent), sets), sets, percent)))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after everything that links connect is one component."""
    a = label.select("set", F.col("component").alias("a"))
    b = label.select(F.col("set").alias("other"), F.col("component").alias("b"))
    edges = cut_lineage(links.join(a, "set").join(b, "other").where("a <> b").select("a", "b").distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    onward = connected_components(ends, edges).toDF("component", "onward")
    return cut_lineage(label.join(onward, "component", "left").select("set", F.coalesce("onward", "component").alias("component")))


def _open(now: DataFrame) -> DataFrame:
    """Rows of keys whose sets are in several components, with the largest of these as ``most``."""
    sizes = now.groupBy("key", "component").count()
    most = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return now.drop("most").join(most.select("key", "most"), "key")


def _met(now: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a set and the pivots that most of its keys name."""
    draw = F.xxhash64("set", F.lit(turn))
    by = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("set", "n", "component"), draw).alias("p"))
    drawn = by.groupBy("key").agg(F.max_by("p", F.struct("c", F.xxhash64("p.set", F.lit(turn)))).alias("x"),
                                  F.min_by("p", F.xxhash64("p.set", F.lit(turn))).alias("y"))
    each = now.join(drawn, "key").select("set", "n", "component", F.explode(F.array_distinct(F.array("x", "y"))).alias("p"))
    pairs = each.where("component <> p.component").where(_sizes_fit("n", "p.n", percent)).groupBy("set", F.col("p.set").alias("other")).count()
    best = pairs.groupBy("set").agg(F.max_by("other", F.struct("count", "other")).alias("a"),
                                    F.max_by("other", F.struct("count", F.xxhash64("other"))).alias("b"))
    return best.select("set", F.explode(F.array_distinct(F.array("a", "b"))).alias("other"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps allow."""
    a = sets.select("set", "n", "bits")
    both = pairs.join(a, "set").join(a.toDF("other", "m", "far"), "other")
    return both.where(_sizes_fit("n", "m", percent) & _bits_fit("n", "m", "bits", "far", percent)).select("set", "other")


def _between(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between components of a key that no bound excludes. A key's largest component meets the
    others only; pairs meet by classes of size, similar ones being at most one class apart."""
    size = F.floor(F.log("n") / float(np.log(100 / percent)))
    rows = now.join(sets.select("set", "bits", "orders"), "set")
    few = rows.where("component <> most").select("key", "marks", "most", F.col("set").alias("a"), F.col("n").alias("na"), F.col("rem").alias("ra"), F.col("bits").alias("ba"),
                                                 F.col("orders").alias("oa"), F.col("component").alias("ca"), F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    every = rows.select("key", "set", "n", "rem", "bits", "orders", "component", size.alias("size"))
    fits = (F.least("ra", "rem") >= least_shared("na", "n", percent)) & _sizes_fit("na", "n", percent) & _bits_fit("na", "n", "ba", "bits", percent)
    first = F.expr("forall(sequence(0, size(marks) - 1), i -> get(array_intersect(get(oa, i), get(orders, i)), 0) = get(marks, i))")
    return few.join(every, ["key", "size"]).where(F.expr("ca <> component AND (component = most OR a < set)") & fits & first).select(
        F.col("a").alias("set"), F.col("set").alias("other")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar; ``tokens`` may leave out those that no other set has."""
    both = pairs.join(sets.select("set", "n", "tokens"), "set").join(
        sets.select(F.col("set").alias("other"), F.col("n").alias("m"), F.col("tokens").alias("u")), "other")
    same = F.size(F.array_intersect("tokens", "u"))
    return both.where(100 * same >= percent * (F.col("n") + F.col("m") - same)).select("set", "other")


def named(summary: DataFrame, links: DataFrame) -> DataFrame:
    """``summary(id, n, set, ...)`` with ``component``, a set of the row's component, and ``component_id``,
    the component's smallest id (null if no row of it has one); of rows without words their own id."""
    ids = summary.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    of = ids.join(links, "set", "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    smallest = of.join(links.select("component").distinct(), "component").groupBy("component").agg(F.min("least").alias("smallest"))
    names = of.join(smallest, "component", "left").select("set", "component", F.coalesce("smallest", "least").alias("name"))
    return summary.join(names, "set", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))).drop("name")
