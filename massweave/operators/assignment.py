"""Globally optimal one-to-one assignment of candidate pairs.

The result maximises the sum of the confidences, leaving rows unpaired where that is better;
this is maximum-weight matching in the bipartite graph of the candidate pairs, which falls
apart into its connected components.

1. Pairs whose rows have no other pair are taken as they are.
2. Stars, where all pairs share one row and their other rows have no other pair, keep their
   best pair.
3. Among the rest, a pair worth at least as much as the next best pairs of both its rows
   together is in some optimum: whatever replaces it cannot be worth more.  Such pairs are
   taken and their rows removed, which uncovers others; a few rounds of this shrink what is
   contested without looking at whole components.
4. What remains is labelled by component (the smallest row reachable, by exchanging minima along
   the edges in rounds, each round written to the shared checkpoint folder), and each
   component is solved by shortest augmenting paths on its own sparse edges.

Ties go to the smaller ids.  A pair of confidence 0 is taken where both its rows are free
otherwise.  A component has to fit into one task, in memory proportional to its pairs; what
the steps before settle never reaches that step.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.plans.runtime import cut_lineage

#: Rounds in which dominant pairs are taken.
DOMINANT_ROUNDS = 6

#: Gain of a pair of confidence 0, so that it is taken where it costs nothing.
_LEAST_GAIN = 1e-12


def with_degrees(edges: DataFrame) -> DataFrame:
    """Add ``deg_a`` and ``deg_b``, the number of pairs of each row, and the largest degree among neighbours."""
    a, b = W.partitionBy("idx_a"), W.partitionBy("idx_b")
    counted = edges.withColumn("deg_a", F.count(F.lit(1)).over(a)).withColumn("deg_b", F.count(F.lit(1)).over(b))
    return counted.withColumn("far_b", F.max("deg_b").over(a)).withColumn("far_a", F.max("deg_a").over(b))


def isolated(degrees: DataFrame) -> DataFrame:
    """Pairs whose rows have no other pair."""
    return degrees.where("deg_a = 1 AND deg_b = 1")


def _in_star(degrees: DataFrame) -> DataFrame:
    """Pairs of stars: around a row of A, or around a row of B."""
    return degrees.where("(deg_a > 1 AND far_b = 1) OR (deg_b > 1 AND far_a = 1)").withColumn(
        "centre", F.when(F.col("deg_a") > 1, F.struct(F.lit("a").alias("side"), F.col("idx_a").alias("idx"))).otherwise(F.struct(F.lit("b").alias("side"), F.col("idx_b").alias("idx")))
    )


def best_of_stars(degrees: DataFrame) -> DataFrame:
    """The best pair of each star."""
    best = _in_star(degrees).groupBy("centre").agg(F.min(F.struct((-F.col("confidence")).alias("cost"), "idx_a", "idx_b")).alias("r"))
    return best.select("r.idx_a", "r.idx_b", (-F.col("r.cost")).alias("confidence"))


def contested(degrees: DataFrame) -> DataFrame:
    """Pairs that are neither isolated nor in a star."""
    star = "(deg_a > 1 AND far_b = 1) OR (deg_b > 1 AND far_a = 1)"
    return degrees.where(f"NOT (deg_a = 1 AND deg_b = 1) AND NOT ({star})").select("idx_a", "idx_b", "confidence")


def with_dominant(edges: DataFrame) -> DataFrame:
    """Add ``dominant``: whether a pair is the best of both its rows and worth the next best of both together."""

    def ranked(df: DataFrame, side: str, other: str) -> DataFrame:
        order = W.partitionBy(side).orderBy(F.desc("confidence"), other)
        whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.withColumn(f"_k_{side}", F.row_number().over(order)).withColumn(f"_next_{side}", F.coalesce(F.nth_value("confidence", 2).over(whole), F.lit(0.0)))

    both = ranked(ranked(edges, "idx_a", "idx_b"), "idx_b", "idx_a")
    mark = F.expr("_k_idx_a = 1 AND _k_idx_b = 1 AND confidence >= _next_idx_a + _next_idx_b")
    return both.select("idx_a", "idx_b", "confidence", mark.alias("dominant"))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Add ``component``: the smallest ``idx_a`` of the connected component of each pair.

    Each round passes the least label of a row of A over its rows of B and back, then jumps
    to the label's own label, which halves long paths.
    """
    current = cut_lineage(edges.withColumn("component", F.col("idx_a")))
    for _ in range(most_rounds):
        over_b = current.groupBy("idx_b").agg(F.min("component").alias("_m"))
        over_a = current.join(over_b, "idx_b").groupBy("idx_a").agg(F.min("_m").alias("_m"))
        # The label is itself a row of A, whose own least label is known already.
        jump = over_a.select(F.col("idx_a").alias("_m"), F.col("_m").alias("_root"))
        labels = over_a.join(jump, "_m", "left").select("idx_a", F.least("_m", F.coalesce("_root", "_m")).alias("_new"))
        after = cut_lineage(current.join(labels, "idx_a").withColumn("_changed", F.col("_new") < F.col("component")))
        current = after.select(*edges.columns, F.least("_new", "component").alias("component"))
        if after.where("_changed").isEmpty():
            return current
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def solve_component(a: list[int], b: list[int], gain: list[float]) -> list[tuple[int, int]]:
    """Maximum-weight matching of one component by shortest augmenting paths.

    Every row of A also has a private partner of gain 0, so each can always be paired; the
    cheapest complete pairing is then the heaviest matching.  Rows are added one after the
    other.  For each the cheapest alternating path to a free partner is searched; potentials
    keep all reduced costs non-negative, so the search is a Dijkstra on the sparse pairs.
    """
    rows, partners = sorted(set(a)), sorted(set(b))
    row_at, partner_at = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(partners)}
    cost: list[dict[int, float]] = [{len(partners) + k: 0.0} for k in range(len(rows))]
    for x, y, g in zip(a, b, gain):
        own, j = cost[row_at[x]], partner_at[y]
        own[j] = min(own.get(j, 0.0), -g if g > 0 else -_LEAST_GAIN)
    row_price = [min(c.values()) for c in cost]
    price: dict[int, float] = defaultdict(float)
    partner_of: dict[int, int] = {}
    owner_of: dict[int, int] = {}
    for start in range(len(rows)):
        near: dict[int, float] = {}
        came: dict[int, int] = {}
        settled: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for j, c in cost[row].items():
                d = base + max(0.0, c - row_price[row] - price[j])
                if j not in settled and d < near.get(j, float("inf")):
                    near[j], came[j] = d, row
                    heapq.heappush(heap, (d, j))
            while True:
                base, end = heapq.heappop(heap)
                if end not in settled and base == near[end]:
                    break
            if end not in owner_of:
                break
            settled[end] = base
            row = owner_of[end]
        row_price[start] += base
        for j, d in settled.items():
            row_price[owner_of[j]] += base - d
            price[j] -= base - d
        while True:
            row = came[end]
            partner_of[row], owner_of[end], end = end, row, partner_of.get(row)
            if row == start:
                break
    return [(rows[k], partners[j]) for k, j in sorted(partner_of.items()) if j < len(partners)]


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["idx_a", "idx_b"])
    pairs = solve_component(group["idx_a"].tolist(), group["idx_b"].tolist(), group["confidence"].tolist())
    return pd.DataFrame(pairs, columns=["idx_a", "idx_b"]).astype("int64")


def assign(edges: DataFrame) -> DataFrame:
    """``(idx_a, idx_b)`` of the optimal assignment of ``(idx_a, idx_b, confidence)``."""
    degrees = cut_lineage(with_degrees(edges.select("idx_a", "idx_b", "confidence")))
    easy = isolated(degrees).select("idx_a", "idx_b").unionByName(best_of_stars(degrees).select("idx_a", "idx_b"))
    hard = contested(degrees)
    for _ in range(DOMINANT_ROUNDS):
        # One write a round: the pairs that are left, with the dominant ones marked.
        marked = cut_lineage(with_dominant(hard))
        taken, hard = marked.where("dominant").select("idx_a", "idx_b"), marked.select("idx_a", "idx_b", "confidence")
        if taken.isEmpty():
            break
        easy = easy.unionByName(taken)
        hard = hard.join(taken.select("idx_a"), "idx_a", "left_anti").join(taken.select("idx_b"), "idx_b", "left_anti")
    if hard.isEmpty():
        return easy
    solved = components(hard).groupBy("component").applyInPandas(_solve, "idx_a bigint, idx_b bigint")
    return easy.unionByName(cut_lineage(solved))
