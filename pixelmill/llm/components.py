"""Connected components of a distributed edge table.

Rounds of two star operations (large-star, then small-star) over tables in the shared folder; the driver sees only
a count and a checksum of each round. Every join is of two written tables, so adaptive execution can split a hub's
rows; minima are combined before they are shuffled. The rounds needed grow with the logarithm of the node count.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges a-b, without the smallest nodes themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Forest:
    """Edges of one task, folded into a spanning forest whenever enough of them have gathered."""

    def __init__(self, fold_at: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.fold_at = 0, fold_at

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.held += len(a)
            if self.held > self.fold_at:
                self.fold()
                self.fold_at = max(self.fold_at, 2 * self.held)

    def fold(self) -> None:
        if self.parts:
            self.parts = [forest(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.held = len(self.parts[0][0])

    def edges(self) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        self.fold()
        return self.parts


def _stars(scratch: Scratch, links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (u > v)."""
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = links.unionByName(back) if large else links
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    if large:  # every larger neighbour of u goes to the least of them all
        out = back.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and all its smaller neighbours go to the least
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.table(out.where("u > v").distinct(), "stars")
    scratch.drop(least)
    return out


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of each node of the edges that is not the smallest of its component."""
    links = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        whole = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]  # sums of 64 bits, twice
        state = links.agg(F.count("*").alias("n"), *whole).first()
        if state == before or not state["n"]:
            break
        before, old = state, links
        grown = _stars(scratch, links, True)
        links = _stars(scratch, grown, False)
        scratch.drop(grown)
        scratch.drop(old)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
