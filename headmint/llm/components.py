"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import stored

HELD_EDGES = 1_000_000  # that a task contracts at once


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of a list of edges, without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while (low[low] != low).any():
            low = low[low]
        new = low[label]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        n, r = local_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch({"u": pa.array(n), "v": pa.array(r)})

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= HELD_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components: each task turns what it holds into stars."""
    return edges.select("u", "v").mapInArrow(_contract, "u bigint, v bigint")


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; partial minima run before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _min_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: a node is either below one node, or above others."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down + up > 1").isEmpty()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges(u, v).

    Nulls and loops are dropped. Each round is written to the shared folder, so lineage
    stays short; the driver learns only whether it was the last. A node's neighbours are
    never gathered: only minima are taken, and tasks contract bounded lists of edges.
    """
    e = stored(contracted(edges.filter("u <> v")).distinct(), f"{folder}/0")
    for k in count(1):
        if _settled(e):
            break
        e = stored(contracted(_small_star(_large_star(e))).distinct(), f"{folder}/{k}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
