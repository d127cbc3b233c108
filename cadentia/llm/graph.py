"""Connected components of an edge list.

Up to ONE_TASK edges, counted first, are solved in one task on arrays; more go
through rounds of alternating large and small stars, whose joins and aggregates
hold no component in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, longs

#: Edges that one task may hold (16 bytes each).
ONE_TASK = 1_000_000


def toward_min(pairs: DataFrame) -> DataFrame:
    """u, v -> v, m: m the least of u and its partners, for each partner v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each can reach: labels go along edges and then along labels, until none falls."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def in_one_task(edges: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(longs(b, "u"), longs(b, "v")) for b in batches]
        if found:
            node, label = labelled(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])

    return arrow_map(edges.coalesce(1), kernel, "node long, label long")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) -> (node, label): the label is the least node that can be reached.

    Only nodes with an edge to another appear.  A round of stars is two
    shuffled joins over the edges left, and its rows are written to the shared
    checkpoint folder.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.limit(one_task + 1).count() <= one_task:
        return durable(in_one_task(now))
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = toward_min(large)
        now = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = state
