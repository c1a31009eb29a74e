"""Connected components of a table of edges, by alternating star contractions, each a join and an aggregation."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, staged

#: Edges that a task contracts by itself at a time, before tables are joined.
TOGETHER = 500_000


def _contracted(batches):
    """The stars of the components that so many edges at a time have among themselves."""
    held, size = [], 0
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
        if held and (batch is None or size >= TOGETHER):
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            i, j = at[: len(a)], at[len(a) :]
            label = np.arange(len(nodes))
            while True:
                low = label.copy()
                np.minimum.at(low, i, label[j])
                np.minimum.at(low, j, label[i])
                low = low[low]
                if np.array_equal(low, label):
                    break
                label = low
            k = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[label[k]]), pa.array(nodes[k])], names=["a", "b"])
            held, size = [], 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("m").alias("a"), "b")
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node in edges(a, b). Edges of a node with itself and repeated ones add
    nothing, no edge may have a null, and no edges give no rows."""
    now = staged(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        after = staged(_small_star(_large_star(now)), "edges")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(now)
        now = after
        if mark == seen:
            break
        seen = mark
    # a forest of stars now: a is the least node
    out = now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    out._staged_path = now._staged_path  # type: ignore[attr-defined]
    return out
