"""Connected components: contraction in joins and aggregations, the bounded rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import column, remove, shared_folder, written

#: Edges that one task connects; parts of a parent that very many nodes have.
SMALL, SALTS = 1 << 20, 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), rising, and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[label]
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


class Forest:
    """Collects edges in a task and keeps what connects: an edge a node at most."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.count, self.full = 0, 1 << 18

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.count += len(a)
        if self.count > self.full:
            self.held = [self.stars()]
            self.count = len(self.held[0][0])
            self.full = max(1 << 18, 2 * self.count)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*self.held, strict=True)))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is not the least of its component, with the least one."""
        node, label = self.labels()
        out = node != label
        return label[out], node[out]

    def rows(self) -> Iterator[pa.RecordBatch]:
        a, b = self.stars()
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Forest()
    for batch in batches:
        found.add(column(batch, "a").to_numpy(), column(batch, "b").to_numpy())
    node, label = found.labels()
    for i in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(label[i : i + (1 << 16)])], ["node", "label"])


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b); nodes have one label if edges connect them, the label is a node of them.

    Each round every node goes to the neighbour that is first in an order drawn anew, itself included, and
    edges go from where their ends went: nodes that no other goes to are gone, about a third of them at
    least, whatever the shape of the graph. What ``small`` edges are left at most, one task connects; then the
    rounds are undone. Minima are combined before the shuffle and joins by parent are salted, so a node with
    very many neighbours is no burden.
    """
    spark, where, steps = edges.sparkSession, shared_folder(edges.sparkSession), []
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{where}/edges-0")
    while left.count() > (SMALL if small is None else small):
        n = len(steps)
        order = lambda c: F.struct(F.xxhash64(c, F.lit(n)), F.col(c).alias("to"))  # noqa: E731, B023
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", order("a")).getField("to").alias("parent"))
        steps.append(written(first, f"{where}/parents-{n}"))
        moved = left.join(steps[-1].select(F.col("node").alias("a"), F.col("parent").alias("c")), "a").join(steps[-1].select(F.col("node").alias("b"), F.col("parent").alias("d")), "b")
        left = written(moved.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).where("a <> b").distinct(), f"{where}/edges-{n + 1}")
        remove(spark, f"{where}/edges-{n}")
    found = left.repartition(1).mapInArrow(_connect, "node long, label long")
    for n, step in reversed(list(enumerate(steps))):
        spread = found.select(F.col("node").alias("parent"), "label", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        found = written(salted.join(spread, ["parent", "salt"], "left").select("node", F.coalesce("label", "parent").alias("label")), f"{where}/labels-{n}")
    return found if steps else written(found, f"{where}/labels")
