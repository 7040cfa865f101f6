"""Connected components of an edge table, and groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rows of (node, root) up to which a table is broadcast, 16 bytes each.
BROADCAST_ROWS = 500_000


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), of type long.

    Every round hooks each node onto its smallest neighbour and contracts the
    graph, which at least halves the nodes that still have edges; a star of any
    size is one round, done by a partial aggregate. All tables stay distributed
    and are written to the shared folder between rounds; ``scratch`` collects their paths.
    """
    both = edges.filter("a != b").select("a", "b")
    live = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", scratch)
    labels = None
    while not live.isEmpty():
        hooks = materialize(live.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "hooks", scratch)
        few = hooks.count() <= BROADCAST_ROWS
        small = F.broadcast if few else (lambda table: table)  # counted; larger tables are joined by a shuffle
        if labels is None:
            labels = hooks
        else:
            moved = small(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")))
            labels = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels", scratch)
        at_a = small(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")))
        at_b = small(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")))
        live = materialize(live.join(at_a, "a").join(at_b, "b").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges", scratch)
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, from batches sorted by a long column, and the rows where groups start (and the end).

    Holds one group and one batch at a time.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if cut == 0 and (last is None or last == keys[0]):
            rest.append(batch)
        elif cut == 0:
            yield _joined(rest, key)
            rest = [batch]
        else:
            yield _joined([*rest, batch.slice(0, cut)], key)
            rest = [batch.slice(cut)]
        last = keys[-1]
    if rest:
        yield _joined(rest, key)


def _joined(parts: list[pa.RecordBatch], key: str) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
    return batch, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of 0..n-1 can reach over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
