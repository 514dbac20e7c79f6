"""Connected components: first inside each partition of the edges, then by label propagation with
shortcuts over what is left. Every round is written down, so lineage stays short and a lost executor
costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Edges per task, about.
TASK_ROWS = 50_000


def groups(a: list[int], b: list[int]) -> dict[int, int]:
    """Node -> smallest node of its component, for the edges (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _stars(batches):
    """The edges of a partition as an edge from each node to the smallest it reaches there."""
    import pyarrow as pa

    a, b = [], []
    for batch in batches:
        a += batch.column("a").to_pylist()
        b += batch.column("b").to_pylist()
    found = groups(a, b)
    columns = [pa.array(list(x), pa.int64()) for x in (found.keys(), found.values())]
    yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is its smallest node."""
    spark = edges.sparkSession
    stars = stage(edges.select("a", "b").mapInArrow(_stars, "a bigint, b bigint"), "stars")
    # Few edges are left as a rule: as many tasks as their number asks for.
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-stars.count() // TASK_ROWS)))
    both = stars.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(stars.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stage(both.distinct().coalesce(tasks), "edges")
    labels = both.groupBy("node").agg(F.min("other").alias("component"))
    labels = stage(labels.coalesce(tasks), "labels")
    while True:
        near = both.join(
            labels.select(F.col("node").alias("other"), F.col("component").alias("_c")), "other"
        )
        near = near.groupBy("node").agg(F.min("_c").alias("_c"))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "_c").alias("to")
        )
        # The label's own label is at most as large.
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("_j"))
        step = step.join(jump, "to", "left").select(
            "node", "was", F.least("to", F.coalesce("_j", F.col("to"))).alias("component")
        )
        step = stage(step.coalesce(tasks), "labels")
        labels = step.select("node", "component")
        if step.filter("was != component").isEmpty():
            return labels
