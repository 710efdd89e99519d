"""Connected components by alternating large and small stars, over edges of any number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import written


class Forest:
    """Disjoint sets; the smallest member names its set."""

    def __init__(self) -> None:
        self.up: dict[int, int] | dict[str, str] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def __len__(self) -> int:
        return len(self.up)

    def stars(self, kind: pa.DataType | None = None) -> pa.RecordBatch:
        """An edge (u, v) from each member to the smallest of its set; members are numbers if no other kind is named."""
        kind = kind or pa.int64()
        found = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([r for _, r in found], kind)], ["u", "v"])


#: Edges that a task contracts at once.
BLOCK = 1 << 18


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with fewer edges: each block's forest as stars."""
    forest, n, kind = Forest(), 0, None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        n += batch.num_rows
        if n >= BLOCK:
            yield forest.stars(kind)
            forest, n = Forest(), 0
    if kind is not None:
        yield forest.stars(kind)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of two columns with the same components and all their ends, but fewer edges, before any is moved; no end may be null."""
    a, b = edges.columns
    return edges.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(x.columns, [a, b]) for x in _contracted(batches)), edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of edges (u, v): component is the smallest id that can be reached.

    Edges are contracted where they are read, and point to the smaller end. A round lets each edge jump to the least parent of its end (large star), links all
    ends of a vertex to the least of them (small star), and contracts what lies together. Each round is written, so a lost
    executor repeats one round. Least parents are written too, so that a hub's edges meet them in a join that can be split;
    after the first contraction a vertex has at most as many parents as there are blocks."""
    now, state = written(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(_contracted, "u long, v long").distinct(), "edges"), None
    while True:
        parents = written(now.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("m")), "parents")
        jumped = now.join(parents, F.col("v") == F.col("p"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = jumped.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.when(F.col("v") != F.col("m"), F.array("u", "v")).otherwise(F.array("u"))
        linked = least.select(F.explode(ends).alias("u"), F.col("m").alias("v"))
        now = written(linked.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
