"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.store import materialise

ROUNDS = 100  #: far above the logarithm of any table's length
LINKS = 500_000  #: links that one task joins in memory at once


def join_locally(links: DataFrame) -> DataFrame:
    """Links (u, v) of each partition, LINKS at a time, as links of every node to its least one."""

    def run(batches):
        root: dict = {}
        kind = None

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def take():
            nodes = list(root)
            out = pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["u", "v"])
            root.clear()
            return out.filter(pa.array(np.not_equal(out.column(0).to_numpy(), out.column(1).to_numpy())))

        n = 0
        for b in batches:
            kind = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root.setdefault(u, u)
                root.setdefault(v, v)
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
                n += 1
            if n >= LINKS:
                yield take()
                n = 0
        if root:
            yield take()

    kind = links.schema["u"].dataType.simpleString()
    return links.mapInArrow(run, f"u {kind}, v {kind}")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (id, component): the smallest id reachable, for every id with a link.

    Links are joined inside their partitions first. Then, until all that is left are stars around
    least nodes, alternating large-star and small-star steps: each is a minimum by key joined back
    to the edges, so no neighbourhood is gathered, and the rounds grow with the logarithm of the
    longest path. Repeated links, loops and an empty table are fine.
    """
    # as few partitions as LINKS allows: a small table is done at once, a large one in parallel
    parts = max(1, -(-links.count() // LINKS))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).repartition(parts)
    edges = materialise(join_locally(edges), "edges")
    for _ in range(ROUNDS):
        ends = edges.select(F.col("u").alias("id"), "v", F.lit(0).alias("inner")).unionByName(edges.select(F.col("v").alias("id"), F.lit(None).cast(edges.schema["v"].dataType).alias("v"), F.lit(1).alias("inner")))
        stars = ends.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("inner").alias("inner"))
        if stars.where("lo < hi or (lo is not null and inner = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = materialise(join_locally(small.where("u <> v").distinct().repartition(parts)), "edges")
    else:
        raise RuntimeError(f"components are not joined after {ROUNDS} rounds")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    loops = links.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component")).unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))
