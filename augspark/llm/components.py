"""Connected components of a table of links, by alternating star steps.

Each round links every node to the smallest node it sees (first the larger neighbours, then the smaller
ones), which shortens all paths at least by half, so rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augspark.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); the root is the component's smallest node.

    u and v are numbers; links to oneself and repeated links do no harm. No links give an empty table.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: the same for the same table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(a, b) -> list[tuple[int, int]]:
    """Of links (a[i], b[i]) between numbers, as few as hold the same nodes together: each node with the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            parent.setdefault(min(x, y), min(x, y))
    return [(x, find(x)) for x in parent if find(x) != x]
