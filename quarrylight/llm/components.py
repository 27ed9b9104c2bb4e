"""Connected components of a table of links, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers to their ends; the distance covered doubles with every step."""
    while True:
        far = parents.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        jumped = written(parents.join(far, parents.root == far.mid).select("node", F.col("root").alias("old"), F.col("far").alias("root")), "roots")
        drop_written(parents)
        parents = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable.

    Each round points every node to its least neighbour, follows the pointers to their ends, and replaces the edges
    by the distinct ones between different ends. A dense group shrinks to a point in the first round, so its edges
    are read once only, and nodes at least halve from round to round. Tables are written after every step, so a lost
    executor costs one step. Loops are ignored, but their node has a row; no edges give no rows. The first round reads
    `edges` more than once, so hand in a written table.
    """
    live, total = edges.select(F.col(a).alias("u"), F.col(b).alias("v")), None
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        ends = _roots(written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "parents"))
        first = total is None
        if first:
            total = ends
        else:
            moved = ends.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            new = written(total.join(moved, total.root == moved["_node"], "left").select("node", F.coalesce("_root", "root").alias("root")), "total")
            drop_written(total)
            total = new
        left, right = ends.select(F.col("node").alias("u"), F.col("root").alias("x")), ends.select(F.col("node").alias("v"), F.col("root").alias("y"))
        between = live.join(left, "u").join(right, "v").filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        new = written(between, "edges")
        if not first:
            drop_written(live)
        live = new
    return live.select(F.col("u").alias("node"), F.col("v").alias("root")) if total is None else total
