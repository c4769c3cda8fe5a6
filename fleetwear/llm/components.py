"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.session import stage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) of all nodes with edges; ``label`` is the smallest node of the component.

    ``edges``: (a, b), any order, repeats and loops allowed. Large-star and
    small-star steps by turns: every node tells its larger (or not larger)
    neighbours about the smallest one it knows. The number of rounds grows
    with the logarithm of the component's size. Only the smallest neighbour of
    a node is aggregated, so a hub is combined before the shuffle.
    """
    now = stage(_clean(edges), "edges")
    mark = _mark(now)
    while True:
        now = stage(_small_star(_large_star(now)), "edges")
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return _clean(
        both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    joined = edges.join(least, F.col("a") == F.col("c"))
    return _clean(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))))
