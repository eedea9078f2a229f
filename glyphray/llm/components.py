"""Connected components of a graph given by its edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphray.llm.store import scratch, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` long): the root is the component's smallest node.

    Loops and repeated edges are allowed. Each round moves the larger neighbours of every node, then the smaller ones,
    to the smallest of them, until nothing changes: a number of rounds logarithmic in the size. Minima are combined
    before they are shuffled, and the joins' sides are plain exchanges, so a hub is no bottleneck.
    """
    with scratch(edges.sparkSession):
        pairs = stored(
            edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges"
        )
        seen = _mark(pairs)
        while seen[0]:
            pairs = stored(_small_star(stored(_large_star(pairs), "edges")), "edges")
            mark = _mark(pairs)
            if mark == seen:
                break
            seen = mark
        roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return stored(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots", keep=True)


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v"), F.col("u")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-least")
    # each edge is seen from its smaller end, whose larger neighbour moves
    moved = pairs.select(F.col("u").alias("far"), F.col("v").alias("u")).join(least, "u")
    return moved.select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u > v").distinct()
