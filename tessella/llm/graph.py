"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return ties.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a < b")


def _shared(edges: DataFrame) -> bool:
    """Whether some end of an edge has several starts."""
    return bool(edges.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low < high").head(1))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b: two integer columns): the label is
    the smallest id of the component.

    Large-star and small-star rounds alternate until nothing changes; a hub's
    links are only aggregated and joined, never collected, and each round is a
    written table.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = written(edges, "links")
    # done when no end of an edge is another edge's start
    while edges.select(F.col("b").alias("x")).join(edges.select(F.col("a").alias("x")), "x", "left_semi").head(1) or _shared(edges):
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "links")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).union(edges.select(F.col("a"), F.col("a")).distinct())
