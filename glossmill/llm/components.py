"""Connected components of a graph of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): a row (node, root) for each node, root being the smallest node it can reach.

    Links may repeat, point either way or to themselves; nulls are dropped.
    Each round lets every node point to its smallest neighbour and that
    neighbour's other neighbours to it; the rounds needed grow with the
    logarithm of the longest path.  Neighbours are never gathered: minima are
    pre-aggregated and joined back, which Spark can split at a hub.
    """
    bigger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = _stored(links.where("a is not null and b is not null and a <> b").select(bigger, smaller).distinct())
    known = None
    while known != (state := tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())):
        known = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _stored(small.union(least.select("a", "m")).distinct(), edges)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _stored(edges: DataFrame, old: DataFrame | None = None) -> DataFrame:
    new = store.stage(edges, "edges")
    if old is not None:
        store.drop(old)
    return new
