"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.session import Rounds


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "_m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these. ``u > v`` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = F.array(*[F.struct(F.col(c).alias("u"), F.col("_m").alias("v")) for c in ("u", "v")])
    return edges.join(least, "u").select(F.explode(moved).alias("_e")).select("_e.*").filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node is linked to one smaller node or only to larger ones, so each component is a star around its smallest."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0))])
    nodes = edges.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node, label``: the smallest node of its component for every node that isn't the smallest itself.

    ``edges`` has two comparable columns ``a, b``, without nulls. Hubs are only
    ever reduced by map-side minima and joined to one row per node. The rounds
    end when every component is a star, which one aggregation tells, so no
    round is run only to change nothing; their number grows as the logarithm
    of the longest path. Jobs and tasks are kept few: the driver holds a record
    of each for as long as the session lives.
    """
    rounds = Rounds(name)
    start = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    table = rounds.save(start.distinct())
    while not _settled(table):
        table = rounds.save(_small_star(_large_star(table)))
    return table.select(F.col("u").alias("node"), F.col("v").alias("label"))


def with_labels(nodes: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the label of ``node`` as column ``name``; a node without edges is its own label."""
    found = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return nodes.join(found, node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")
