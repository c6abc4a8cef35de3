"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.shared import written

PLACES = 256


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, component): the smallest node reachable, for every node that has an edge.

    Each step only needs the smallest neighbour of a node. A hub, which may have a third of all edges, is never brought
    into one task: its smallest neighbour is aggregated before the shuffle and sent to the PLACES places over which its
    edges are dealt. Edges are written to the shared folder between rounds. The number of rounds is logarithmic in the
    component size; a table that is already in its final form takes none.
    """
    edges = written(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    while not _are_stars(edges):
        placed = edges.withColumn("place", F.pmod(F.xxhash64("a"), F.lit(PLACES)))  # b is the smaller end
        ends = placed.selectExpr("b node", "a other", "place").union(placed.selectExpr("a node", "b other", "NULL place"))
        low = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("m"), *_marks())
        sent = low.select(F.col("node").alias("b"), "m", F.explode(_marked()).alias("place"))
        large = placed.join(sent, ["b", "place"]).selectExpr("a", "m b").distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        # The row with b = m, one for each a, leads from a itself to m, the others from b.
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = written(small, "edges")
    return edges.selectExpr("a node", "b component").union(edges.selectExpr("b node", "b component").distinct())


def _marks() -> list[Column]:
    """Aggregates: the places of a group, as bits of PLACES / 64 longs, so that they need no shuffle of their own."""
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS int))")
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 64) == k, bit)), F.lit(0).cast("long")).alias(f"mark{k}") for k in range(PLACES // 64)]


def _marked() -> Column:
    """Array of the places that `_marks` has seen."""
    return F.concat(*(F.expr(f"transform(filter(sequence(0, 63), p -> getbit(mark{k}, p) = 1), p -> p + {64 * k}L)") for k in range(PLACES // 64)))


def _are_stars(edges: DataFrame) -> bool:
    """Whether all edges lead straight to a smallest node, so that no further step would change them."""
    ends = edges.selectExpr("a node", "1 up", "0 down").union(edges.selectExpr("b node", "0 up", "1 down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count() == 0


def merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (node, component, other columns), with the components that `links` (a, b: components) join made one.

    Only the components are linked, so the work follows the links and not the nodes. Rows of a large component meet
    its new name by place.
    """
    tops = connected_components(links).selectExpr("node component", "component top")
    placed = nodes.withColumn("place", F.pmod(F.xxhash64("node"), F.lit(PLACES)))
    sent = placed.select("component", "place").distinct().join(tops, "component")
    return placed.join(sent, ["component", "place"], "left").withColumn("component", F.coalesce("top", "component")).select(nodes.columns)
