"""Connected components of an edge table, labelled by their smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.keys import lookup
from hirelake.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) for every id of the edges (``a``, ``b``).

    In a round every node moves to its smallest neighbour, and the edges are drawn anew between the
    places their ends moved to; edges within one place go. Rounds end when no edge is left, after a
    number that grows with the logarithm of the nodes. Every round is written to the shared
    folder, so no lineage builds up. Nothing is collected but the count of edges.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    placed = staged(ids.select("id", F.col("id").alias("component")), "components")
    while edges.limit(1).count():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                            .alias("e")).select("e.a", "e.b")
        moved = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "moves")
        placed = staged(lookup(placed, moved.select("a", "to"), ["component"], ["a"])
                        .select("id", F.coalesce("to", "component").alias("component")), "components")
        drawn = lookup(edges, moved, ["a"], ["a"]).select("b", F.col("to").alias("x"))
        drawn = lookup(drawn, moved, ["b"], ["a"]).select("x", F.col("to").alias("y"))
        edges = staged(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct(), "edges")
    return placed
