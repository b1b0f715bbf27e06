"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.session import materialize


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v: long); vertices of one component share their root.

    Each round every vertex moves to the neighbour (or itself) that comes first in the round's random order;
    edges are renamed accordingly, loops and repeats vanish. A constant share of the vertices goes in each
    round, whatever the shape, so the number of rounds is logarithmic. Nothing but a row count reaches the
    driver, and every round is a written table, so that a lost executor costs at most one round. A hub with
    many edges is only ever aggregated, with partial sums, or joined.
    """
    open_edges = materialize(edges.where("u <> v").select("u", "v").distinct(), f"{name}-edges")
    mapping = None
    number = 0
    while not open_edges.isEmpty():
        number += 1
        order = lambda c, salt=number: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("id"))
        both = open_edges.unionByName(open_edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(order("v")).alias("other"))
        moves = first.select(F.col("u").alias("old"), F.least(order("u"), F.col("other"))["id"].alias("new"))
        moves = materialize(moves, f"{name}-moves")
        renamed = (
            open_edges.join(moves, open_edges["u"] == moves["old"])
            .select(F.col("new").alias("nu"), "v")
            .join(moves, F.col("v") == moves["old"])
            .select(F.col("nu").alias("u"), F.col("new").alias("v"))
            .where("u <> v")
            .distinct()
        )
        open_edges = materialize(renamed, f"{name}-edges")
        if mapping is None:
            mapping = moves.select(F.col("old").alias("vertex"), F.col("new").alias("root"))
        else:
            moved = mapping.join(moves, mapping["root"] == moves["old"], "left")
            mapping = materialize(moved.select("vertex", F.coalesce("new", "root").alias("root")), f"{name}-roots")
    if mapping is None:
        return open_edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return mapping
