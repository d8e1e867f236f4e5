"""Connected components by alternating large-star and small-star rounds.

Every round is a partial-aggregated minimum per node and a join back.  Nodes on more
than one in ``HUBS`` edges are at most 2 * ``HUBS``, whatever the graph; their minima are
broadcast, so their edges stay where they were read instead of meeting in one task.  The
graph never leaves the executors.  Each half round's edges are written to the shared
folder, and removed when the next are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize


#: A node that holds more than one in so many edges is a hub.
HUBS = 500


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` with the least node m that their u knows, of ``rows`` edges in all."""
    hubs = F.broadcast(least.where(F.col("n") * HUBS > rows).drop("n"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.drop("n"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One round over ``rows`` edges (u, v) with u > v."""
    degree = F.count(F.lit(1)).alias("n")
    if large:  # every node's larger neighbours move to the least node it knows
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("m", "u").alias("m"), "n")
        return _with_least(both.where("v > u"), least, rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    # a node and its smaller neighbours move to the least of them
    least = edges.groupBy("u").agg(F.min("v").alias("m"), degree)
    moved = _with_least(edges, least, rows).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on ``edges`` (a, b); the component is named by
    its least node.  Nodes without edges to others do not appear."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    rows, state = now.count(), None
    while True:
        # The halves of a round are written one by one: each reads its edges several times.
        # A large star has no more edges than it was given.
        middle = materialize(_star(now, True, rows), "edges")
        after = materialize(_star(middle, False, rows), "edges")
        discard(now)
        discard(middle)
        now = after
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, rows = new, new[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
