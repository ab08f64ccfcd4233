"""Connected components of an edge table, as joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch

ROWS_A_FILE = 250_000


def _mark(df: DataFrame) -> tuple:
    """(rows, a hash of them)"""
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.lit(0))).first())


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m): the least v of each u.

    Grouped by the complement of u, so that a join on u shuffles both of its sides anew and
    Spark can split the rows of a node with very many edges.
    """
    return edges.groupBy(F.bitwise_not("u").alias("not_u")).agg(F.min("v").alias("m")).select(F.bitwise_not("not_u").alias("u"), "m")


def _step(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step on edges (u, v)."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("u", F.least("m", "u").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    small = large.join(_minima(large), "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v")
    return small.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (u, v).

    Alternates large-star and small-star steps until the edges are stars around the smallest
    nodes.  Minima are taken with map-side aggregation and joined back, and Spark can split that
    join's rows of one node, so a node with a third of all edges is neither gathered in one task
    nor sent to the driver.  Edges with a null
    end and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kept, turn = f"{name}0", 0
    e = scratch.save(e, kept)
    mark, seen = _mark(e), None
    while mark != seen and mark[0]:
        e, seen, turn = _step(e), mark, turn + 1
        e = scratch.save(e.coalesce(-(-mark[0] // ROWS_A_FILE)), f"{name}{turn}")
        scratch.drop(kept)
        kept, mark = f"{name}{turn}", _mark(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
