"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, materialise, release


def _shape(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _with_least(edges: DataFrame, made: list[str], own: bool) -> DataFrame:
    """Directed ``edges`` (u, v), a written table or a union of such, with m: the
    least v of u's edges (or u itself, with ``own``). What few hubs hold more than
    one in HOT_SHARE edges each is broadcast, so no task gets a hub's edges."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges"))
    low = materialise(low.select("u", F.least("u", "m").alias("m") if own else "m", "edges"), made)
    total = low.agg(F.sum("edges"), F.max("edges")).first()
    if not total[0] or total[1] * HOT_SHARE <= total[0] or total[0] < HOT_SHARE:
        return edges.join(low.drop("edges"), "u")
    hub = F.col("edges") * HOT_SHARE > total[0]  # at most HOT_SHARE of them
    hubs = F.broadcast(low.filter(hub).drop("edges"))
    return edges.join(hubs, "u").union(edges.join(hubs.select("u"), "u", "left_anti").join(low.filter(~hub).drop("edges"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, comp): comp is the smallest node that can be reached.
    Nodes without edges aren't listed.

    Large-star and small-star steps alternate until nothing changes; rounds grow
    with the logarithm of the longest path. Minima are pre-aggregated, hubs are
    spread, and every round is written to the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    old: list[str] = []
    edges = materialise(edges, old)
    shape = _shape(edges)
    while shape[0]:
        made: list[str] = []
        # Large star: every larger neighbour is joined to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, made, own=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialise(large, made)
        # Small star: every smaller neighbour, and the node, to the smallest one.
        joined = _with_least(large, made, own=False)
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        fresh: list[str] = []
        edges = materialise(small, fresh)
        discard(edges.sparkSession, *old, *made)
        release(edges.sparkSession)
        old = fresh
        now = _shape(edges)
        if now == shape:
            break
        shape = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
