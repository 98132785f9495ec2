"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in links (a, b): the smallest id reachable.

    Alternates two steps until the links stay the same. In the first each id points its larger
    neighbours at its smallest one; in the second each id points its smaller neighbours and itself at the
    smallest. Links end as stars round the smallest ids. The minima are written before the join, so
    that Spark can split the rows of an id with very many links among tasks. Links with a null end or
    from an id to itself are ignored; no links give an empty table.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "links")
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "minima")
        far = pairs.join(low, pairs.b == low.u, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        near = far.groupBy("a").agg(F.min("b").alias("m"))
        moved = far.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = materialize(moved.unionByName(near.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("id")).distinct()
    return materialize(pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id"))), "components")
