"""Connected components of links, by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, u: str = "u", v: str = "v", name: str = "components") -> DataFrame:
    """(node, component) of each node that has a link; the component is its smallest node.

    Each round joins every node to the smallest node near it (large star, then small star); the
    edges of a component become a star around its smallest node after a number of rounds that grows
    with the logarithm of its size. Rounds are written to the shared folder. Self links, repeated
    and null ends are ignored; no links give no rows.
    """
    a, b = F.least(u, v), F.greatest(u, v)
    edges = scratch.keep(links.where(f"{u} is not null and {v} is not null and {u} <> {v}").select(a.alias("a"), b.alias("b")).distinct(), f"{name}/0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, step = mark(edges), 0
    while before[0]:
        # what is joined is a table of its own, so that Spark can split the edges of a centre among tasks
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}/low-{step}")
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        down = scratch.keep(large.select(F.col("b").alias("a"), F.col("a").alias("b")), f"{name}/down-{step}")  # each node with its smaller neighbours
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        step += 1
        edges = scratch.keep(small, f"{name}/{step}")
        scratch.drop(f"{name}/{step - 1}", f"{name}/low-{step - 1}", f"{name}/down-{step - 1}")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
