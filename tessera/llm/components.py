"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Links that one task of a round takes; a graph of few links is not spread over many tasks.
LINKS_PER_TASK = 20_000


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """The component of every node in the links: columns node and component (its smallest node).

    links has columns a and b; repeated links and either direction are fine. Each round
    ties every node's larger neighbours to its smallest one (large star), then its smaller
    ones (small star), until nothing changes: O(log^2 n) rounds. Only minima are gathered
    by node, so a node with many links never makes a group; rounds are staged tables, in
    as many tasks as the number of links calls for.
    """
    edges = scratch.stage(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), f"{name}-0")
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-edges.count() // LINKS_PER_TASK)

    def stage(df: DataFrame, part: str) -> DataFrame:
        return scratch.stage(df.coalesce(max(1, tasks)) if tasks < most else df, f"{name}-{part}")

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    seen, step = print_of(edges), 0
    while seen[0]:
        step += 1
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), f"l{step}")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        large = stage(large, f"a{step}")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"m{step}")
        tied = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        small = least.selectExpr("u", "m AS v").unionByName(tied)
        # v and m are both smaller neighbours of u, and v > m
        small = stage(small.distinct(), f"{step}")
        scratch.drop(f"{name}-{step - 1}")
        for part in "lam":
            scratch.drop(f"{name}-{part}{step}")
        edges, now = small, print_of(small)
        if now == seen:
            break
        seen = now
    star = edges.selectExpr("u AS node", "v AS component")
    return star.unionByName(edges.selectExpr("v AS node", "v AS component").distinct())
