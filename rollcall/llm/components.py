"""Connected components of links, as DataFrame rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.llm.common import discard, stored


def _by_least(edges: DataFrame, both: bool) -> DataFrame:
    """One star round over edges (u > v): point larger (``both``) or smaller neighbours at the least one."""
    if both:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id it can reach.

    Rounds go on until the edges are stars and stay the same; few rounds suffice, as paths
    shorten by a constant factor in each. Null ends and links to oneself are left out.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # A round's edges are stored, so a lost executor costs one round at most, and what finds the links runs once.
    edges, seen = stored(ends, "ends"), None
    while True:
        last, edges = edges, stored(_by_least(_by_least(edges, both=True), both=False), "stars")
        discard(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
