"""Connected components of an edge list by alternating stars (Kiveris et al., 2014).

A node's least neighbour is found by a map-side aggregate and handed to the node's edges by a join in SALTS parts, so that
the edges of a hot node, of which a star's centre has as many as it has leaves, are not one task's. The join is a merge at
every size: the parts of a small file are many times its size, which a planner that broadcasts small files does not see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written

SALTS = 16
#: A guard against an endless loop; alternating stars need about the squared logarithm of the longest chain.
ROUNDS = 500


def _with_least(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sides: (u, v) -> the rows with m, the least of u and its v; and (u, m)."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "salt"]).drop("salt"), least


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node joins the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both)[0].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, join the least of them."""
    rows, least = _with_least(edges)
    return rows.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or a leaf of one centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.leaf").alias("centres"), F.min("e.leaf").alias("leaf"))
    return not nodes.where("centres > 1 or centres = 1 and leaf = 0").limit(1).count()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component): each node that has an edge, and the least node that it reaches.

    edges: columns u and v of one ordered type; loops, repeats and either direction are allowed, rows with a null end are
    left out. Rounds go on until every component is a star; an error is raised if `rounds` of them don't do. Each is
    written to the shared folder; the driver sees one count a round.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        if _are_stars(now):
            break
        then, then_path = written(_small(_large(now).distinct()).distinct(), "cc")
        dropped(spark, path)
        now, path = then, then_path
    else:
        raise RuntimeError(f"components are not stars after {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
