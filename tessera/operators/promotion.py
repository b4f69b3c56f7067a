"""Promotion as commits: the pages and the log of promotions change in one version, or not at all.

A wiki is a root of versioned tables (sources/versions.py) with `pages` and `promotions` (page_id, domain, at). A failed
half leaves the version before in place; any version can be made the last one again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching
from tessera.sources import versions

LOG = "page_id string, domain string, at timestamp_ntz"


def create(pages: DataFrame, root: str) -> int:
    spark = pages.sparkSession
    return versions.commit(spark, root, {"pages": pages, "promotions": spark.createDataFrame([], LOG)})


def promote(spark: SparkSession, root: str, chosen: DataFrame, at: str) -> int:
    """Move the pages of `chosen` (page_id) into the shared domain; the new version. Ids that are no page, or are shared
    already, change nothing."""
    pages, log = versions.read(spark, root, "pages"), versions.read(spark, root, "promotions")
    ids = chosen.select(F.col("page_id").cast("string").alias("page_id")).distinct()
    moved = pages.where((F.col("domain") != matching.SHARED) & (F.coalesce("kind", F.lit("page")) != "tombstone")).select(F.col("page_id").cast("string").alias("page_id"), "domain").join(ids, "page_id", "left_semi")
    new = moved.select("page_id", "domain", F.lit(at).cast("timestamp_ntz").alias("at"))
    return versions.commit(spark, root, {"pages": matching.promoted(pages, moved.select("page_id")), "promotions": log.unionByName(new)})


def unpromote(spark: SparkSession, root: str, chosen: DataFrame) -> int:
    """Move pages of `chosen` that the log has back to where they came from; the new version."""
    pages, log = versions.read(spark, root, "pages"), versions.read(spark, root, "promotions")
    ids = chosen.select(F.col("page_id").cast("string").alias("page_id")).distinct().join(log, "page_id", "left_semi")
    return versions.commit(spark, root, {"pages": matching.unpromoted(pages, ids), "promotions": log.join(ids, "page_id", "left_anti")})


def report(scored: DataFrame, at: str, most: int = 50) -> DataFrame:
    """scored: governance.promotion()'s rows -> one row with `json`: totals and the best candidates in order of score."""
    order = F.struct(-F.col("score"), "page_id")
    best = scored.where("decision != 'none'").orderBy(F.desc("score"), "page_id").limit(most)
    item = F.struct("page_id", F.round("score", 6).alias("score"), "decision", F.col("cross").alias("cross_domain_references"), F.col("total").alias("total_references"), F.round("quality", 6).alias("quality"))
    candidates = best.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"]).alias("candidates"))  # `most` rows
    count = lambda d: F.count_if(F.col("decision") == d)
    totals = scored.agg((count("auto") + count("suggest")).alias("total_candidates"), count("auto").alias("auto_promote"), count("suggest").alias("suggest_promote"))
    return totals.join(candidates, F.lit(True)).select(F.to_json(F.struct(F.lit(at).alias("generated_at"), "total_candidates", "auto_promote", "suggest_promote", "candidates")).alias("json"))  # one row each
