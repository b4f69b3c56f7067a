"""Metadata lookups and the search façade.

Defaults: kind `page`, domain `general`, title the page id, tags none. Ties go to the least page id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fulltext


def lower_tags(col: str = "tags"):
    return F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), F.lower)


def defaults(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {"kind": F.coalesce("kind", F.lit("page")), "domain": F.coalesce("domain", F.lit("general")), "title": F.coalesce("title", F.col("page_id").cast("string")), "tags": F.coalesce("tags", F.array().cast("array<string>"))}
    )


def get_page(pages: DataFrame, page_id) -> DataFrame:
    return pages.where(F.col("page_id") == page_id)


def find(pages: DataFrame, kind: str | None = None, domain: str | None = None, tags: list[str] | None = None, any_tag: bool = False) -> DataFrame:
    """Pages of a kind and domain that hold all (or any) of the tags, whatever their case."""
    out = defaults(pages)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if tags:
        wanted = F.array(*[F.lit(t.lower()) for t in tags])
        out = out.where(F.arrays_overlap(lower_tags(), wanted) if any_tag else F.size(F.array_except(wanted, lower_tags())) == 0)
    return out


def all_tags(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(lower_tags()).alias("tag")).distinct().orderBy("tag")


def group_sizes(pages: DataFrame) -> DataFrame:
    """Pages by tag, kind and domain in one pass: field, value, n_pages."""
    p = defaults(pages)
    keys = F.explode(
        F.array_union(
            F.array(F.struct(F.lit("kind").alias("field"), F.col("kind").alias("value")), F.struct(F.lit("domain").alias("field"), F.col("domain").alias("value"))),
            F.transform(F.array_distinct(lower_tags()), lambda t: F.struct(F.lit("tag").alias("field"), t.alias("value"))),
        )
    ).alias("k")
    return p.select(keys).groupBy("k.field", "k.value").agg(F.count("*").alias("n_pages"))


def search(pages: DataFrame, query: str | None = None, tags: list[str] | None = None, kind: str | None = None, domain: str | None = None, limit: int = 10) -> DataFrame:
    """With a query: the 2 * limit best pages of the domain by text, then the other filters (fewer than limit rows may
    stay); without: all pages that pass the filters, with score 0."""
    passing = find(pages, kind, domain, tags).select("page_id", "kind", "tags")
    if query:
        hits = fulltext.search(pages, query, domain, limit=2 * limit)
        out = hits.join(passing, "page_id")
    else:
        out = defaults(pages).select("page_id", "title", "domain", F.lit(0.0).alias("score")).join(passing, "page_id")
    return out.select("page_id", "title", "domain", "kind", "score").orderBy(F.desc(F.round("score", 12)), "page_id").limit(limit)


def search_claims(claims: DataFrame, query: str, min_confidence: float = 0.0, page_id=None) -> DataFrame:
    """Claims that hold the text, whatever its case, most confident first."""
    out = claims.where(F.contains(F.lower("text"), F.lit(query.lower())) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    if page_id is not None:
        out = out.where(F.col("page_id") == page_id)
    return out.orderBy(F.desc("confidence"), "page_id", "claim_no")


def remove(pages: DataFrame, gone: DataFrame) -> DataFrame:
    return pages.join(gone.select("page_id"), "page_id", "left_anti")


def upsert(pages: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their ids, in every lookup."""
    return remove(pages, new).unionByName(new)


def promotable(domains: DataFrame) -> DataFrame:
    """domains: domain, promote_to_shared -> the domains whose pages may be promoted."""
    return domains.where("promote_to_shared").select("domain").orderBy("domain")
