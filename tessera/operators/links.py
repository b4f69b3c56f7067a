"""Links between pages: links(src, dst) are distinct; the rest is derived. Phantom targets count as pages in stats."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T


def extract(pages: DataFrame, pattern: str = T.WIKI_LINK) -> DataFrame:
    """src, dst of wiki links in bodies; with RAW_LINK, targets keep their alias."""
    return pages.select(F.col("page_id").cast("string").alias("src"), F.explode(T.links(F.col("body"), pattern)).alias("dst")).distinct()


def backlinks(links: DataFrame) -> DataFrame:
    """dst, n_backlinks, and the sorted sources."""
    return links.groupBy("dst").agg(F.count("*").alias("n_backlinks"), F.sort_array(F.collect_set("src")).alias("sources"))


def backlink_blocks(links: DataFrame, per_block: int = 1000) -> DataFrame:
    """dst, block, sources: at most per_block sorted sources a row, so that a hub is many rows; in order of block they are
    all of its sources."""
    rows, _ = scratch.numbered(links.select("dst", "src").distinct(), "dst", "src")
    return rows.groupBy("dst", F.floor((F.col("n") - 1) / per_block).alias("block")).agg(F.sort_array(F.collect_list("src")).alias("sources"))


def backlink_counts(links: DataFrame) -> DataFrame:
    """dst, n_backlinks, without the sources: a hub's are never gathered."""
    return links.groupBy("dst").agg(F.count("*").alias("n_backlinks"))


def broken(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_anti").select("src", "dst")


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.select("page_id").join(links.select(F.col("dst").alias("page_id")), "page_id", "left_anti").orderBy("page_id")


def related_orphans(related: DataFrame) -> DataFrame:
    """Pages that no other page names in related_pages: page_id, related_pages."""
    named = related.select(F.col("page_id").alias("by"), F.explode("related_pages").alias("page_id")).where("by != page_id")
    return related.select("page_id").join(named, "page_id", "left_anti")


def broken_totals(links: DataFrame, pages: DataFrame) -> DataFrame:
    return broken(links, pages).agg(F.count("*").alias("n_broken"), F.countDistinct("src").alias("n_pages"))


def stats(links: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: total_pages (phantom targets too), total_links, pages_with_links, pages_with_backlinks, n_broken."""
    known = pages.select(F.col("page_id").alias("dst"), F.lit(1).alias("known")).distinct()
    of = links.join(known, "dst", "left")
    nodes = pages.select("page_id").unionByName(links.select(F.col("src").alias("page_id"))).unionByName(links.select(F.col("dst").alias("page_id"))).distinct()
    counts = of.agg(
        F.count("*").alias("total_links"),
        F.countDistinct("src").alias("pages_with_links"),
        F.countDistinct("dst").alias("pages_with_backlinks"),
        F.count_if(F.col("known").isNull()).alias("n_broken"),
    )
    return nodes.agg(F.count("*").alias("total_pages")).join(counts, F.lit(True))  # one row each


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, dst, change (added or removed) by one full outer join."""
    o, n = old.select("src", "dst", F.lit(1).alias("o")).distinct(), new.select("src", "dst", F.lit(1).alias("n")).distinct()
    both = o.join(n, ["src", "dst"], "full")
    return both.where("o is null or n is null").select("src", "dst", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def rename(links: DataFrame, old: str, new: str) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return links.select(swap("src"), swap("dst")).distinct()


#: Names of one side that meet in one task for a shared token.
CELL = 1000


def _marks(names: DataFrame, name: str) -> DataFrame:
    """name, end, k, marks: a row for the first and the last three characters; marks are the name's characters with their
    number among equal ones (a1, a2, b1), so that the marks two names share are as many as the characters they share."""
    chars = F.sort_array(F.split(F.col(name), ""))
    held = names.select(name, F.inline(F.array(F.struct(chars.alias("c")))))
    marks = F.transform("c", lambda x, i: F.concat(x, (i - F.array_position("c", x) + 2).cast("string")))
    ends = F.array(F.struct(F.lit("first").alias("end"), F.left(F.col(name), F.lit(3)).alias("k")), F.struct(F.lit("last").alias("end"), F.right(F.col(name), F.lit(3)).alias("k")))
    return held.select(name, marks.alias("marks"), F.inline(ends))


def rename_candidates(dangling: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """old, new, bound: pairs that share the first or last three characters and whose ratio can be over `least`: matched
    characters are shared ones, so the ratio is at most twice their number over both lengths. A name of n characters must
    share more than least / (2 - least) * n of them; only the marks beyond so many, the rarest ones, are joined."""
    old, new = _marks(dangling.select("old").distinct(), "old"), _marks(live.select("new").distinct(), "new")
    share = least / (2 - least)
    seen = old.where("end = 'first'").select(F.explode("marks").alias("m")).unionByName(new.where("end = 'first'").select(F.explode("marks").alias("m")))
    rank = seen.groupBy("m").agg(F.count("*").alias("f"))  # a row for each character and number

    def rare(df, name):
        every = df.select(name, "end", "k", "marks", F.explode("marks").alias("m")).join(rank, "m")
        ordered = every.groupBy(name, "end", "k", "marks").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("x"))  # a name's characters
        size = F.size("x") - F.floor(share * F.size("x") + 1e-9).cast("int")
        return ordered.withColumn("x", F.transform(F.slice("x", F.lit(1), size), lambda y: y["m"])).select(name, "end", "k", "marks", "x", F.explode("x").alias("m"))

    o, n = rare(old, "old"), rare(new, "new")
    key = ["end", "k", "m"]
    sizes = lambda df, c: df.groupBy(key).agg(F.ceil(F.count("*") / CELL).alias(c))
    grid = sizes(o, "os").join(sizes(n, "ns"), key)  # tokens that both sides have, cut into cells

    def celled(df, name, own, other):
        part = F.pmod(F.xxhash64(name), F.col(own)).alias(f"{own}_i")
        return df.join(grid, key).select(*df.columns, part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_i"))

    left, right = celled(o, "old", "os", "ns"), celled(n, "new", "ns", "os").withColumnsRenamed({"marks": "marks_n", "x": "x_n"})
    met = left.join(right, [*key, "os_i", "ns_i"]).where(F.get(F.array_intersect("x", "x_n"), 0) == F.col("m"))  # a pair's first shared token
    met = met.where((F.col("end") == "first") | (F.left("old", F.lit(3)) != F.left("new", F.lit(3))))
    bound = 2 * F.size(F.array_intersect("marks", "marks_n")) / (F.size("marks") + F.size("marks_n"))
    return met.select("old", "new", bound.alias("bound")).where(F.col("bound") > least)


def detect_renames(dangling: DataFrame, live: DataFrame, least: float = 0.6) -> DataFrame:
    """dangling(old), live(new) -> old, new, ratio: the most alike live id among those that share the first or last three
    characters, by the Ratcliff-Obershelp ratio (a pandas UDF); ties go to the least id. The candidate of the greatest bound
    is compared first, then only those whose bound reaches its ratio."""

    @F.pandas_udf("double")
    def ratio(a, b):
        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    found, _ = scratch.written(rename_candidates(dangling, live, least), "renames")
    first = found.groupBy("old").agg(F.min_by("new", F.struct(-F.col("bound"), "new")).alias("new")).withColumn("ratio", ratio("old", "new"))
    first, _ = scratch.written(first, "renames")
    rest = found.join(first.select("old", F.col("new").alias("first"), F.col("ratio").alias("reached")), "old").where("new != first and bound >= reached - 1e-9")
    scored = first.unionByName(rest.select("old", "new").withColumn("ratio", ratio("old", "new"))).where(F.col("ratio") > least)
    best = F.min_by(F.struct("new", "ratio"), F.struct(-F.col("ratio"), "new")).alias("x")
    return scored.groupBy("old").agg(best).select("old", "x.new", "x.ratio")


def remove_page(links: DataFrame, page_id: str) -> DataFrame:
    """Without what a page links to; links to it stay and become broken."""
    return links.where(F.col("src") != page_id)


def stale(index: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Index entries that are neither a live page nor linked from one."""
    live = links.join(pages.select(F.col("page_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("page_id"))
    return index.join(pages.select("page_id"), "page_id", "left_anti").join(live, "page_id", "left_anti")
