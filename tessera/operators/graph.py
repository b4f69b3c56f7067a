"""Typed edges: edges(source, target, type, weight). Traversals write a frontier a hop and join it with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T


def with_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("eid", T.edge_id(F.col("source"), F.col("target"), F.col("type")))


def upserted(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Of rows with one edge id the latest stays; weights are clamped; a bidirectional edge stands in both directions."""
    last = W.partitionBy("source", "target", "type").orderBy(F.desc(seq))
    own = edges.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r").withColumn("weight", T.clamp(F.col("weight")))
    back = own.where("bidirectional").withColumns({"source": F.col("target"), "target": F.col("source")})
    return with_ids(own.unionByName(back).dropDuplicates(["source", "target", "type"]))


def remove_page(edges: DataFrame, page_id: str) -> DataFrame:
    return edges.where(F.col("source") != page_id)


def replace_links(edges: DataFrame, new: DataFrame) -> DataFrame:
    """new(source, target): the `links` edges of its sources are replaced."""
    kept = edges.where("type != 'links'").unionByName(edges.where("type = 'links'").join(new.select("source").distinct(), "source", "left_anti"))
    return kept.unionByName(new.select("source", "target").distinct().withColumns({"type": F.lit("links"), "weight": F.lit(1.0)}).select(edges.columns))


def relationship_edges(rels: DataFrame) -> DataFrame:
    """rels: page_id, source, target, type, weight -> edges with page_id. A missing source is the page, a missing type
    related_to (types are lower case), a missing weight 0.9; relationships without a target are left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rels.where(blank("target").isNotNull()).select(
        F.coalesce(blank("source"), "page_id").alias("source"), "target", F.lower(F.coalesce(blank("type"), F.lit("related_to"))).alias("type"), F.coalesce("weight", F.lit(0.9)).alias("weight"), "page_id"
    )


def replace_relationships(edges: DataFrame, rels: DataFrame, of: DataFrame) -> DataFrame:
    """edges: source, target, type, weight, page_id. Of the pages in `of` (page_id), the edges other than links that start at
    the page or were made by it give way to those of rels."""
    kept = edges.where("type != 'links'").join(of.select(F.col("page_id").alias("source")), "source", "left_anti")
    # an edge that no page made is no page's
    kept = kept.join(of.select("page_id"), "page_id", "left_anti").select(edges.columns)
    new = relationship_edges(rels.join(of.select("page_id"), "page_id", "left_semi"))
    return edges.where("type = 'links'").unionByName(kept).unionByName(new)


def rebuilt(pages: DataFrame, rels: DataFrame) -> DataFrame:
    """All edges anew: raw wiki links of bodies, once each, and the pages' relationships."""
    from tessera.operators import links as L

    found = L.extract(pages, T.RAW_LINK).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("links").alias("type"), F.lit(1.0).alias("weight"), F.col("src").alias("page_id"))
    return found.unionByName(relationship_edges(rels).select(found.columns))


def rebuilt_relationships(rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships with both ends; one row of counts: total, n_without_end). Repeats are kept."""
    whole = (F.coalesce(F.trim("source"), F.lit("")) != "") & (F.coalesce(F.trim("target"), F.lit("")) != "")
    return rels.where(whole), rels.agg(F.count("*").alias("total"), F.count_if(~whole).alias("n_without_end"))


def new_relationships(old: DataFrame, new: DataFrame) -> DataFrame:
    """old rows as they are, then new ones, once for each source, type and target among themselves."""
    return old.unionByName(new.dropDuplicates(["source", "type", "target"]))


def outgoing(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    out = edges.where(F.col("source") == node)
    return out if kind is None else out.where(F.col("type") == kind)


def incoming(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    out = edges.where(F.col("target") == node)
    return out if kind is None else out.where(F.col("type") == kind)


def stats(edges: DataFrame) -> DataFrame:
    """type, n_edges; and rows `*edges`, `*nodes` for all."""
    by_type = edges.groupBy("type").agg(F.count("*").alias("n"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("x")).distinct().agg(F.lit("*nodes").alias("type"), F.count("*").alias("n"))
    return by_type.unionByName(edges.agg(F.lit("*edges").alias("type"), F.count("*").alias("n"))).unionByName(nodes)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


#: Parts that the edges of one node are joined in.
SALTS = 16


def _reached(step: DataFrame, frontier: DataFrame) -> DataFrame:
    """node: the ends of the steps (a, b) that start in the frontier (node). A hub's steps are dealt by their ends, each
    frontier node meets them in SALTS parts; a small frontier is broadcast by its size instead."""
    salted = frontier.select(F.col("node").alias("a"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    dealt = step.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["a", "salt"]).select(F.col("b").alias("node")).distinct()


def _tables(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def levels(edges: DataFrame, start: str, depth: int, undirected: bool, until: str | None = None) -> DataFrame:
    """node, level: breadth-first levels from start. until: a node that is not passed through. Each level is written once,
    by one scan of the edges, and read as a table from then on; a level without nodes ends the walk."""
    spark = edges.sparkSession
    step = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if undirected:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        step = step.select(F.inline(both))
    step = step.where("a != b")
    if until is not None:
        step = step.where((F.col("a") != until) & (F.col("b") != until))
    seen = [spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("level"))]
    for level in range(1, depth + 1):
        found = _reached(step, seen[-1])
        # a step leads to the same level, to the one before (if steps go both ways) or to an earlier one
        for old in seen[-2:] if undirected else seen:
            found = found.join(old.select("node"), "node", "left_anti")
        now, path = scratch.written(found.withColumn("level", F.lit(level)), "level")
        if not now.limit(1).count():
            scratch.dropped(spark, path)
            break
        seen.append(now)
    return _tables(seen)


def neighbors(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """Nodes within depth hops in either direction, without the start."""
    return levels(edges, node, max(0, depth), undirected=True).where("level > 0")


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 3) -> DataFrame:
    """path: arrays of nodes from source to target, at most max_depth hops. Every step but the last goes one breadth-first
    level on; the last may enter the target from any reached node; parallel edges give a path each.

    The steps between levels are one table with the number of parallel edges. It is cut from behind to those that lead to the
    target, so paths are written out last and none of them is a dead end."""
    spark = edges.sparkSession
    if source == target:
        return spark.range(1).select(F.array(F.lit(source)).alias("path"))
    at = levels(edges, source, max_depth - 1, undirected=False, until=target)
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))
    below = at.select(F.col("node").alias("a"), F.col("level").alias("from"))
    steps, steps_path = scratch.written(e.join(below, "a"), "steps")
    ends = steps.where(F.col("b") == target).select(F.col("a").alias("node"), F.col("from").alias("level"), "times")
    steps = steps.join(at.select(F.col("node").alias("b"), F.col("level").alias("to")), "b").where(F.col("to") == F.col("from") + 1).select("a", "b", "from", "times")
    good = {max_depth - 1: ends.where(F.col("level") == max_depth - 1).select("node")}
    onward = {}
    for level in range(max_depth - 2, -1, -1):  # what leads to the target, level by level from behind
        onward[level], _ = scratch.written(steps.where(F.col("from") == level).join(good[level + 1].select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "times"), "onward")
        good[level] = onward[level].select(F.col("a").alias("node")).unionByName(ends.where(F.col("level") == level).select("node")).distinct()
    walk = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("end"), F.lit(1).cast("long").alias("times"))
    last = ends.select(F.col("node").alias("end"), F.col("times").alias("own"))
    out = []
    for level in range(max_depth):
        out.append(walk.join(last, "end").select(F.concat("path", F.array(F.lit(target))).alias("path"), (F.col("times") * F.col("own")).alias("times")))
        if level in onward:
            on = onward[level].select(F.col("a").alias("end"), "b", F.col("times").alias("own"))
            walk = walk.join(on, "end").select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("end"), (F.col("times") * F.col("own")).alias("times"))
    return _tables(out).select("path", F.explode(F.sequence(F.lit(1), "times"))).select("path")


# relationships: the same edges, looked up by lower-cased, trimmed names

def key(c):
    return F.lower(F.trim(c))


def related(rels: DataFrame, entity: str, kind: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Outgoing and incoming relationships of an entity with their direction."""
    k = entity.strip().lower()
    sides = rels.where(key(F.col("source")) == k).withColumn("direction", F.lit("outgoing")).unionByName(rels.where(key(F.col("target")) == k).withColumn("direction", F.lit("incoming")))
    out = sides.where(F.col("weight") >= min_confidence)
    return out if kind is None else out.where(F.lower("type") == kind.lower())


def relationship_stats(rels: DataFrame) -> DataFrame:
    return rels.agg(
        F.countDistinct(key(F.col("source"))).alias("n_subjects"), F.countDistinct(key(F.col("target"))).alias("n_targets"), F.countDistinct(F.lower("type")).alias("n_types"), F.count("*").alias("total")
    )


def by_type(rels: DataFrame, kind: str) -> DataFrame:
    return rels.where(F.lower("type") == kind.lower())


# Fixed values
RELATIONSHIP_TYPES = (
    "uses", "depends_on", "implements", "extends", "integrates_with", "requires", "provides", "wraps",
    "works_for", "manages", "reports_to", "collaborates_with", "competes_with", "owns",
    "before", "after", "during", "influences",
    "located_in", "part_of", "contains", "includes",
    "cites", "references", "related_to", "similar_to", "contrasts_with",
)
# End of fixed values


def normal_type(kind):
    """Trimmed, lower case, underscores; a known type, else the first one that begins with its first three letters (or as
    many as there are), else as it is."""
    k = F.replace(F.lower(F.trim(kind)), F.lit(" "), F.lit("_"))
    known = F.array(*[F.lit(t) for t in RELATIONSHIP_TYPES])
    near = F.filter(known, lambda t: F.startswith(t, F.left(k, F.lit(3))))
    return F.when(F.array_contains(known, k), k).otherwise(F.coalesce(F.get(near, 0), k))
