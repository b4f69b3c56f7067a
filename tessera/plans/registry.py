"""Registered queries of the engine's own operators, and their oracle SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T
from tessera.operators import export, fulltext, governance, graph, links, matching, metadata, records
from tessera.sources import pagefiles
from tessera.sources import tables as S
from tessera.sources import versions

QUERY = "the of and"
AS_OF = S.AS_OF
EVENTS_AS_OF = "2024-01-31 00:00:00"
# Keyword rules for the driver's tags (languages and sources)
KEYWORDS = [("src1", "de"), ("src1", "fr"), ("src2", "es"), ("src3", "en"), ("src4", "fr")]
PATH_RULES = [("doc/1", "alpha"), ("doc/2", "beta")]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}'))"
POSTINGS = f"""
tok_ AS (SELECT page_id, unnest({TOKENS.format("title")}) AS term, 3 AS w FROM pages_ UNION ALL SELECT page_id, unnest({TOKENS.format("body")}), 1 FROM pages_),
post_ AS (SELECT page_id, term, CAST(sum(w) AS BIGINT) AS tf FROM tok_ GROUP BY ALL),
wc_ AS (SELECT page_id, title, domain, CAST(len({TOKENS.format("title")}) * 3 + len({TOKENS.format("body")}) AS BIGINT) AS word_count FROM pages_)"""


def ranked(where: str = "") -> str:
    return f"""
q_ AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'of', 'and']) AS term) GROUP BY 1),
df_ AS (SELECT term, count(*) AS df FROM post_ GROUP BY 1),
rank_ AS (SELECT p.page_id, w.title, w.domain, sum(times * tf / greatest(word_count, 1) / (1 + df)) AS score
  FROM q_ JOIN post_ p USING (term) JOIN df_ USING (term) JOIN wc_ w ON w.page_id = p.page_id {where} GROUP BY ALL)"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 9) for c in columns})


PAGES = "WITH " + S.PAGES_SQL


@register("fulltext_topk", f"{PAGES},{POSTINGS},{ranked()} SELECT page_id, title, domain, round(score, 9) AS score FROM rank_ ORDER BY round(rank_.score, 12) DESC, page_id LIMIT 10")
def _(spark, d):
    return rounded(fulltext.search(S.pages(spark, d), QUERY), "score")


@register("fulltext_domain_topk", f"{PAGES},{POSTINGS},{ranked("WHERE w.domain = 'src3'")} SELECT page_id, title, domain, round(score, 9) AS score FROM rank_ ORDER BY round(rank_.score, 12) DESC, page_id LIMIT 10")
def _(spark, d):
    return rounded(fulltext.search(S.pages(spark, d), QUERY, domain="src3"), "score")


_stored: dict = {}


def stored_index(spark, d) -> str:
    """Where the index of the pages is stored; written once a session and state of the files that it was made from."""
    files = [f"{s.getPath()} {s.getModificationTime()} {s.getLen()}" for t in ("documents", "labels") for s in _listed(spark, f"{d}/{t}.parquet")]
    key = (spark.sparkContext.applicationId, *files)
    if key not in _stored or not versions.current(spark, _stored[key]):  # cleared tables are written again
        path = scratch.shared_path(spark, "index")
        fulltext.store(S.page_texts(spark, d), path)
        _stored[key] = path
    return _stored[key]


def _listed(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)


@register("fulltext_store", f"{PAGES},{POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post_ GROUP BY 1")
def _(spark, d):
    posted, _ = fulltext.stored(spark, stored_index(spark, d))
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@register("fulltext_index_topk", ORACLE_SQL["fulltext_topk"])
def _(spark, d):
    return rounded(fulltext.search_stored(spark, stored_index(spark, d), QUERY), "score")


@register("fulltext_index_domain_topk", ORACLE_SQL["fulltext_domain_topk"])
def _(spark, d):
    return rounded(fulltext.search_stored(spark, stored_index(spark, d), QUERY, domain="src3"), "score")


@register("fulltext_postings", f"{PAGES},{POSTINGS} SELECT page_id, term, tf FROM post_")
def _(spark, d):
    return fulltext.postings(S.pages(spark, d))


@register("fulltext_documents", f"{PAGES},{POSTINGS} SELECT * FROM wc_")
def _(spark, d):
    return fulltext.documents(S.pages(spark, d))


@register("term_df", f"{PAGES},{POSTINGS} SELECT term, count(*) AS df FROM post_ GROUP BY 1")
def _(spark, d):
    return fulltext.term_df(fulltext.postings(S.pages(spark, d)))


@register(
    "search_with_metadata",
    f"""{PAGES},{POSTINGS},{ranked()}, top_ AS (SELECT * FROM rank_ ORDER BY round(score, 12) DESC, page_id LIMIT 20)
SELECT t.page_id, t.title, t.domain, kind, round(score, 9) AS score FROM top_ t JOIN pages_ p ON p.page_id = t.page_id WHERE list_contains(p.tags, 'en') ORDER BY round(t.score, 12) DESC, t.page_id LIMIT 10""",
)
def _(spark, d):
    return rounded(metadata.search(S.pages(spark, d), QUERY, tags=["EN"]), "score")


@register(
    "search_in_domain",
    f"""{PAGES},{POSTINGS},{ranked("WHERE w.domain = 'src3'")}, top_ AS (SELECT * FROM rank_ ORDER BY round(score, 12) DESC, page_id LIMIT 6)
SELECT t.page_id, t.title, t.domain, kind, round(score, 9) AS score FROM top_ t JOIN pages_ p ON p.page_id = t.page_id WHERE kind = 'page' ORDER BY round(t.score, 12) DESC, t.page_id LIMIT 3""",
)
def _(spark, d):
    return rounded(metadata.search(S.pages(spark, d), QUERY, kind="page", domain="src3", limit=3), "score")


@register("tag_and_search", f"{PAGES} SELECT page_id, title, domain, kind, 0.0::DOUBLE AS score FROM pages_ WHERE list_has_all(tags, ['de', 'src4']) ORDER BY page_id LIMIT 10")
def _(spark, d):
    return metadata.search(S.pages(spark, d), tags=["de", "SRC4"])


@register("tag_or_search", f"{PAGES} SELECT page_id FROM pages_ WHERE list_has_any(tags, ['de', 'src4'])")
def _(spark, d):
    return metadata.find(S.pages(spark, d), tags=["de", "src4"], any_tag=True).select("page_id")


@register("pages_by_kind", f"{PAGES} SELECT page_id, title FROM pages_ WHERE kind = 'entity'")
def _(spark, d):
    return metadata.find(S.pages(spark, d), kind="entity").select("page_id", "title")


@register("pages_by_domain", f"{PAGES} SELECT page_id, title FROM pages_ WHERE domain = 'src5'")
def _(spark, d):
    return metadata.find(S.pages(spark, d), domain="src5").select("page_id", "title")


@register("pages_by_tag", f"{PAGES} SELECT page_id, title FROM pages_ WHERE list_contains(tags, 'fr')")
def _(spark, d):
    return metadata.find(S.pages(spark, d), tags=["fr"]).select("page_id", "title")


@register("page_lookup", f"{PAGES} SELECT page_id, title, domain, kind FROM pages_ WHERE page_id = 42")
def _(spark, d):
    return metadata.get_page(S.pages(spark, d), 42).select("page_id", "title", "domain", "kind")


@register("all_tags", f"{PAGES} SELECT DISTINCT lower(unnest(tags)) AS tag FROM pages_")
def _(spark, d):
    return metadata.all_tags(S.pages(spark, d))


@register(
    "metadata_groups",
    f"""{PAGES} SELECT 'kind' AS field, kind AS value, count(*) AS n_pages FROM pages_ GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM pages_ GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT DISTINCT page_id, lower(unnest(tags)) AS tag FROM pages_) GROUP BY 2""",
)
def _(spark, d):
    return metadata.group_sizes(S.pages(spark, d))


CLAIMS = "WITH " + S.CLAIMS_SQL


@register("claims_search", f"{CLAIMS} SELECT page_id, claim_no, text, confidence::DOUBLE AS confidence FROM claims_ WHERE contains(lower(text), 'idiot') AND confidence >= 0.5")
def _(spark, d):
    return metadata.search_claims(S.claims(spark, d), "Idiot", 0.5)


@register("claims_of_page", f"{CLAIMS} SELECT page_id, claim_no, text, confidence::DOUBLE AS confidence FROM claims_ WHERE page_id = 7")
def _(spark, d):
    return S.claims(spark, d).where("page_id = 7")


LINKS = "WITH " + S.LINKS_SQL


@register("page_links", f"{LINKS} SELECT * FROM links_")
def _(spark, d):
    return S.links(spark, d)


@register("backlinks", f"{LINKS} SELECT dst, count(*) AS n_backlinks, array_to_string(list_sort(list(src)), ',') AS sources FROM links_ GROUP BY dst")
def _(spark, d):
    return links.backlinks(S.links(spark, d)).withColumn("sources", F.array_join("sources", ","))


@register("broken_links", f"{LINKS} SELECT src, dst FROM links_ WHERE dst NOT IN (SELECT page_id FROM site_)")
def _(spark, d):
    return links.broken(S.links(spark, d), S.site_pages(spark, d))


@register("broken_link_totals", f"{LINKS} SELECT count(*) AS n_broken, count(DISTINCT src) AS n_pages FROM links_ WHERE dst NOT IN (SELECT page_id FROM site_)")
def _(spark, d):
    return links.broken_totals(S.links(spark, d), S.site_pages(spark, d))


@register("orphans", f"{LINKS} SELECT page_id FROM site_ WHERE page_id NOT IN (SELECT dst FROM links_)")
def _(spark, d):
    return links.orphans(S.links(spark, d), S.site_pages(spark, d))


@register(
    "link_stats",
    f"""{LINKS} SELECT (SELECT count(*) FROM (SELECT page_id FROM site_ UNION SELECT src FROM links_ UNION SELECT dst FROM links_)) AS total_pages,
count(*) AS total_links, count(DISTINCT src) AS pages_with_links, count(DISTINCT dst) AS pages_with_backlinks, count(*) FILTER (WHERE dst NOT IN (SELECT page_id FROM site_)) AS n_broken FROM links_""",
)
def _(spark, d):
    return links.stats(S.links(spark, d), S.site_pages(spark, d))


@register(
    "link_diff",
    f"""{LINKS}, o AS (SELECT * FROM links_ WHERE length(dst) % 3 <> 0), n AS (SELECT * FROM links_ WHERE length(dst) % 3 <> 1)
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""",
)
def _(spark, d):
    every = S.links(spark, d)
    return links.diff(every.where(F.char_length("dst") % 3 != 0), every.where(F.char_length("dst") % 3 != 1))


@register("rename_suggestions")
def _(spark, d):
    live = S.site_pages(spark, d).where("page_id != ''").select(F.col("page_id").alias("new"))
    return links.detect_renames(links.broken(S.links(spark, d), S.site_pages(spark, d)).select(F.col("dst").alias("old")).distinct(), live)


EDGES = "WITH RECURSIVE " + S.EDGES_SQL


@register("edge_ids", f"{EDGES} SELECT source, target, type, substring(sha1(source || '::' || target || '::' || type), 1, 16) AS eid FROM edges_")
def _(spark, d):
    return graph.with_ids(S.edges(spark, d)).select("source", "target", "type", "eid")


@register("edge_stats", f"{EDGES} SELECT type, count(*) AS n FROM edges_ GROUP BY 1 UNION ALL SELECT '*edges', count(*) FROM edges_ UNION ALL SELECT '*nodes', count(*) FROM (SELECT source FROM edges_ UNION SELECT target FROM edges_)")
def _(spark, d):
    return graph.stats(S.edges(spark, d))


@register("outgoing_edges", f"{EDGES} SELECT source, target, type FROM edges_ WHERE source = 'o1' AND type = 'placed_by'")
def _(spark, d):
    return graph.outgoing(S.edges(spark, d), "o1", "placed_by").select("source", "target", "type")


@register("incoming_edges", f"{EDGES} SELECT source, target, type FROM edges_ WHERE target = 'n3'")
def _(spark, d):
    return graph.incoming(S.edges(spark, d), "n3").select("source", "target", "type")


@register(
    "subgraph",
    f"{EDGES}, k AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) SELECT source, target, type FROM edges_ WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)",
)
def _(spark, d):
    n = S.read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    r = S.read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.subgraph(S.edges(spark, d), n.unionByName(r)).select("source", "target", "type")


@register(
    "neighbors_k",
    f"""{EDGES}, u AS (SELECT source AS a, target AS b FROM edges_ UNION SELECT target, source FROM edges_),
walk(node, hop) AS (SELECT 'r0', 0 UNION SELECT b, hop + 1 FROM walk JOIN u ON u.a = walk.node WHERE hop < 2)
SELECT node, CAST(min(hop) AS INT) AS level FROM walk GROUP BY node HAVING node <> 'r0'""",
)
def _(spark, d):
    return graph.neighbors(S.edges(spark, d), "r0", 2)


@register(
    "paths_k",
    f"""{EDGES}, walk(path, node, hop) AS (SELECT ['o1'], 'o1', 0 UNION ALL SELECT list_append(path, target), target, hop + 1 FROM walk JOIN edges_ ON source = node WHERE hop < 3)
SELECT array_to_string(path, '>') AS path FROM walk WHERE node = (SELECT min('r' || n_regionkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 1)""",
)
def _(spark, d):
    o, c, n = (S.read(spark, d, t) for t in ("orders", "customer", "nation"))
    region = o.where("o_orderkey = 1").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).agg(F.min("n_regionkey")).first()[0]
    return graph.paths(S.edges(spark, d), "o1", f"r{region}", 3).select(F.array_join("path", ">").alias("path"))


@register(
    "related_entities",
    f"{EDGES} SELECT source, target, type, 'outgoing' AS direction FROM edges_ WHERE lower(trim(source)) = 'n3' UNION ALL SELECT source, target, type, 'incoming' FROM edges_ WHERE lower(trim(target)) = 'n3'",
)
def _(spark, d):
    return graph.related(S.edges(spark, d), " N3 ").select("source", "target", "type", "direction")


@register("relationship_stats", f"{EDGES} SELECT count(DISTINCT lower(trim(source))) AS n_subjects, count(DISTINCT lower(trim(target))) AS n_targets, count(DISTINCT lower(type)) AS n_types, count(*) AS total FROM edges_")
def _(spark, d):
    return graph.relationship_stats(S.edges(spark, d))


@register("relationships_by_type", f"{EDGES} SELECT source, target FROM edges_ WHERE type = 'in_region'")
def _(spark, d):
    return graph.by_type(S.edges(spark, d), "IN_REGION").select("source", "target")


QUALITY = r"""
len_ AS (SELECT *, length(trim(body, ' ')) AS n, coalesce(trim(summary) <> '', FALSE) AS has_summary, coalesce(trim(source) <> '', FALSE) AS has_source,
  contains(body, '#') AS heads, contains(body, '-') OR contains(body, '*') OR contains(body, '1.') AS lists FROM pages_),
quality_ AS (SELECT page_id, domain, created, greatest(0.0, least(1.0,
  0.3::DOUBLE * least(0.5::DOUBLE + CASE WHEN has_summary THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(tags) > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN kind <> '' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_source THEN 0.15::DOUBLE ELSE 0 END, 1.0::DOUBLE)
  + 0.4::DOUBLE * least(CASE WHEN n < 100 THEN 0.2::DOUBLE WHEN n < 500 THEN 0.5::DOUBLE + n / 500.0::DOUBLE * 0.3::DOUBLE ELSE 0.8::DOUBLE END + (CASE WHEN heads THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN lists THEN 0.1::DOUBLE ELSE 0 END), 1.0::DOUBLE)
  + 0.2::DOUBLE * CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END
  + 0.1::DOUBLE * CASE WHEN updated IS NULL THEN 0.0::DOUBLE WHEN created = updated THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)) AS score,
  array_to_string(list_filter([CASE WHEN NOT has_summary THEN CASE WHEN coalesce(summary, '') = '' THEN 'Missing summary' ELSE 'Empty summary' END END,
    CASE WHEN NOT has_source THEN 'Missing source' END, CASE WHEN n < 100 THEN 'Very short content (' || n || ' chars)' END,
    CASE WHEN NOT heads THEN 'No headings' END, CASE WHEN NOT lists THEN 'No lists or bullet points' END], lambda x: x IS NOT NULL), ';') AS issues FROM len_)"""


@register("quality_scores", f"{PAGES},{QUALITY} SELECT page_id, round(score, 9) AS score, issues FROM quality_")
def _(spark, d):
    return rounded(governance.quality(S.pages(spark, d)), "score").withColumn("issues", F.array_join("issues", ";"))


@register("quality_low", f"{PAGES},{QUALITY} SELECT page_id, round(score, 9) AS score FROM quality_ WHERE quality_.score <= 0.6")
def _(spark, d):
    return rounded(governance.low_quality(S.pages(spark, d)), "score").select("page_id", "score")


STALE = f"""
stale_ AS (SELECT page_id, CAST(greatest(0, floor(epoch(TIMESTAMP '{AS_OF}' - coalesce(updated, created)) / 86400)) AS INT) AS age_days, created, updated, body FROM pages_),
staleness_ AS (SELECT page_id, age_days, least(1.0, CASE WHEN age_days > 180 THEN 0.6::DOUBLE WHEN age_days > 90 THEN 0.4::DOUBLE WHEN age_days > 30 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN created = updated THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(body), '{"|".join(f"(?:{p})" for p in T.TIME_SENSITIVE)}') THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN len(regexp_extract_all(body, 'https?://')) > 5 THEN 0.2::DOUBLE ELSE 0 END) AS score FROM stale_)"""


@register("staleness_scores", f"{PAGES},{STALE} SELECT page_id, round(score, 9) AS score, age_days FROM staleness_")
def _(spark, d):
    return rounded(governance.staleness(S.pages(spark, d), AS_OF), "score")


@register("stale_pages", f"{PAGES},{STALE} SELECT page_id, round(score, 9) AS score, age_days FROM staleness_ WHERE staleness_.score >= 0.3")
def _(spark, d):
    return rounded(governance.stale(S.pages(spark, d), AS_OF), "score")


LINT = """
lint_ AS (SELECT page_id, 'missing_required_field' AS rule, 'title' AS field, 'error' AS severity FROM pages_ WHERE coalesce(title, '') = ''
UNION ALL SELECT page_id, 'invalid_kind', 'kind', 'error' FROM pages_ WHERE kind NOT IN ('page', 'entity', 'concept', 'source')
UNION ALL SELECT page_id, 'missing_summary', 'summary', 'info' FROM pages_ WHERE coalesce(summary, '') = ''
UNION ALL SELECT page_id, 'missing_source', 'source', 'warning' FROM pages_ WHERE kind IN ('entity', 'concept') AND source IS NULL)"""


@register("lint_issues", f"{PAGES},{LINT} SELECT * FROM lint_")
def _(spark, d):
    return governance.lint(S.pages(spark, d))


@register("lint_by_page", f"{PAGES},{LINT} SELECT page_id, count(*) AS n_issues, count(*) FILTER (WHERE severity = 'error') AS n_errors, array_to_string(list_sort(list(rule)), ',') AS rules FROM lint_ GROUP BY 1")
def _(spark, d):
    return governance.lint_by_page(governance.lint(S.pages(spark, d)))


KEYWORDS_SQL = "kw_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS) + ") t(suggested, keyword))"


@register(
    "routing_mistakes",
    f"""{PAGES},{KEYWORDS_SQL}, hit_ AS (SELECT page_id, p.domain, suggested, 0.5::DOUBLE * count(*) / any_value(len(tags)) AS score
  FROM (SELECT page_id, domain, tags, unnest(tags) AS keyword FROM pages_) p JOIN kw_ ON kw_.keyword = p.keyword AND suggested <> p.domain GROUP BY 1, 2, 3)
SELECT page_id, domain, suggested, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, suggested) AS r FROM hit_) WHERE r = 1 AND score >= 0.2""",
)
def _(spark, d):
    kw = spark.createDataFrame(KEYWORDS, "domain string, keyword string")
    return governance.routing_mistakes(S.pages(spark, d), kw, least=0.2)


@register(
    "domain_routing",
    f"""{PAGES} SELECT page_id, CASE WHEN domain IN ('src3', 'src4') THEN domain WHEN contains(coalesce(source, ''), 'doc/1') THEN 'alpha' WHEN contains(coalesce(source, ''), 'doc/2') THEN 'beta' ELSE 'general' END AS domain FROM pages_""",
)
def _(spark, d):
    p = S.pages(spark, d).select("page_id", F.col("source").alias("source_path"), F.col("domain").alias("stated_domain"))
    return governance.route(p, ["src3", "src4"], PATH_RULES, "general").select("page_id", "domain")


DUPLICATES = r"""
d_ AS (SELECT page_id AS id, array_to_string(list_filter(regexp_split_to_array(trim(lower(title)), '\s+'), lambda w: w NOT IN ('the', 'a', 'an', '')), ' ') AS name,
  list_distinct(list_filter(regexp_split_to_array(lower(body), '\s+'), lambda w: length(w) > 2)) AS words, length(body) AS n FROM pages_ WHERE kind <> 'source'),
j_ AS (SELECT a.id AS id_1, b.id AS id_2, a.n AS n_1, b.n AS n_2, CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) END AS j FROM d_ a JOIN d_ b ON a.name = b.name AND a.name <> '' AND a.id < b.id),
dup_ AS (SELECT *, 0.4::DOUBLE + CASE WHEN j >= 0.3 THEN 0.1::DOUBLE * j ELSE 0 END AS score FROM j_)"""


@register(
    "duplicate_pairs",
    f"""{PAGES},{DUPLICATES} SELECT id_1, id_2, round(score, 9) AS score, CASE WHEN dup_.score > 0.8 THEN 'merge' WHEN dup_.score >= 0.5 THEN 'redirect' ELSE 'keep_both' END AS action,
CASE WHEN dup_.score > 0.8 THEN 'high' WHEN dup_.score >= 0.5 THEN 'medium' ELSE 'low' END AS band, CASE WHEN n_1 >= n_2 THEN id_1 ELSE id_2 END AS primary_id FROM dup_ WHERE dup_.score >= 0.43""",
)
def _(spark, d):
    return rounded(matching.duplicates(S.pages(spark, d), 0.43), "score")


@register("duplicate_bands", f"{PAGES},{DUPLICATES} SELECT CASE WHEN score > 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM dup_ WHERE score >= 0.43 GROUP BY 1")
def _(spark, d):
    return matching.duplicates(S.pages(spark, d), 0.43).groupBy("band").agg(F.count("*").alias("n"))


@register(
    "contradictions_numeric",
    rf"""{CLAIMS}, n_ AS (SELECT page_id, claim_no, regexp_replace(text, '\d+', 'NUM', 'g') AS masked, list_transform(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b'), lambda x: x::DOUBLE) AS nums FROM claims_ WHERE regexp_matches(text, '\b\d')),
p_ AS (SELECT a.page_id AS page_1, a.claim_no AS claim_1, b.page_id AS page_2, b.claim_no AS claim_2, list_min(flatten(list_transform(a.nums, lambda x: list_transform(b.nums, lambda y: abs(x - y))))) AS gap
  FROM n_ a JOIN n_ b ON a.masked = b.masked AND a.page_id < b.page_id)
SELECT page_1, claim_1, page_2, claim_2, 'numerical' AS kind, 0.85::DOUBLE AS confidence, CASE WHEN gap > 10 THEN 'high' ELSE 'medium' END AS severity FROM p_ WHERE gap > 0""",
)
def _(spark, d):
    return matching.numeric_contradictions(S.claims(spark, d))


@register("contradictions")
def _(spark, d):
    return matching.contradictions(S.claims(spark, d))


PROMOTION = f"""{PAGES},{QUALITY}, refs_ AS (SELECT DISTINCT (doc_id * 7 + k) % (SELECT count(*) FROM documents) AS dst, doc_id AS src FROM documents, range(1, 4) t(k)),
c_ AS (SELECT dst AS page_id, count(*) FILTER (WHERE a.domain <> b.domain) AS cross_refs, count(*) AS total FROM refs_ JOIN pages_ a ON a.page_id = dst JOIN pages_ b ON b.page_id = src WHERE src <> dst GROUP BY 1),
s_ AS (SELECT page_id, cross_refs, total, q.score AS quality, floor(epoch(TIMESTAMP '{AS_OF}' - created) / 86400) AS days FROM c_ JOIN quality_ q USING (page_id) WHERE cross_refs >= 2 AND q.score >= 0.6),
t_ AS (SELECT *, 2.0::DOUBLE * cross_refs + 0.5::DOUBLE * total + quality + 0.3::DOUBLE * CASE WHEN days <= 0 THEN 1.0::DOUBLE WHEN days >= 365 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - days / 365.0::DOUBLE END AS score FROM s_)"""


def references(spark, d):
    docs = S.read(spark, d, "documents").select("doc_id")
    n = docs.count()
    return docs.select(F.col("doc_id").alias("src"), F.explode(F.array(*[(F.col("doc_id") * 7 + k) % n for k in (1, 2, 3)])).alias("dst"))


@register(
    "promotion_candidates",
    f"""{PROMOTION}
SELECT page_id, cross_refs AS "cross", total, round(quality, 9) AS quality, round(score, 9) AS score, CASE WHEN t_.score >= 10 THEN 'auto' WHEN t_.score >= 5 THEN 'suggest' ELSE 'none' END AS decision FROM t_""",
)
def _(spark, d):
    return rounded(governance.promotion(references(spark, d), S.pages(spark, d), AS_OF), "quality", "score")


MERGE = """
o_ AS (SELECT * FROM pages_ WHERE page_id % 3 <> 0), n_ AS (SELECT page_id, 'New ' || title AS title, domain, ['new'] AS tags, CASE WHEN page_id % 2 = 0 THEN 'fresh' END AS summary, source, CASE WHEN page_id % 5 = 0 THEN 0.95::DOUBLE ELSE confidence END AS confidence FROM pages_ WHERE page_id % 3 <> 1)"""


def _sides(spark, d):
    p = S.pages(spark, d)
    new = p.where("page_id % 3 != 1").select(
        "page_id", F.concat(F.lit("New "), "title").alias("title"), "domain", F.array(F.lit("new")).alias("tags"), F.when(F.col("page_id") % 2 == 0, "fresh").alias("summary"), "source", F.when(F.col("page_id") % 5 == 0, 0.95).otherwise(F.col("confidence")).alias("confidence")
    )
    return p.where("page_id % 3 != 0"), new


@register(
    "integrate_records",
    f"""{PAGES},{MERGE}, b_ AS (SELECT coalesce(o.page_id, n.page_id) AS page_id, o.page_id IS NOT NULL AS had, o.title AS t, n.title AS nt, o.domain AS d, n.domain AS nd, o.tags AS g, n.tags AS ng, o.summary AS s, n.summary AS ns,
  o.source AS c, n.source AS nc, o.confidence AS f, n.confidence AS nf, coalesce(nullif(n.confidence, 0), 1.0) - coalesce(nullif(o.confidence, 0), 0.5) AS gap FROM o_ o FULL JOIN n_ n ON o.page_id = n.page_id),
m_ AS (SELECT page_id, had, t, g, s, f, gap, ns, nf, coalesce(t, nt) AS title, coalesce(d, nd) AS domain, CASE WHEN ng IS NULL THEN g WHEN g IS NULL THEN ng ELSE list_concat(g, list_filter(ng, lambda x: NOT list_contains(g, x))) END AS tags,
  CASE WHEN ns IS NULL THEN s WHEN s IS NULL OR (s <> ns AND gap > 0.1) THEN ns ELSE s END AS summary, coalesce(c, nc) AS source, c,
  CASE WHEN nf IS NULL THEN f WHEN f IS NULL OR (f <> nf AND gap > 0.1) THEN nf ELSE f END AS confidence FROM b_)
SELECT page_id, title, domain, array_to_string(tags, ',') AS tags, summary, source, confidence,
  CASE WHEN had THEN CAST((tags IS DISTINCT FROM g)::INT + (summary IS DISTINCT FROM s)::INT + (source IS DISTINCT FROM c)::INT + (confidence IS DISTINCT FROM f)::INT + (title IS DISTINCT FROM t)::INT AS BIGINT) ELSE 0 END AS n_changes,
  array_to_string(list_filter([CASE WHEN s <> ns AND abs(gap) <= 0.1 THEN 'summary' END, CASE WHEN f <> nf AND abs(gap) <= 0.1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM m_""",
)
def _(spark, d):
    return records.integrate(*_sides(spark, d)).withColumn("tags", F.array_join("tags", ","))


@register(
    "record_diff",
    f"""{PAGES},{MERGE}, x_ AS (SELECT coalesce(o.page_id, n.page_id) AS page_id, unnest([{{'field': 'title', 'o': o.title, 'n': n.title}}, {{'field': 'summary', 'o': o.summary, 'n': n.summary}}]) AS x FROM o_ o FULL JOIN n_ n ON o.page_id = n.page_id)
SELECT page_id, x.field AS field, CASE WHEN x.o IS NULL THEN 'added' WHEN x.n IS NULL THEN 'removed' ELSE 'modified' END AS change, x.o AS old_value, x.n AS new_value FROM x_ WHERE x.o IS DISTINCT FROM x.n""",
)
def _(spark, d):
    return records.diff(*_sides(spark, d), ["title", "summary"])


CHANGES = "WITH " + S.CHANGES_SQL
IDENT = "substring(sha1(page_id || '::' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '::' || seq), 1, 16)"


@register("recent_changes", f"{CHANGES} SELECT page_id, seq, actor FROM changes_ WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, seq DESC LIMIT 100")
def _(spark, d):
    return records.recent_changes(S.changes(spark, d), "2024-01-20 00:00:00").select("page_id", "seq", "actor")


@register("page_history", f"{CHANGES} SELECT page_id, seq, actor FROM changes_ WHERE page_id = 8 ORDER BY seq DESC LIMIT 50")
def _(spark, d):
    return records.page_history(S.changes(spark, d), 8).select("page_id", "seq", "actor")


@register("changes_by_actor", f"{CHANGES} SELECT page_id, seq FROM changes_ WHERE actor = 'signup'")
def _(spark, d):
    return records.changes_by_actor(S.changes(spark, d), "signup").select("page_id", "seq")


@register("change_parents", f"{CHANGES}, i_ AS (SELECT *, {IDENT} AS change_id FROM changes_) SELECT page_id, seq, change_id, lag(change_id) OVER (PARTITION BY page_id ORDER BY seq) AS parent_id FROM i_")
def _(spark, d):
    return records.with_parents(S.changes(spark, d)).select("page_id", "seq", "change_id", "parent_id")


@register("history_cap", f"{CHANGES} SELECT page_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) AS r FROM changes_) WHERE r <= 20")
def _(spark, d):
    return records.capped(S.changes(spark, d), "page_id", "seq", 20).select("page_id", "seq")


@register(
    "change_stats",
    f"""{CHANGES} SELECT 'total' AS dimension, '*' AS value, count(*) AS n FROM changes_ UNION ALL SELECT 'type', change_type, count(*) FROM changes_ GROUP BY 2 UNION ALL SELECT 'actor', actor, count(*) FROM changes_ GROUP BY 2
UNION ALL (SELECT 'page', CAST(page_id AS VARCHAR) AS value, count(*) AS n FROM changes_ GROUP BY 2 ORDER BY n DESC, value LIMIT 10)""",
)
def _(spark, d):
    return records.change_stats(S.changes(spark, d))


REVIEWS = """WITH reviews_ AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'approved' WHEN event_id % 4 = 2 THEN 'deferred' ELSE 'pending' END AS status,
  CASE WHEN value > 50 THEN 'urgent' WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'medium' ELSE 'low' END AS priority FROM events)"""


def _reviews(spark, d):
    i, v = F.col("event_id"), F.col("value")
    return S.read(spark, d, "events").select(
        i.cast("string").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"), F.when(i % 4 == 0, "pending").when(i % 4 == 1, "approved").when(i % 4 == 2, "deferred").otherwise("pending").alias("status"),
        F.when(v > 50, "urgent").when(v > 20, "high").when(v > 5, "medium").otherwise("low").alias("priority"),
    )


@register("review_counts", f"{REVIEWS} SELECT s AS status, count(id) AS n FROM (SELECT unnest(['pending', 'approved', 'rejected', 'deferred']) AS s) LEFT JOIN reviews_ ON status = s GROUP BY 1")
def _(spark, d):
    return records.review_counts(_reviews(spark, d))


@register(
    "review_stats",
    f"{REVIEWS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, " + ", ".join(f"count(*) FILTER (WHERE status = 'pending' AND priority = '{p}') AS pending_{p}" for p in records.PRIORITIES) + " FROM reviews_",
)
def _(spark, d):
    return records.review_stats(_reviews(spark, d))


@register("review_list", f"{REVIEWS} SELECT id, priority FROM reviews_ WHERE status = 'pending' AND type = 'error'")
def _(spark, d):
    return records.review_list(_reviews(spark, d), "pending", "error").select("id", "priority")


ERRORS = ("Connection timeout", "network down", "try again later", "invalid header", "corrupt file", "missing metadata", "schema mismatch", "odd")
FAILED = (
    "WITH a_ AS (SELECT 'f' || user_id AS file_path, ts, ["
    + ", ".join(f"'{e}'" for e in ERRORS)
    + """][CAST(event_id % 8 + 1 AS INT)] AS error FROM events WHERE event_type = 'error'),
r_ AS (SELECT *, ['llm_timeout', 'network_error', 'temporary_error', 'invalid_format', 'corrupted_file', 'missing_metadata', 'schema_validation_failed', 'unknown'][list_position(["""
    + ", ".join(f"'{e}'" for e in ERRORS)
    + """], error)] AS reason FROM a_),
g_ AS (SELECT file_path, count(*) AS failure_count, max(ts) AS last_attempt, arg_max(reason, ts) AS reason, bool_or(reason IN ('invalid_format', 'corrupted_file', 'unsupported_type', 'permission_denied')) OR count(*) >= 5 AS permanent FROM r_ GROUP BY 1),
state_ AS (SELECT *, CASE WHEN NOT permanent THEN last_attempt + to_seconds([300, 1800, 7200, 21600, 86400][CAST(least(failure_count, 5) AS INT)]) END AS next_retry FROM g_)"""
)


def failed_files(spark, d):
    e = S.read(spark, d, "events").where("event_type = 'error'")
    return records.failures(e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_path"), F.col("ts").alias("at"), F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % 8 + 1).cast("int")).alias("error")))


@register("failure_state", f"{FAILED} SELECT file_path, failure_count, last_attempt, reason, permanent, next_retry FROM state_")
def _(spark, d):
    return failed_files(spark, d)


@register(
    "failure_stats",
    f"""{FAILED} SELECT reason, count(*) AS n, count(*) FILTER (WHERE permanent) AS n_permanent, count(*) FILTER (WHERE reason IN ('llm_timeout', 'network_error', 'temporary_error')) AS n_transient,
count(*) FILTER (WHERE NOT permanent AND next_retry <= TIMESTAMP '{EVENTS_AS_OF}') AS n_retryable FROM state_ GROUP BY 1""",
)
def _(spark, d):
    return records.failure_stats(failed_files(spark, d), EVENTS_AS_OF)


# A file is a user and one of four runs of eight events, so that files with few failures occur too.
FAILED_ALL = FAILED.replace("'f' || user_id AS file_path", "'f' || user_id || '-' || (event_id // 8 % 4) AS file_path")


def all_failures(spark, d):
    path = F.concat_ws("-", F.concat(F.lit("f"), F.col("user_id").cast("string")), F.expr("event_id div 8 % 4").cast("string"))
    error = F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % 8 + 1).cast("int"))
    return records.failures(S.read(spark, d, "events").where("event_type = 'error'").select(path.alias("file_path"), F.col("ts").alias("at"), error.alias("error")))


@register("failure_state_all", ORACLE_SQL["failure_state"].replace(FAILED, FAILED_ALL))
def _(spark, d):
    return all_failures(spark, d)


@register("failure_stats_all", ORACLE_SQL["failure_stats"].replace(FAILED, FAILED_ALL))
def _(spark, d):
    return records.failure_stats(all_failures(spark, d), EVENTS_AS_OF)


JOBS = "WITH " + S.EXECUTIONS_SQL


@register(
    "job_stats",
    f"""{JOBS} SELECT job_name, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
round(count(*) FILTER (WHERE status = 'completed') / count(*), 9) AS success_rate, round(avg(duration_seconds), 6) AS avg_duration,
count(*) FILTER (WHERE status = 'failed' AND started_at > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 600 MINUTES) AS recent_failures, arg_max(status, execution_id) AS last_status, arg_max(started_at, execution_id) AS last_started FROM executions_ GROUP BY 1""",
)
def _(spark, d):
    return rounded(records.job_stats(S.executions(spark, d), EVENTS_AS_OF, 600), "success_rate").withColumn("avg_duration", F.round("avg_duration", 6))


LLMS = """
llms_ AS (SELECT page_id, domain, created, updated, confidence, concat_ws(chr(10), '# ' || title, '', '<!-- id: ' || page_id || ' -->', '<!-- domain: ' || domain || ' -->', '<!-- kind: ' || kind || ' -->',
  CASE WHEN len(tags) > 0 THEN '<!-- tags: ' || array_to_string(tags, ', ') || ' -->' END, '', CASE WHEN summary <> '' THEN '> ' || summary || chr(10) END, trim(body, ' '), '') AS content FROM pages_)"""


@register("llms_txt", f"{PAGES},{LLMS} SELECT page_id, domain, content FROM llms_")
def _(spark, d):
    return export.llms_txt(S.pages(spark, d))


@register("llms_domains", f"{PAGES},{LLMS} SELECT domain, 0::BIGINT AS part, string_agg(content, chr(10) || '---' || chr(10) || chr(10) ORDER BY page_id) AS content FROM llms_ GROUP BY 1")
def _(spark, d):
    return export.llms_domains(S.pages(spark, d))


@register(
    "llms_full_filtered",
    f"""{PAGES},{LLMS} SELECT page_id, domain, content || chr(10) || 'Confidence: ' || CAST(round(confidence * 100) AS INT) || '%' AS content FROM llms_
WHERE confidence >= 0.5 AND coalesce(updated, created) >= TIMESTAMP '2023-09-01' ORDER BY domain, page_id LIMIT 50""",
)
def _(spark, d):
    return export.llms_full(S.pages(spark, d), 0.5, "2023-09-01 00:00:00", 50)


@register(
    "json_sidecar",
    rf"{PAGES} SELECT page_id, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS INT) AS word_count, CAST(length(body) AS INT) AS char_count, trim(body, ' ') <> '' AS has_content FROM pages_",
)
def _(spark, d):
    return export.sidecar(S.pages(spark, d)).select("page_id", "word_count", "char_count", "has_content")


@register("graph_export", f"{EDGES} SELECT source || '->' || target AS key, '{{\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"type\":\"' || type || '\"}}' AS json, 'edge' AS part FROM edges_")
def _(spark, d):
    return export.graph_json(S.pages(spark, d), S.edges(spark, d)).where("part = 'edge'")


@register(
    "graph_export_all",
    f"{EDGES},{S.PAGES_SQL}" + ORACLE_SQL["graph_export"].removeprefix(EDGES) + """
UNION ALL SELECT CAST(page_id AS VARCHAR), CAST(json_object('id', page_id, 'label', title, 'domain', domain, 'kind', kind) AS VARCHAR), 'node' FROM pages_""",
)
def _(spark, d):
    return export.graph_json(S.pages(spark, d), S.edges(spark, d))


@register("sitemap", f"{PAGES} SELECT 'https://wiki.example/' || domain || '/' || page_id AS loc, coalesce(strftime(updated, '%Y-%m-%d'), '2024-01-01') AS lastmod FROM pages_")
def _(spark, d):
    return export.sitemap(S.pages(spark, d), "https://wiki.example", "2024-01-01")


@register("export_stats", f"{PAGES} SELECT count(*) AS n_pages, count(DISTINCT domain) AS n_domains, (SELECT count(*) FROM pages_ WHERE page_id % 2 = 0) AS n_with_backlinks FROM pages_")
def _(spark, d):
    p = S.pages(spark, d)
    return export.export_stats(p, p.where("page_id % 2 = 0").select(F.col("page_id").alias("dst"), F.lit(1).alias("n_backlinks")))


@register(
    "governance_summary",
    f"""{PAGES},{QUALITY},{STALE},{LINT},{S.LINKS_SQL} SELECT 'lint_errors' AS "check", count(*) AS n FROM lint_ WHERE severity = 'error' UNION ALL SELECT 'lint_warnings', count(*) FROM lint_ WHERE severity = 'warning'
UNION ALL SELECT 'stale', count(*) FROM staleness_ WHERE score >= 0.3 UNION ALL SELECT 'low_quality', count(*) FROM quality_ WHERE score <= 0.6
UNION ALL SELECT 'broken_links', count(*) FROM links_ WHERE dst NOT IN (SELECT page_id FROM site_) UNION ALL SELECT 'orphans', count(*) FROM site_ WHERE page_id NOT IN (SELECT dst FROM links_)""",
)
def _(spark, d):
    return export.governance_summary(S.pages(spark, d), AS_OF, S.links(spark, d), S.site_pages(spark, d))


@register(
    "session_markdown",
    """SELECT conv_id, count(*) AS n_messages, string_agg('## ' || (turn + 1) || '. ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || trim(text, ' '), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""",
)
def _(spark, d):
    return pagefiles.sessions(S.read(spark, d, "conversations"))


@register("slug_ids")
def _(spark, d):
    p = S.pages(spark, d).select("title", "domain", F.col("page_id").cast("string").alias("path"))
    return pagefiles.with_ids(p).select("path", "page_id")


@register("slug_id_totals", f"{PAGES} SELECT count(*) FILTER (WHERE regexp_matches(strip_accents(title), '[a-zA-Z0-9]')) AS n_ids, count(*) FILTER (WHERE regexp_matches(strip_accents(title), '[a-zA-Z0-9]')) AS n_distinct, count(*) AS n_pages FROM pages_")
def _(spark, d):
    p = S.pages(spark, d).select("title", "domain", F.col("page_id").cast("string").alias("path"))
    return pagefiles.with_ids(p).agg(F.count("page_id").alias("n_ids"), F.countDistinct("page_id").alias("n_distinct"), F.count("*").alias("n_pages"))


@register("slug_ascii", rf"{PAGES} SELECT page_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages_")
def _(spark, d):
    return S.pages(spark, d).select("page_id", T.slug_ascii(F.col("title")).alias("slug"))


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from tessera.streaming import inbox

    w = inbox.event_windows(S.read(spark, d, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


from tessera.plans import extended  # noqa: E402, F401  (registers more)
from tessera.plans import complete  # noqa: E402, F401  (registers more)
from tessera.plans import coverage  # noqa: E402, F401  (registers the rest)
