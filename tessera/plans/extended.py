"""More registered queries, with their SQL: links in Markdown, lint of types, routing by links, and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import export, governance, graph, links, matching, metadata, records
from tessera.plans.registry import AS_OF, CHANGES, DUPLICATES, EVENTS_AS_OF, FAILED_ALL, LINKS, LLMS, PAGES, PROMOTION, all_failures, references, register, rounded
from tessera.sources import tables as S

# Words of nine letters and more stand as links, of eight as links with an alias, of seven as embeds, of six as hashtags
MARKED = ((" ([a-z]{9,}) ", " [[{}]] "), (" ([a-z]{8}) ", " [[{}|x]] "), (" ([a-z]{7}) ", " ![[{}]] "), (" ([a-z]{6}) ", " #{} "))


def _notes(spark, d):
    text = F.col("text")
    for pattern, mark in MARKED:
        text = F.regexp_replace(text, pattern, mark.format("$1"))
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), text.alias("body"))


_marked = "text"
for _pattern, _mark in MARKED:
    _marked = f"regexp_replace({_marked}, '{_pattern}', '{_mark.format(chr(92) + '1')}', 'g')"
NOTES = f"WITH notes_ AS (SELECT doc_id AS page_id, {_marked} AS body FROM documents)"
LINK_SQL = r"""'\[\[([^|\]]+)(?:\|[^\]]+)?\]\]'"""
WIKI_SQL = f"w_ AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(body, {LINK_SQL}, 1)) AS dst FROM notes_)"


@register("wiki_links", f"{NOTES}, {WIKI_SQL} SELECT * FROM w_")
def _(spark, d):
    return links.extract(_notes(spark, d))


@register("raw_wiki_links", rf"{NOTES} SELECT DISTINCT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS dst FROM notes_")
def _(spark, d):
    return links.extract(_notes(spark, d), T.RAW_LINK)


@register(
    "vault_notes",
    r"""{0}, v_ AS (SELECT page_id, list_filter(regexp_extract_all(body, '!?\[\[[^\]|]+(?:\|[^\]]+)?\]\]'), lambda x: x[1] <> '!') AS l, regexp_extract_all(body, '!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1) AS e,
regexp_extract_all(body, '#([a-zA-Z0-9_\-]+)', 1) AS t FROM notes_)
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(l, lambda x: regexp_extract(x, '\[\[([^\]|]+)', 1)))), ',') AS links,
array_to_string(list_sort(list_distinct(e)), ',') AS embeds, array_to_string(list_sort(list_distinct(t)), ',') AS tags FROM v_""".replace("{0}", NOTES),
)
def _(spark, d):
    from tessera.sources import pagefiles

    notes = _notes(spark, d).select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("body").alias("content"))
    out = pagefiles.vault_note(notes).withColumn("page_id", F.regexp_extract("path", r"^(-?\d+)", 1).cast("long"))
    return out.select("page_id", *[F.array_join(F.sort_array(c), ",").alias(c) for c in ("links", "embeds", "tags")])


@register("wiki_link_targets", f"{NOTES}, {WIKI_SQL} SELECT dst, count(*) AS n_backlinks FROM w_ GROUP BY 1")
def _(spark, d):
    return links.backlink_counts(links.extract(_notes(spark, d)))


@register("rename_links", f"{LINKS} SELECT DISTINCT CASE WHEN src = dst_ THEN 'renamed' ELSE src END AS src, CASE WHEN dst = dst_ THEN 'renamed' ELSE dst END AS dst FROM links_, (SELECT min(dst) AS dst_ FROM links_)")
def _(spark, d):
    every = S.links(spark, d)
    return links.rename(every, every.agg(F.min("dst")).first()[0], "renamed")


@register("links_without_page", f"{LINKS} SELECT src, dst FROM links_ WHERE src <> (SELECT min(src) FROM links_)")
def _(spark, d):
    every = S.links(spark, d)
    return links.remove_page(every, every.agg(F.min("src")).first()[0])


@register("stale_index_entries", f"{LINKS}, live_ AS (SELECT page_id FROM site_ WHERE length(page_id) % 2 = 0) SELECT page_id FROM site_ WHERE page_id NOT IN (SELECT page_id FROM live_) AND page_id NOT IN (SELECT dst FROM links_ WHERE src IN (SELECT page_id FROM live_))")
def _(spark, d):
    site = S.site_pages(spark, d)
    return links.stale(site, site.where(F.char_length("page_id") % 2 == 0), S.links(spark, d)).select("page_id")


@register("related_orphans", "WITH r_ AS (SELECT doc_id AS page_id, [doc_id // 2, doc_id] AS related_pages FROM documents) SELECT page_id FROM r_ WHERE page_id NOT IN (SELECT x FROM (SELECT page_id AS by_, unnest(related_pages) AS x FROM r_) WHERE by_ <> x)")
def _(spark, d):
    i = F.col("doc_id")
    rel = S.read(spark, d, "documents").select(i.alias("page_id"), F.array(F.expr("doc_id div 2"), i).alias("related_pages"))
    return links.related_orphans(rel)


HEADERS = """WITH h_ AS (SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN '{"title":"T","tags":["a"],"summary":"s"}' WHEN 1 THEN '{"title":5,"tags":"a"}' WHEN 2 THEN '{"id":true,"entities":"x","tags":null}' ELSE '{"domain":["d"],"kind":1.5}' END AS j FROM documents)"""


@register(
    "lint_field_types",
    HEADERS + """ SELECT page_id, rule, field, 'error' AS severity FROM h_ JOIN (VALUES (1, 'invalid_field_type', 'title'), (1, 'invalid_field_type', 'tags'), (1, 'invalid_tags_type', 'tags'), (2, 'invalid_field_type', 'id'),
(2, 'invalid_field_type', 'entities'), (3, 'invalid_field_type', 'domain'), (3, 'invalid_field_type', 'kind')) t(k, rule, field) ON page_id % 4 = k""",
)
def _(spark, d):
    i = F.col("doc_id")
    j = F.when(i % 4 == 0, '{"title":"T","tags":["a"],"summary":"s"}').when(i % 4 == 1, '{"title":5,"tags":"a"}').when(i % 4 == 2, '{"id":true,"entities":"x","tags":null}').otherwise('{"domain":["d"],"kind":1.5}')
    return governance.lint_types(S.read(spark, d, "documents").select(i.alias("page_id"), F.parse_json(j).alias("meta")))


@register(
    "routing_by_links",
    f"""{PAGES}, kw_ AS (SELECT 'none' AS suggested, 'none' AS keyword), l_ AS (SELECT page_id AS src, page_id - k AS dst FROM pages_, range(1, 4) t(k) WHERE page_id - k >= 0),
r_ AS (SELECT src, b.domain AS suggested, count(*) AS k, sum(count(*)) OVER (PARTITION BY src) AS n FROM l_ JOIN pages_ b ON b.page_id = dst GROUP BY 1, 2),
s_ AS (SELECT src AS page_id, domain, suggested, 0.4::DOUBLE * k / n AS score FROM r_ JOIN pages_ p ON p.page_id = src WHERE n >= 2 AND suggested <> domain AND k / n >= 0.6)
SELECT page_id, domain, suggested, round(score, 9) AS score FROM s_ WHERE score >= 0.2""",
)
def _(spark, d):
    p = S.pages(spark, d)
    i = F.col("page_id")
    made = p.select(i.alias("src"), F.explode(F.array(*[i - k for k in (1, 2, 3)])).alias("dst")).where("dst >= 0")
    kw = spark.createDataFrame([("none", "none")], "domain string, keyword string")
    text = lambda df: df.withColumn("dst", F.col("dst").cast("string"))
    out = governance.routing_mistakes(p.withColumn("page_id", i.cast("string")), kw, text(made).withColumn("src", F.col("src").cast("string")), least=0.2)
    return rounded(out.withColumn("page_id", F.col("page_id").cast("long")), "score")


@register(
    "edges_upserted",
    """WITH e_ AS (SELECT 'u' || user_id AS source, event_type AS target, CASE WHEN event_id % 2 = 0 THEN 'uses' ELSE 'cites' END AS type, value / 50.0 AS w, event_id % 5 = 0 AS bidirectional, event_id AS seq FROM events),
l_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY seq DESC) AS r FROM e_) WHERE r = 1)
SELECT source, target, type, round(greatest(0.0, least(1.0, w))::DOUBLE, 9) AS weight FROM l_ UNION ALL SELECT target, source, type, round(greatest(0.0, least(1.0, w))::DOUBLE, 9) FROM l_ WHERE bidirectional""",
)
def _(spark, d):
    i = F.col("event_id")
    e = S.read(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"), F.when(i % 2 == 0, "uses").otherwise("cites").alias("type"), (F.col("value") / 50.0).alias("weight"), (i % 5 == 0).alias("bidirectional"), i.alias("seq")
    )
    return rounded(graph.upserted(e).select("source", "target", "type", "weight"), "weight")


@register("pages_upserted", f"{PAGES} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'New' ELSE title END AS title FROM pages_ WHERE page_id % 5 <> 1")
def _(spark, d):
    p = S.pages(spark, d)
    new = p.where("page_id % 3 = 0").withColumn("title", F.lit("New"))
    return metadata.remove(metadata.upsert(p, new), p.where("page_id % 5 = 1")).select("page_id", "title")


@register("rewritten_links", f"{NOTES}, t_ AS (SELECT min(dst) AS t FROM (SELECT unnest(regexp_extract_all(body, {LINK_SQL}, 1)) AS dst FROM notes_)) SELECT page_id, replace(replace(body, '[[' || t || ']]', '[[new]]'), '[[' || t || '|', '[[new|') AS body FROM notes_, t_")
def _(spark, d):
    notes = _notes(spark, d)
    old = links.extract(notes).agg(F.min("dst")).first()[0]
    return notes.select("page_id", matching.rewritten_links(F.col("body"), F.lit(old), F.lit("new")).alias("body"))


@register(
    "review_decisions",
    """WITH q_ AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, ts FROM events)
SELECT id, CASE WHEN status = 'pending' AND CAST(id AS BIGINT) % 3 = 0 THEN 'rejected' WHEN status = 'pending' AND CAST(id AS BIGINT) % 3 = 1 THEN 'deferred' ELSE status END AS status,
CASE WHEN status = 'pending' AND CAST(id AS BIGINT) % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS reviewed_at FROM q_""",
)
def _(spark, d):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    q = S.read(spark, d, "events").select(i.cast("string").alias("id"), F.when(i % 2 == 0, "pending").otherwise("approved").alias("status"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), none.alias("reviewed_by"), none.alias("notes"), i)
    made = q.where("event_id % 3 < 2").select("id", F.when(i % 3 == 0, "rejected").otherwise("deferred").alias("decision"), F.lit("r").alias("reviewer"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("at"), F.lit("n").alias("notes"))
    return records.decide(q.drop("event_id"), made).select("id", "status", "reviewed_at")


@register("review_cleanup", f"SELECT event_id AS id FROM events WHERE NOT coalesce(CASE WHEN event_id % 4 <> 0 THEN ts END < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 10 DAY, FALSE)")
def _(spark, d):
    items = S.read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("reviewed_at"))
    return records.review_cleanup(items, EVENTS_AS_OF, 10).select("id")


@register(
    "review_fan_in",
    """WITH p_ AS (SELECT doc_id AS a, doc_id + 1 AS b, (doc_id % 100) / 100.0 AS score FROM documents)
SELECT a || '|' || b AS target_id, CASE WHEN score > 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS priority FROM p_ WHERE score >= 0.5 AND a % 3 <> 0 ORDER BY p_.score DESC, a, b LIMIT 20""",
)
def _(spark, d):
    i = F.col("doc_id")
    pairs = S.read(spark, d, "documents").select((i + 1).alias("id_1"), i.alias("id_2"), ((i % 100) / 100.0).alias("score"))
    queued = pairs.where("id_2 % 3 = 0").select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"))
    return records.review_fan_in(pairs, queued, EVENTS_AS_OF).select("target_id", "priority")


@register("page_diff", f"{CHANGES} SELECT page_id, seq FROM changes_ WHERE page_id = 8 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 00:00:01'")
def _(spark, d):
    return records.page_diff(S.changes(spark, d), 8, "2024-01-05T00:00:00", "2024-01-20T00:00:00").select("page_id", "seq")


@register("enriched_pages", f"{PAGES} SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(tags, ['zeta', lower(kind)]))), ',') AS tags, coalesce(nullif(summary, ''), 'found') AS summary, 'enriched' AS status FROM pages_")
def _(spark, d):
    p = S.pages(spark, d)
    found = p.select("page_id", F.array(F.lit("zeta"), F.lower("kind")).alias("tags"), F.lit("found").alias("summary"), F.lit("page").alias("kind"))
    return records.enrich(p, found).select("page_id", F.array_join("tags", ",").alias("tags"), "summary", "status")


@register(
    "session_blocks",
    """SELECT conv_id, turn // 4 AS block, count(*) AS n_messages, string_agg('## ' || (turn + 1) || '. ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || trim(text, ' '), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1, 2""",
)
def _(spark, d):
    from tessera.sources import pagefiles

    return pagefiles.session_blocks(S.read(spark, d, "conversations"), 4)


RELS = """WITH rel_ AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'e' || doc_id % 7 END AS source, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 't' || doc_id % 11 END AS target,
  CASE WHEN doc_id % 4 <> 0 THEN 'Uses' END AS type, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE END AS weight FROM documents)"""
REL_EDGES = "re_ AS (SELECT coalesce(nullif(trim(source), ''), page_id) AS source, target, coalesce(lower(type), 'related_to') AS type, coalesce(weight, 0.9)::DOUBLE AS weight, page_id FROM rel_ WHERE trim(target) <> '')"


def _rels(spark, d):
    i = F.col("doc_id")
    part = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    return S.read(spark, d, "documents").select(
        i.cast("string").alias("page_id"), F.when(i % 3 == 1, "").when(i % 3 == 2, part("e", 7)).alias("source"), F.when(i % 5 == 0, " ").otherwise(part("t", 11)).alias("target"),
        F.when(i % 4 != 0, "Uses").alias("type"), F.when(i % 2 == 0, 0.5).alias("weight"),
    )


@register("edges_rebuilt", f"{RELS}, {REL_EDGES}, {NOTES.removeprefix('WITH ')}, r_ AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS source, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS target FROM notes_) SELECT source, target, 'links' AS type, 1.0::DOUBLE AS weight, source AS page_id FROM r_ UNION ALL SELECT * FROM re_")
def _(spark, d):
    return graph.rebuilt(_notes(spark, d), _rels(spark, d))


@register("edges_replaced", f"{RELS}, {REL_EDGES} SELECT * FROM re_ WHERE NOT (source IN (SELECT page_id FROM rel_ WHERE CAST(page_id AS INT) % 6 = 0) OR CAST(page_id AS INT) % 6 = 0) UNION ALL SELECT coalesce(nullif(trim(source), ''), page_id), 'new', 'related_to', 0.9, page_id FROM rel_ WHERE CAST(page_id AS INT) % 6 = 0")
def _(spark, d):
    rels = _rels(spark, d)
    of = rels.where("cast(page_id as int) % 6 = 0").select("page_id")
    new = rels.withColumns({"target": F.lit("new"), "type": F.lit(None).cast("string"), "weight": F.lit(None).cast("double")})
    return graph.replace_relationships(graph.relationship_edges(rels), new, of)


@register("relationships_rebuilt", f"{RELS} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(trim(source), '') = '' OR trim(target) = '') AS n_without_end FROM rel_")
def _(spark, d):
    return graph.rebuilt_relationships(_rels(spark, d))[1]


@register("relationships_added", f"{RELS} SELECT source, type, target, count(*) AS n FROM (SELECT source, type, target FROM rel_ UNION ALL SELECT DISTINCT source, type, target FROM rel_) GROUP BY ALL")
def _(spark, d):
    rels = _rels(spark, d).select("source", "type", "target")
    return graph.new_relationships(rels, rels).groupBy("source", "type", "target").agg(F.count("*").alias("n"))


@register("queue_stats", "SELECT event_type AS domain, count(*) FILTER (WHERE event_id % 4 < 2) AS processed, count(*) FILTER (WHERE event_id % 4 = 2) AS failed, count(*) FILTER (WHERE event_id % 4 = 3) AS skipped FROM events GROUP BY 1")
def _(spark, d):
    i = F.col("event_id")
    return records.queue_stats(S.read(spark, d, "events").select(F.col("event_type").alias("domain"), F.when(i % 4 < 2, "processed").when(i % 4 == 2, "failed").otherwise("skipped").alias("status")))


EXTRACTED = """x_ AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 3 <> 0 THEN [lang, source] END AS entities, CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [] END AS concepts, [text[1:20]] AS claims FROM documents WHERE doc_id % 7 <> 0)"""


def _extracted(spark, d):
    i = F.col("doc_id")
    return S.read(spark, d, "documents").where("doc_id % 7 != 0").select(
        i.alias("page_id"), F.when(i % 3 != 0, F.array("lang", "source")).alias("entities"), F.when(i % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("concepts"), F.array(F.substring("text", 1, 20)).alias("claims"),
        F.array(F.struct(F.col("lang").alias("source"), F.lit("uses").alias("type"), F.col("source").alias("target"))).alias("relationships"),
    )


@register("extraction_totals", f"WITH {EXTRACTED} SELECT page_id, coalesce(len(entities), 0) AS n_entities, len(concepts) AS n_concepts, 1::BIGINT AS n_claims, 1::BIGINT AS n_relationships, coalesce(len(entities), 0) + len(concepts) + 2 AS total, TRUE AS found_any FROM x_")
def _(spark, d):
    return records.extraction_totals(_extracted(spark, d))


@register(
    "llms_full_sections",
    f"""{PAGES},{LLMS},{EXTRACTED} SELECT l.page_id, l.domain, l.content || CASE WHEN x.page_id IS NULL THEN '' ELSE coalesce(chr(10) || chr(10) || '## Entities' || chr(10) || chr(10) || '- ' || array_to_string(entities, chr(10) || '- ') || chr(10), '')
|| CASE WHEN len(concepts) > 0 THEN chr(10) || chr(10) || '## Concepts' || chr(10) || chr(10) || '- ' || concepts[1] || chr(10) ELSE '' END || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || '- ' || claims[1] || chr(10)
|| chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10) || '- ' || d.lang || ' uses ' || d.source || chr(10) END AS content FROM llms_ l LEFT JOIN x_ x USING (page_id) JOIN documents d ON d.doc_id = l.page_id""",
)
def _(spark, d):
    return export.llms_full_sections(S.pages(spark, d), _extracted(spark, d))


@register("change_lines", f"{PAGES} SELECT page_id, '~ title: ' || CASE WHEN length(title) > 120 THEN title[1:120] || '…' ELSE title END || ' -> New' AS line FROM pages_ WHERE title <> 'New'")
def _(spark, d):
    p = S.pages(spark, d).select("page_id", "title")
    return records.change_lines(records.diff(p, p.withColumn("title", F.lit("New")), ["title"])).select("page_id", "line")


@register("low_quality_reviews", "SELECT CAST(doc_id AS VARCHAR) AS target_id, CASE WHEN quality * 0.3 < 0.2 THEN 'high' ELSE 'medium' END AS priority FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(spark, d):
    p = S.read(spark, d, "documents").join(S.read(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("page_id"), (F.col("quality") * 0.3).alias("quality_score"))
    return governance.low_quality_reviews(p, EVENTS_AS_OF).select("target_id", "priority")


@register("promotable_domains", "SELECT DISTINCT source AS domain FROM documents WHERE source <> 'src1'")
def _(spark, d):
    return metadata.promotable(S.read(spark, d, "documents").select(F.col("source").alias("domain"), (F.col("source") != "src1").alias("promote_to_shared")).distinct())


@register("page_paths", f"{PAGES} SELECT domain || '/pages/' || page_id || '.md' AS path, '---' || chr(10) || 'id: ' || page_id || chr(10) || 'domain: \"' || domain || '\"' || chr(10) || 'tags: [\"' || array_to_string(tags, '\",\"') || '\"]' || chr(10) || '---' || chr(10) || body AS content FROM pages_")
def _(spark, d):
    return export.page_file(S.pages(spark, d).select("page_id", "domain", "tags", "body"))


@register(
    "integrate_lists",
    """WITH x_ AS (SELECT doc_id, coalesce(lang, 'no lang') AS l, coalesce(source, 'no source') AS s FROM documents)
SELECT doc_id AS page_id, l || ',' || l || ',' || s AS tags, l || ':o,' || s || ':n' AS claims, TIMESTAMP '2024-03-01' AS updated, 3::BIGINT AS n_changes FROM x_""",
)
def _(spark, d):
    x = S.read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("lang", F.lit("no lang")).alias("l"), F.coalesce("source", F.lit("no source")).alias("s"))
    claim = lambda c, note: F.struct(F.col(c).alias("claim"), F.lit(note).alias("note"))
    at = lambda t: F.lit(t).cast("timestamp_ntz").alias("updated")
    old = x.select("page_id", F.array("l", "l").alias("tags"), F.array(claim("l", "o")).alias("claims"), at("2024-01-01"))
    new = x.select("page_id", F.array("s", "l", "s").alias("tags"), F.array(claim("l", "n"), claim("s", "n"), claim("s", "m")).alias("claims"), at("2024-02-01"))
    out = records.integrate(old, new, as_of="2024-03-01")
    text = F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["claim"], c["note"])), ",")
    return out.select("page_id", F.array_join("tags", ",").alias("tags"), text.alias("claims"), "updated", "n_changes")


@register(
    "integration_rollback",
    """WITH h_ AS (SELECT user_id AS page_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n, user_id % 3 * 2 AS k FROM events),
c_ AS (SELECT *, k BETWEEN 1 AND n AS ok FROM h_)
SELECT 'back' AS part, page_id, seq FROM c_ WHERE ok AND r = greatest(n - k, 1) UNION ALL SELECT 'kept', page_id, seq FROM c_ WHERE NOT ok OR r <= n - k""",
)
def _(spark, d):
    h = S.read(spark, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"))
    back, kept = records.rolled_back(h, h.select("page_id", (F.col("page_id") % 3 * 2).alias("steps")))
    return back.withColumn("part", F.lit("back")).unionByName(kept.withColumn("part", F.lit("kept"))).select("part", "page_id", "seq")


REVIEWS = "i_ AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, ts AS created_at FROM events)"


@register("reviews_changed", f"WITH {REVIEWS} SELECT id, status, created_at + CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS created_at FROM i_ WHERE CAST(id AS BIGINT) % 5 <> 1")
def _(spark, d):
    i = F.col("event_id")
    items = S.read(spark, d, "events").select(i.cast("string").alias("id"), F.when(i % 2 == 0, "pending").otherwise("approved").alias("status"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    number = F.col("id").cast("long")
    later = items.where(number % 4 == 0)
    new = later.unionByName(later.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")))
    return records.review_delete(records.review_put(items, new), items.where(number % 5 == 1).select("id"))


@register("validated_answers", "SELECT doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'a,c' WHEN 1 THEN '' ELSE 'd' END AS names FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    found = '[{"name":"a","confidence":0.5},{"name":" "},{"name":"b","confidence":1.5},{"name":"c"},{"name":"e"}]'
    answers = S.read(spark, d, "documents").select(i.alias("page_id"), F.when(i % 3 == 0, found).when(i % 3 == 1, "no JSON").otherwise('[{"name":"d","confidence":1}]').alias("found"))
    out = records.validated(answers, "found", "name string, confidence double", ("name",), 2)
    return out.select("page_id", F.array_join(F.transform("found", lambda x: x["name"]), ",").alias("names"))


@register("filled_pages", "SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE 'en' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'found' END AS tags FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    p = S.read(spark, d, "documents").select(i.alias("page_id"), F.when(i % 2 == 0, "given").when(i % 4 == 1, " ").alias("kind"), F.when(i % 3 == 0, F.array(F.lit("x"))).when(i % 3 == 1, F.array().cast("array<string>")).alias("tags"))
    out = records.filled(p, {"kind": F.lit("en"), "tags": F.array(F.lit("found"))})
    return out.select("page_id", "kind", F.array_join("tags", ",").alias("tags"))


@register(
    "duplicates_in_domains",
    f"{PAGES},{DUPLICATES} SELECT id_1, id_2, round(score, 9) AS score FROM dup_ JOIN pages_ a ON a.page_id = id_1 JOIN pages_ b ON b.page_id = id_2 WHERE dup_.score >= 0.41 AND a.domain IN ('src1', 'src3') AND b.domain IN ('src1', 'src3')",
)
def _(spark, d):
    return rounded(matching.duplicates(S.pages(spark, d), 0.41, domains=("src1", "src3")).select("id_1", "id_2", "score"), "score")


@register(
    "retried_failures",
    f"""{FAILED_ALL}, due_ AS (SELECT *, CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT) % 3 AS k, failure_count + 1 AS c FROM state_ WHERE NOT permanent AND failure_count < 5 AND next_retry <= TIMESTAMP '{EVENTS_AS_OF}')
SELECT file_path, ['queued', 'failed', 'cleared'][k + 1] AS outcome, CASE WHEN k = 0 THEN 'a ' || file_path END AS markdown, CASE WHEN k = 1 THEN c END AS failure_count,
CASE WHEN k = 1 THEN 'invalid_format' END AS reason, CASE WHEN k = 1 THEN true END AS permanent FROM due_""",
)
def _(spark, d):
    from tessera.streaming import inbox

    state = all_failures(spark, d)
    k = F.regexp_extract("file_path", "[0-9]+", 0).cast("long") % 3
    files = state.select(F.concat(F.lit("failed/"), F.col("file_path"), F.lit(".md")).alias("path"), F.concat(F.lit("a "), "file_path").alias("content"), k.alias("k"))
    files = files.where("k < 2").withColumn("content", F.when(F.col("k") == 1, " ").otherwise(F.col("content"))).drop("k")
    named = state.withColumn("file_path", F.concat("file_path", F.lit(".md")))
    out = inbox.retried(named, files, EVENTS_AS_OF).withColumn("file_path", F.regexp_replace("file_path", r"\.md$", ""))
    return out.select("file_path", "outcome", "markdown", "failure_count", "reason", "permanent")


HEADERS = (
    ("id: p\nkind: page\ntitle: T\ndomain: d\nupdated_at: 2024-01-01", None), ("id: p\nkind: entity\ntitle: T\ndomain: d\nupdated_at: 2024-01-01", "no entity_type"), ("title: T", "no kind"), ("kind: essay", "invalid kind"),
    ("id: p\nkind: page\ntitle: ' '\ndomain: d", "no title"), ("id: p\nkind: page\ntitle: T\ndomain: d", "no updated_at"), ("id: p\nkind: page\ntitle: T\ndomain: d\nupdated_at: 2024-01-01\nstatus: lost", "invalid status"),
    ("id: p\nkind: page\ntitle: T\ndomain: d\nupdated_at: 2024-01-01\nconfidence: 1.5", "invalid confidence"), (None, "no header"),
)


@register(
    "checked_headers",
    f"SELECT [{', '.join('NULL' if e is None else repr(e) for _, e in HEADERS)}][CAST(doc_id % {len(HEADERS)} + 1 AS INT)] AS error, count(*) AS n FROM documents GROUP BY 1",
)
def _(spark, d):
    from tessera.sources import pagefiles

    texts = F.array(*[F.lit("plain" if h is None else f"---\n{h}\n---\nbody") for h, _ in HEADERS])
    i = F.col("doc_id")
    files = S.read(spark, d, "documents").select(F.concat(F.lit("wiki/d/pages/"), i.cast("string"), F.lit(".md")).alias("path"), F.element_at(texts, (i % len(HEADERS) + 1).cast("int")).alias("content"))
    return pagefiles.checked(pagefiles.parsed(files)).groupBy("error").agg(F.count("*").alias("n"))


@register(
    "transcript_files",
    """WITH m_ AS (SELECT conv_id, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, role, count(*) AS n, count(*) FILTER (WHERE trim(text, chr(32)) <> '') AS n_text FROM m_ GROUP BY 1, 2""",
)
def _(spark, d):
    from tessera.sources import pagefiles

    c = S.read(spark, d, "conversations").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    list_ = F.to_json(F.sort_array(F.collect_list("m")))  # one file a conversation, as a tool would write it
    content = F.when(F.col("conv_id") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"messages": '), "l", F.lit("}")))
    path = F.concat(F.lit("session-"), F.col("conv_id").cast("string"), F.lit(".json"))
    files = c.groupBy("conv_id").agg(list_.alias("l")).select(path.alias("path"), content.alias("content"))
    m = pagefiles.transcript_file_messages(files).withColumn("conv_id", F.regexp_extract("path", r"session-(-?\d+)\.json$", 1).cast("long"))
    return m.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("n_text"))


@register("transcript_meta", "SELECT conv_id, count(*) AS n_messages, 's' || min(turn) AS session_id, coalesce('h' || max(turn) FILTER (WHERE turn % 2 = 1), 'unknown') AS capture_hook FROM conversations GROUP BY 1")
def _(spark, d):
    from tessera.sources import pagefiles

    t = F.col("turn").cast("string")
    hook = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("h"), t))
    value = F.to_json(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"), F.concat(F.lit("s"), t).alias("session_id"), hook.alias("_capture_hook")))
    lines = S.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), value.alias("value"))
    m = pagefiles.transcript_meta(pagefiles.transcript_messages(lines))
    return m.withColumn("conv_id", F.col("path").cast("long")).drop("path")


@register("promotion_suggested", f"{PROMOTION} SELECT page_id, CASE WHEN t_.score >= 5 THEN 'suggest' ELSE 'none' END AS decision FROM t_")
def _(spark, d):
    refs = references(spark, d)
    return governance.promotion(refs, S.pages(spark, d), AS_OF, require_approval=True).select("page_id", "decision")
