"""Registered queries over operators that the other modules do not exercise, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import export, governance, graph, links, matching, records
from tessera.plans.extended import NOTES, _notes
from tessera.plans.registry import CHANGES, EDGES, ERRORS, PAGES, QUALITY, register, rounded
from tessera.sources import pagefiles
from tessera.sources import tables as S

# page files -----------------------------------------------------------------------------------------------------------


def _files(spark, d):
    """A page file of each document: one in seven has no header, one in eleven a header that can't be read, one in three is
    in Latin-1."""
    i = F.col("doc_id")
    head = F.concat(F.lit("---\nid: p"), i.cast("string"), F.lit("\ntitle: Page "), i.cast("string"), F.lit("\nkind: entity\nconfidence: 0."), (i % 10).cast("string"), F.lit("\ntags:\n- "), F.coalesce("lang", F.lit("none")), F.lit("\n- x\n---\n"))
    bad = F.lit("---\ntitle: [1\nx\n---\n")
    whole = F.concat(F.when(i % 7 == 0, "").when(i % 11 == 0, bad).otherwise(head), F.coalesce("text", F.lit("")))
    latin = (i % 3 == 0) & whole.rlike(r"^[\x00-\xff]*$")
    data = F.when(latin, F.encode(F.when(latin, whole).otherwise(""), "ISO-8859-1")).otherwise(F.encode(whole, "UTF-8"))
    path = F.concat(F.lit("wiki/"), F.coalesce("source", F.lit("none")), F.lit("/pages/f"), i.cast("string"), F.lit(".md"))
    return S.documents(spark, d).select(path.alias("path"), pagefiles.decoded(data).alias("content"))


FILES = """f_ AS (SELECT doc_id, doc_id % 7 = 0 AS plain, doc_id % 7 <> 0 AND doc_id % 11 = 0 AS bad, coalesce(source, 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(text, '') AS body FROM documents)"""


@register(
    "page_files",
    f"""WITH {FILES} SELECT CASE WHEN plain OR bad THEN 'f' ELSE 'p' END || doc_id AS page_id, domain, CASE WHEN plain OR bad THEN NULL ELSE 'Page ' || doc_id END AS title, CASE WHEN plain OR bad THEN 'page' ELSE 'entity' END AS kind,
CASE WHEN plain OR bad THEN '' ELSE lang || ',x' END AS tags, CASE WHEN plain OR bad THEN NULL ELSE (doc_id % 10) / 10.0 END::DOUBLE AS confidence, body, bad FROM f_""",
)
def _(spark, d):
    p = pagefiles.pages(pagefiles.parsed(_files(spark, d)))
    return p.select("page_id", "domain", "title", "kind", F.array_join("tags", ",").alias("tags"), "confidence", "body", F.col("_parse_error").isNotNull().alias("bad"))


@register("page_headers", f"WITH {FILES} SELECT 'f' || doc_id AS file, NOT plain AS has_header, CASE WHEN plain THEN '' WHEN bad THEN 'title: [1' || chr(10) || 'x' ELSE 'id: p' || doc_id || chr(10) || 'title: Page ' || doc_id || chr(10) || 'kind: entity' || chr(10) || 'confidence: 0.' || (doc_id % 10) || chr(10) || 'tags:' || chr(10) || '- ' || lang || chr(10) || '- x' END AS header FROM f_")
def _(spark, d):
    c = F.col("content")
    return _files(spark, d).select(F.regexp_extract("path", r"/(f-?\d+)\.md$", 1).alias("file"), pagefiles.has_header(c).alias("has_header"), F.rtrim(pagefiles.header(c), F.lit("\n")).alias("header"))


@register("lint_parse_errors", f"WITH {FILES} SELECT 'f' || doc_id AS page_id, 'parse_error' AS rule, 'error' AS severity FROM f_ WHERE bad")
def _(spark, d):
    return governance.lint(pagefiles.pages(pagefiles.parsed(_files(spark, d)))).where("rule = 'parse_error'").select("page_id", "rule", "severity")


KINDS = "CASE WHEN doc_id % 4 = 0 THEN 'session' WHEN doc_id % 4 = 1 AND vault THEN 'vault' WHEN doc_id % 4 = 1 THEN 'markdown' WHEN doc_id % 4 = 2 THEN 'text' END"


@register(
    "adapted_files",
    rf"""WITH f_ AS (SELECT doc_id, coalesce(text, '') AS c, regexp_matches(coalesce(text, ''), '\[\[[^\]|]+(\|[^\]]+)?\]\]|#[a-zA-Z0-9_\-]+') AS vault FROM documents),
t_ AS (SELECT *, {KINDS} AS adapter, trim(split_part(c, chr(10), 1), ' ') AS line FROM f_)
SELECT doc_id, adapter, CASE WHEN adapter = 'text' AND line <> '' AND length(line) < 100 AND line[-1] <> '.' THEN line END AS text_title FROM t_""",
)
def _(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("new/session-"), i.cast("string"), F.lit(".JSONL"))).when(i % 4 == 1, F.concat(F.lit("new/"), i.cast("string"), F.lit(".md"))).when(i % 4 == 2, F.concat(F.lit("new/"), i.cast("string"), F.lit(".txt"))).otherwise(F.lit("new/x.bin"))
    rows = S.documents(spark, d).select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    kind = pagefiles.adapter(F.col("path"), F.col("content"))
    return rows.select("doc_id", kind.alias("adapter"), F.when(kind == "text", pagefiles.text_title(F.col("content"))).alias("text_title"))


@register(
    "messages_flattened",
    """SELECT conv_id, turn, coalesce(role, '') AS role, CASE WHEN turn % 3 = 0 THEN trim(coalesce(text, ''), ' ') WHEN trim(coalesce(text, ''), ' ') = '' THEN '_[tool use: ls]_' || chr(10) || chr(10) || '_[tool result]_' ELSE trim(text, ' ') || chr(10) || chr(10) || '_[tool use: ls]_' || chr(10) || chr(10) || '_[tool result]_' END AS text FROM conversations""",
)
def _(spark, d):
    t, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), f.get("text", F.lit(None).cast("string")).alias("text"), f.get("name", F.lit(None).cast("string")).alias("name"))
    whole = F.to_json(F.struct(role.alias("role"), t.alias("content")))
    parts = F.to_json(F.struct(role.alias("role"), F.array(block("text", text=t), block("tool_use", name=F.lit("ls")), block("tool_result")).alias("content")))
    lines = S.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 3 == 0, whole).otherwise(parts).alias("value"))
    m = pagefiles.transcript_messages(lines)
    return m.select(F.col("path").cast("long").alias("conv_id"), "turn", "role", "text")


# claims ---------------------------------------------------------------------------------------------------------------
# Beyond ASCII the two engines draw word borders differently, so other letters are read as x on both sides
NEGATED = r"\bno(t|w)?\b|\bdon't\b|\bdoesn't\b|\bdidnt'\b|\bwill not\b|\bcannot\b|\bcan't\b|\bwillnot\b"
TIMED = r"\b(before|after|during|earlier|later|previously|formerly|then|now|originally|subsequently)\b"
ASCII_CLAIMS = "WITH " + S.CLAIMS_SQL + r", a_ AS (SELECT page_id, claim_no, confidence, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS t FROM claims_)"


def _ascii(spark, d):
    return S.claims(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))


@register(
    "claim_marks",
    rf"""{ASCII_CLAIMS} SELECT page_id, claim_no, regexp_matches(lower(t), '{NEGATED.replace("'", "''")}') AS negated, trim(regexp_replace(trim(lower(t), ' '), '{NEGATED.replace("'", "''")}', '', 'g'), ' ') AS plain,
regexp_matches(lower(t), '{TIMED}') AS timed, regexp_replace(lower(t), '{TIMED}', '', 'g') AS timeless, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS severity FROM a_""",
)
def _(spark, d):
    t = F.col("text")
    return _ascii(spark, d).select("page_id", "claim_no", T.negated(t).alias("negated"), T.without_negation(t).alias("plain"), T.temporal(t).alias("timed"), T.without_temporal(t).alias("timeless"), T.severity(F.col("confidence")).alias("severity"))


@register(
    "contradiction_bands",
    f"""WITH {S.CLAIMS_SQL}, n_ AS (SELECT page_id, claim_no, regexp_replace(text, '\\d+', 'NUM', 'g') AS masked, list_transform(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b'), lambda x: x::DOUBLE) AS nums FROM claims_ WHERE regexp_matches(text, '\\b\\d'))
SELECT 'numerical' AS kind, 'high' AS band, count(*) AS n FROM n_ a JOIN n_ b ON a.masked = b.masked AND a.page_id < b.page_id WHERE list_min(flatten(list_transform(a.nums, lambda x: list_transform(b.nums, lambda y: abs(x - y))))) > 0 HAVING count(*) > 0""",
)
def _(spark, d):
    return matching.contradiction_report(matching.numeric_contradictions(S.claims(spark, d)))


# graph ----------------------------------------------------------------------------------------------------------------
@register("edges_without_page", f"{EDGES} SELECT source, target, type FROM edges_ WHERE source <> (SELECT min(source) FROM edges_)")
def _(spark, d):
    e = S.edges(spark, d)
    return graph.remove_page(e, e.agg(F.min("source")).first()[0]).select("source", "target", "type")


@register("page_edges_replaced", f"{EDGES}, l_ AS (SELECT source, target, 'links' AS type FROM edges_), n_ AS (SELECT DISTINCT source, 'z' AS target FROM edges_ WHERE type = 'in_nation') SELECT source, target, type FROM l_ WHERE source NOT IN (SELECT source FROM n_) UNION ALL SELECT source, target, 'links' FROM n_")
def _(spark, d):
    e = S.edges(spark, d).withColumn("type", F.lit("links"))
    new = S.edges(spark, d).where("type = 'in_nation'").select("source", F.lit("z").alias("target"))
    return graph.replace_links(e, new).select("source", "target", "type")


@register("edges_both_ways", f"{EDGES} SELECT source, target, type FROM edges_ UNION SELECT target, source, type FROM edges_ WHERE type = 'in_region'")
def _(spark, d):
    e = S.edges(spark, d).withColumns({"seq": F.lit(1), "bidirectional": F.col("type") == "in_region"})
    return graph.upserted(e).select("source", "target", "type").distinct()


# records and reports --------------------------------------------------------------------------------------------------
IDENT = "substring(sha1(page_id || '::' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '::' || seq), 1, 16)"


@register("change_entry", f"{CHANGES}, i_ AS (SELECT *, {IDENT} AS change_id FROM changes_) SELECT page_id, seq, change_id, actor FROM i_ WHERE change_id = (SELECT min(change_id) FROM i_)")
def _(spark, d):
    c = records.with_parents(S.changes(spark, d))
    return records.entry(c, c.agg(F.min("change_id")).first()[0]).select("page_id", "seq", "change_id", "actor")


@register("auto_merges", "SELECT doc_id AS id_1, round((doc_id % 100) / 100.0, 9)::DOUBLE AS score FROM documents WHERE doc_id % 100 >= 90")
def _(spark, d):
    i = F.col("doc_id")
    score = (i % 100) / 100.0
    pairs = S.read(spark, d, "documents").select(i.alias("id_1"), score.alias("score"), F.when(score > 0.8, "high").when(score >= 0.5, "medium").otherwise("low").alias("band"))
    return rounded(matching.auto_merges(pairs).select("id_1", "score"), "score")


@register("routing_totals", "SELECT count(*) AS n_pages, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_mistakes, count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 10 >= 7) AS high, count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 10 BETWEEN 4 AND 6) AS medium, count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 10 < 4) AS low FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    docs = S.read(spark, d, "documents").select("doc_id")
    return governance.routing_report(docs.where(i % 2 == 0).select((i % 10 / 10).alias("score")), docs)


@register("templates_rendered", f"{PAGES} SELECT page_id, 'Page ' || title || ' in ' || domain || ' (' || title || ')' AS text FROM pages_")
def _(spark, d):
    body = export.template(F.lit("Page TITLE in DOMAIN (TITLE)"), {"TITLE": F.col("title"), "DOMAIN": F.col("domain")})
    return S.pages(spark, d).where(~F.contains("title", F.lit("DOMAIN"))).select("page_id", body.alias("text"))


@register(
    "quality_report",
    f"""{PAGES},{QUALITY}, b_ AS (SELECT page_id, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS section FROM quality_),
r_ AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY round(score, 9) DESC, page_id) AS r FROM b_) SELECT section, string_agg('- ' || page_id, chr(10) ORDER BY r) AS text FROM r_ WHERE r <= 10 GROUP BY 1""",
)
def _(spark, d):
    q = governance.quality(S.pages(spark, d))
    band = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    rows = q.select("page_id", "score", band.alias("band"))
    return export.report(rows, "band", F.concat(F.lit("- "), F.col("page_id").cast("string")), F.struct(-F.round("score", 9), F.col("page_id")), 10)


@register("question_pages", "SELECT doc_id || '-qa-' || n AS page_id, 'qa' AS kind, 'q' || n AS title, coalesce(source, 'none') AS domain, 'draft' AS status, '## Question' || chr(10) || chr(10) || 'q' || n || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || '[[' || doc_id || ']]' || chr(10) AS body FROM documents, range(1, 3) t(n)")
def _(spark, d):
    pairs = S.read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("source", F.lit("none")).alias("domain"), F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("question"), F.lit("a").alias("answer"))
    return records.qa_pages(pairs).select("page_id", "kind", "title", "domain", "status", "body")


@register("names_normalized", rf"{PAGES} SELECT page_id, array_to_string(list_filter(regexp_split_to_array(trim(lower(title), ' '), '\s+'), lambda w: w NOT IN ('the', 'a', 'an', '')), ' ') AS name FROM pages_")
def _(spark, d):
    return S.pages(spark, d).select("page_id", T.normal_name(F.col("title")).alias("name"))


@register("duplicates_by_tags", f"{PAGES}, t_ AS (SELECT page_id, title, list_distinct(list_concat(tags, [kind])) AS tags FROM pages_ WHERE kind <> 'source'), n_ AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(trim(lower(title), ' '), '\\s+'), lambda w: w NOT IN ('the', 'a', 'an', '')), ' ') AS name FROM t_) SELECT a.page_id AS id_1, b.page_id AS id_2, 0.5::DOUBLE AS score FROM n_ a JOIN n_ b ON a.name = b.name AND a.name <> '' AND a.page_id < b.page_id WHERE len(list_intersect(a.tags, b.tags)) >= 3")
def _(spark, d):
    pages = S.pages(spark, d).withColumns({"tags": F.array_union("tags", F.array("kind")), "body": F.lit("")})
    return rounded(matching.duplicates(pages, 0.45).select("id_1", "id_2", "score"), "score")


@register("tags_merged", f"{PAGES} SELECT a.page_id, array_to_string(list_sort(list_distinct(list_concat(a.tags, b.tags))), ',') AS tags, rtrim(a.title, ' ') || chr(10) || chr(10) || '## Content from ' || b.title || chr(10) || chr(10) || trim(b.title, ' ') AS body FROM pages_ a JOIN pages_ b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0")
def _(spark, d):
    i = F.col("page_id")
    p = S.pages(spark, d).withColumn("body", F.col("title"))
    return matching.merged(p.where(i % 2 == 0).withColumn("pair", i), p.where(i % 2 != 0).withColumn("pair", i - 1)).select("page_id", "tags", "body").withColumn("tags", F.array_join("tags", ","))


@register("cron_runs", "SELECT event_id FROM events WHERE minute(ts) % 30 = 0 AND hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def _(spark, d):
    return records.cron_matches(S.read(spark, d, "events"), "ts", "*/30 9-17 * * mon-fri").select("event_id")


@register("failure_classes", "SELECT event_id, ['llm_timeout', 'network_error', 'temporary_error', 'invalid_format', 'corrupted_file', 'missing_metadata', 'schema_validation_failed', 'unknown'][CAST(event_id % 8 + 1 AS INT)] AS reason FROM events")
def _(spark, d):
    error = F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % 8 + 1).cast("int"))
    return S.read(spark, d, "events").select("event_id", T.failure_reason(error).alias("reason"))


@register("backoff_schedule", "SELECT event_id, [300, 1800, 7200, 21600, 86400][CAST(least(greatest(event_id % 7, 1), 5) AS INT)] AS by_table, CAST(least(60.0, pow(2.0, event_id % 8)) AS DOUBLE) AS exponential FROM events")
def _(spark, d):
    i = F.col("event_id")
    return S.read(spark, d, "events").select("event_id", T.retry_seconds(i % 7).alias("by_table"), T.exponential_seconds(i % 8).alias("exponential"))


@register("backoff_jitter", "SELECT event_id, round(CAST(least(60.0, pow(2.0, event_id % 8)) * (1 + event_id % 16 / 32.0) AS DOUBLE), 9) AS seconds FROM events")
def _(spark, d):
    i = F.col("event_id")
    return rounded(S.read(spark, d, "events").select("event_id", T.exponential_seconds(i % 8, jitter=i % 16 / 16.0).alias("seconds")), "seconds")


# Spellings that edges of a type are given by the number at the end of their source
KINDS = [(" Uses ", "uses"), ("us", "uses"), ("", "uses"), ("depends on", "depends_on"), ("Used by", "uses"), ("zzz", "zzz"), ("PART_OF", "part_of"), ("partner", "part_of")]
KINDS_SQL = "[" + ", ".join(f"'{k}'" for k, _ in KINDS) + "]"
NORMAL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in KINDS) + " ELSE type END"


@register(
    "relationship_types",
    f"{EDGES}, k_ AS (SELECT type, upper(replace(type, '_', ' ')) AS kind FROM edges_ UNION ALL SELECT type, {KINDS_SQL}[CAST(CAST(substring(source, 2) AS BIGINT) % 8 + 1 AS INT)] FROM edges_) SELECT type, kind, {NORMAL_SQL} AS normal, count(*) AS n FROM k_ GROUP BY 1, 2, 3",
)
def _(spark, d):
    e = S.edges(spark, d)
    spelt = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS]), (F.substring("source", 2, 20).cast("long") % 8 + 1).cast("int"))
    e = e.select("type", F.explode(F.array(F.upper(F.replace("type", F.lit("_"), F.lit(" "))), spelt)).alias("kind"))
    return e.groupBy("type", "kind").agg(F.count("*").alias("n")).select("type", "kind", graph.normal_type(F.col("kind")).alias("normal"), "n")


@register("review_get", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def _(spark, d):
    i = F.col("event_id")
    items = S.read(spark, d, "events").select(i.cast("string").alias("id"), F.when(i % 2 == 0, "pending").otherwise("approved").alias("status"))
    return records.review_get(items, str(S.read(spark, d, "events").agg(F.max("event_id")).first()[0])).select("id", "status")


@register("broken_by_page", f"{NOTES} SELECT CAST(page_id AS VARCHAR) AS src, count(DISTINCT x) AS n FROM (SELECT page_id, unnest(regexp_extract_all(body, '\\[\\[([^|\\]]+)(?:\\|[^\\]]+)?\\]\\]', 1)) AS x FROM notes_) GROUP BY 1")
def _(spark, d):
    notes = _notes(spark, d)
    found = links.broken(links.extract(notes), notes.select(F.col("page_id").cast("string").alias("page_id")))
    return found.groupBy("src").agg(F.count("*").alias("n"))
