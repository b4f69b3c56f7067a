"""Quality, staleness, lint and routing of pages, as column expressions over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T

SHORT, GOOD = 100, 500
WEIGHTS = {"summary": 0.15, "tags": 0.1, "kind": 0.1, "source": 0.15}


def _present(field: str, is_list: bool) -> Column:
    c = F.col(field)
    return F.coalesce(F.size(c) > 0, F.lit(False)) if is_list else F.coalesce(F.trim(c) != "", F.lit(False))


def quality(pages: DataFrame) -> DataFrame:
    """page_id, score, issues: 0.3 metadata + 0.4 content + 0.2 citation + 0.1 recency, within 0 and 1."""
    body = F.coalesce("body", F.lit(""))
    n = F.char_length(F.trim(body))
    metadata, missing = F.lit(0.5), []
    for field, weight in WEIGHTS.items():
        has = _present(field, field == "tags")
        metadata = metadata + F.when(has, weight).otherwise(0.0)
        null = F.col(field).isNull() | (F.lit(False) if field == "tags" else F.col(field) == "")
        missing.append(F.when(~has, F.when(null | (F.size("tags") == 0 if field == "tags" else F.lit(False)), f"Missing {field}").otherwise(f"Empty {field}")))
    headings, lists = body.contains("#"), body.contains("-") | body.contains("*") | body.contains("1.")
    length = F.when(n < SHORT, 0.2).when(n < GOOD, 0.5 + n / F.lit(float(GOOD)) * 0.3).otherwise(0.8)
    content = F.least(length + (F.when(headings, 0.1).otherwise(0.0) + F.when(lists, 0.1).otherwise(0.0)), F.lit(1.0))
    cited = F.when(F.col("source").isNotNull(), 1.0).otherwise(0.0)
    recent = F.when(F.col("updated").isNull(), 0.0).when(F.col("created") == F.col("updated"), 0.3).otherwise(1.0)
    score = T.clamp(0.3 * F.least(metadata, F.lit(1.0)) + 0.4 * content + 0.2 * cited + 0.1 * recent)
    issues = F.array_compact(
        F.array(*missing, F.when(n < SHORT, F.concat(F.lit("Very short content ("), n.cast("string"), F.lit(" chars)"))), F.when(~headings, "No headings"), F.when(~lists, "No lists or bullet points"))
    )
    return pages.select("page_id", score.alias("score"), issues.alias("issues"))


def low_quality(pages: DataFrame, most: float = 0.6) -> DataFrame:
    return quality(pages).where(F.col("score") <= most).orderBy("score", "page_id")


def staleness(pages: DataFrame, as_of: str) -> DataFrame:
    """page_id, score, age: by age of the update (else creation), unchanged pages, time-bound words, many links out."""
    at = F.lit(as_of).cast("timestamp_ntz")
    day = F.coalesce("updated", "created")
    age = F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", day, at) / 86400)).cast("int")
    body = F.coalesce("body", F.lit(""))
    by_age = F.when(age > 180, 0.6).when(age > 90, 0.4).when(age > 30, 0.2).otherwise(0.0)
    score = by_age + F.when(F.col("created") == F.col("updated"), 0.3).otherwise(0.0) + F.when(T.time_sensitive(body), 0.3).otherwise(0.0) + F.when(T.url_count(body) > 5, 0.2).otherwise(0.0)
    return pages.select("page_id", F.least(score, F.lit(1.0)).alias("score"), age.alias("age_days"))


def stale(pages: DataFrame, as_of: str, least: float = 0.3) -> DataFrame:
    """The stale ones, stalest first. Written before they are sorted: a sort reads its rows twice, to find ranges."""
    return scratch.written(staleness(pages, as_of).where(F.col("score") >= least), "stale")[0].orderBy(F.desc("score"), "page_id")


LINT_KINDS = ("page", "entity", "concept", "source")


def lint(pages: DataFrame, most_tags: int = 10) -> DataFrame:
    """page_id, rule, field, severity: all rules in one scan. A `_parse_error` column, where there is one, stops the others."""

    def issue(rule, field, severity, when):
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rules = [issue("missing_required_field", f, "error", blank(f)) for f in ("page_id", "title", "domain")]
    rules += [
        issue("invalid_kind", "kind", "error", ~F.coalesce("kind", F.lit("page")).isin(*LINT_KINDS)),
        issue("too_many_tags", "tags", "warning", F.size("tags") > most_tags),
        issue("missing_summary", "summary", "info", blank("summary")),
        issue("missing_source", "source", "warning", F.col("kind").isin("entity", "concept") & F.col("source").isNull()),
    ]
    if "_parse_error" in pages.columns:
        bad = F.col("_parse_error").isNotNull()
        rules = [issue("parse_error", "", "error", bad)] + [F.when(~bad, r) for r in rules]
    return pages.select("page_id", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("page_id", "x.*")


def lint_types(raw: DataFrame) -> DataFrame:
    """raw: page_id and `meta`, the header as a VARIANT. Fields of the wrong type, by the type that they were written in."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get("meta", f"$.{f}", "variant"))

    def issue(f, ok):
        k = kind(f)
        return F.when(k.isNotNull() & (k != "VOID") & ~ok(k), F.struct(F.lit("invalid_field_type").alias("rule"), F.lit(f).alias("field"), F.lit("error").alias("severity")))

    rules = [issue(f, lambda k: k == "STRING") for f in ("id", "title", "domain", "kind", "summary", "source")]
    rules += [issue(f, lambda k: k.startswith("ARRAY")) for f in ("tags", "entities", "concepts")]
    tags = kind("tags")
    rules.append(F.when(tags.isNotNull() & (tags != "VOID") & ~tags.startswith("ARRAY"), F.struct(F.lit("invalid_tags_type").alias("rule"), F.lit("tags").alias("field"), F.lit("error").alias("severity"))))
    return raw.select("page_id", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("page_id", "x.*")


def lint_by_page(issues: DataFrame) -> DataFrame:
    return issues.groupBy("page_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.array_join(F.sort_array(F.collect_list("rule")), ",").alias("rules"))


def band(score: Column, high: float, medium: float, strict: bool = False) -> Column:
    return F.when(score > high if strict else score >= high, "high").when(score >= medium, "medium").otherwise("low")


def routing_mistakes(pages: DataFrame, keywords: DataFrame, links: DataFrame | None = None, least: float = 0.4) -> DataFrame:
    """page_id, domain, suggested, score. Signals for each foreign domain: 0.9 when the header names it (column
    `stated_domain`, where there is one); 0.5 * share of tags among its keywords; 0.4 * share of resolved links into it,
    from two resolved links and a share of 0.6 on; repeated links count each (links: src, dst). keywords: domain, keyword, a small table. Ties go to the first name."""
    own = pages.select("page_id", "domain")
    signals = []
    if "stated_domain" in pages.columns:
        signals.append(pages.where("stated_domain is not null and stated_domain != domain").select("page_id", F.col("stated_domain").alias("suggested"), F.lit(0.9).alias("part")))
    named = F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    tags = pages.select("page_id", "domain", F.explode(named).alias("keyword"), F.size(named).alias("n"))
    hit = tags.join(keywords.withColumnRenamed("domain", "suggested"), "keyword").where("suggested != domain")
    signals.append(hit.groupBy("page_id", "suggested").agg((0.5 * F.count("*") / F.first("n")).alias("part")))
    if links is not None:
        to = links.select(F.col("src").alias("page_id"), F.trim("dst").alias("dst")).join(own.select(F.col("page_id").alias("dst"), F.col("domain").alias("suggested")), "dst")
        total = to.groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 2")
        share = to.groupBy("page_id", "suggested").agg(F.count("*").alias("k")).join(total, "page_id").withColumn("r", F.col("k") / F.col("n"))
        signals.append(share.join(own, "page_id").where("suggested != domain and r >= 0.6").select("page_id", "suggested", (0.4 * F.col("r")).alias("part")))
    parts = signals[0]
    for s in signals[1:]:
        parts = parts.unionByName(s)
    scored = parts.groupBy("page_id", "suggested").agg(F.least(F.lit(1.0), F.sum("part")).alias("score"))
    best = scored.groupBy("page_id").agg(F.min_by(F.struct("suggested", "score"), F.struct(-F.col("score"), "suggested")).alias("x")).select("page_id", "x.*")
    return best.where(F.col("score") >= least).join(own, "page_id").select("page_id", "domain", "suggested", "score")


def route(sources: DataFrame, domains: list[str], rules: list[tuple[str, str]], fallback: str) -> DataFrame:
    """sources: source_path and stated_domain. A valid stated domain, else the first rule whose text the path holds, else
    the fallback."""
    out = F.when(F.col("stated_domain").isin(*domains), F.col("stated_domain"))
    for match, domain in rules:
        out = out.when(F.contains(F.coalesce("source_path", F.lit("")), F.lit(match)), domain)
    return sources.withColumn("domain", out.otherwise(fallback))


def promotion(links: DataFrame, pages: DataFrame, as_of: str, min_quality: float = 0.6, min_cross: int = 2, require_approval: bool = False) -> DataFrame:
    """page_id, cross, total, quality, score, decision: 2 * references from other domains + 0.5 * all references +
    quality + 0.3 * age factor. pages: as for quality(); links: src, dst page ids. With require_approval nothing is
    promoted by itself: what would be is suggested."""
    p = pages.select("page_id", "domain", "created")
    refs = links.select(F.col("src").alias("ref"), F.col("dst").alias("page_id")).distinct().where("ref != page_id")
    of = refs.join(p, "page_id").join(p.select(F.col("page_id").alias("ref"), F.col("domain").alias("ref_domain")), "ref")
    counts = of.groupBy("page_id").agg(F.count_if(F.col("domain") != F.col("ref_domain")).alias("cross"), F.count("*").alias("total")).where(F.col("cross") >= min_cross)
    q = quality(pages).select("page_id", F.col("score").alias("quality")).where(F.col("quality") >= min_quality)
    age = F.floor(F.timestamp_diff("SECOND", F.col("created"), F.lit(as_of).cast("timestamp_ntz")) / 86400)
    score = 2.0 * F.col("cross") + 0.5 * F.col("total") + F.col("quality") + 0.3 * T.age_factor(age)
    return (
        counts.join(q, "page_id")
        .join(p, "page_id")
        .withColumn("score", score)
        .select("page_id", "cross", "total", "quality", "score", F.when(F.lit(not require_approval) & (F.col("score") >= 10), "auto").when(F.col("score") >= 5, "suggest").otherwise("none").alias("decision"))
        .orderBy(F.desc("score"), "page_id")
    )


def low_quality_reviews(pages: DataFrame, as_of: str, below: float = 0.4, urgent: float = 0.2) -> DataFrame:
    """pages: page_id, quality_score (null: 1.0) -> review items of those below `below`; high priority below `urgent`."""
    q = F.coalesce("quality_score", F.lit(1.0))
    return pages.where(q < below).select(F.col("page_id").cast("string").alias("target_id"), F.lit("quality").alias("type"), F.when(q < urgent, "high").otherwise("medium").alias("priority"), F.lit("pending").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def routing_report(mistakes: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: n_pages, n_mistakes, and mistakes by band (0.7 and 0.4)."""
    b = band(F.col("score"), 0.7, 0.4)
    found = mistakes.agg(F.count("*").alias("n_mistakes"), *[F.count_if(b == x).alias(x) for x in ("high", "medium", "low")])
    return pages.agg(F.count("*").alias("n_pages")).join(F.broadcast(found), F.lit(True))  # one row each
