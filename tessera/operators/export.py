"""Text, JSON, graph and sitemap renderings. One row per page or domain; writers are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


def _comment(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<!-- {name}: "), value, F.lit(" -->"))


def llms_page() -> Column:
    """The llms.txt text of a page row: title, comments of the fields that it has, summary quote, body."""
    some = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce("title", F.col("page_id").cast("string"))),
        F.lit(""),
        _comment("id", F.col("page_id").cast("string")),
        _comment("domain", F.col("domain")),
        _comment("kind", F.col("kind")),
        F.when(some, _comment("tags", F.array_join("tags", ", "))),
        F.lit(""),
        F.when(F.col("summary") != "", F.concat(F.lit("> "), F.col("summary"), F.lit("\n"))),
        F.trim(F.coalesce("body", F.lit(""))),
        F.lit(""),
    )


def llms_txt(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "domain", llms_page().alias("content"))


RANGE, MOST_RANGES = 5000, 1000


def _numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """n: from 1, the place of a row in its group by `order`. Ranges of (by, order) of about RANGE rows are numbered, then
    moved by the rows of earlier ranges of the group, so that a large group is many tasks. Bounds are taken from a sample,
    by hash, of the keys."""
    key = F.struct(F.col(by).alias("a"), F.col(order).alias("b"))
    ranges = min(MOST_RANGES, rows.count() // RANGE + 1)
    some = rows.select(by, order).distinct().orderBy(F.xxhash64(by, order), by, order).limit(20 * ranges) if ranges > 1 else rows.limit(0)
    bounds = [(r[by], r[order]) for r in some.orderBy(key).select(by, order).collect()][20::20]
    below = F.lit(0)
    if bounds:
        kinds = [rows.schema[c].dataType.simpleString() for c in (by, order)]
        at = [F.struct(F.lit(x).cast(kinds[0]).alias("a"), F.lit(y).cast(kinds[1]).alias("b")) for x, y in bounds]
        below = F.size(F.filter(F.array(*at), lambda x: x <= key))
    x = rows.withColumn("__range", below)
    counts = x.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(W.partitionBy("__by").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("__by", "__r", F.coalesce(earlier, F.lit(0)).alias("__before"))  # a row per group and range
    x = x.withColumn("__place", F.row_number().over(W.partitionBy(by, "__range").orderBy(order)))
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__r"))
    few = before.count() <= 100 * MOST_RANGES  # a row per group and range
    return x.join(F.broadcast(before) if few else before, same).withColumn("n", F.col("__place") + F.col("__before")).select(*rows.columns, "n")


def llms_domains(pages: DataFrame, per_part: int = 1000) -> DataFrame:
    """domain, part, content: pages by id with separators. A part holds at most per_part pages, so a large domain is many
    rows, which follow one another by part."""
    numbered = _numbered(llms_txt(pages), "domain", "page_id")
    parts = numbered.groupBy("domain", F.floor((F.col("n") - 1) / per_part).alias("part"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n---\n\n").alias("content"))


def llms_all(pages: DataFrame, per_part: int | None = 1000) -> DataFrame:
    """domain, part, content of all domains in one file: each domain begins with a heading, each page ends with a separator.
    Rows in order of domain and part follow one another as they are; parts hold at most per_part pages. None: a domain is
    one part, put together of parts, so it must fit one row."""
    parts = llms_domains(pages, 1000 if per_part is None else per_part)
    if per_part is None:
        texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "content"))), lambda x: x["content"])  # a row a part
        parts = parts.groupBy("domain").agg(F.lit(0).cast("long").alias("part"), F.array_join(texts, "\n---\n\n").alias("content"))
    last = F.col("part") == F.max("part").over(W.partitionBy("domain"))  # a row a part
    head = F.when(F.col("part") == 0, F.concat(F.lit("# Domain: "), F.coalesce("domain", F.lit("")), F.lit("\n\n"))).otherwise("")
    return parts.select("domain", "part", F.concat(head, "content", F.lit("\n---\n\n"), F.when(last, "\n\n").otherwise("")).alias("content"))


def llms_full(pages: DataFrame, min_quality: float | None = None, since: str | None = None, max_pages: int | None = None, backlinks: DataFrame | None = None) -> DataFrame:
    """Filtered full export: page_id, domain, content, with confidence and links sections. max_pages counts over domains in
    order of domain and id."""
    out = pages
    if min_quality is not None:
        out = out.where(F.coalesce("confidence", F.lit(0.0)) >= min_quality)
    if since is not None:
        day = F.coalesce("updated", "created")
        out = out.where(day.isNull() | (day >= F.lit(since).cast("timestamp_ntz")))
    if max_pages is not None:
        out = out.orderBy("domain", "page_id").limit(max_pages)
    if backlinks is not None:
        out = out.join(backlinks, "page_id", "left")
    else:
        out = out.withColumn("sources", F.lit(None).cast("array<string>"))
    share = F.concat(F.lit("Confidence: "), F.format_string("%.0f", F.round(F.col("confidence") * 100, 0)), F.lit("%"))
    linked = F.when(F.size("sources") > 0, F.concat(F.lit("\n## Backlinks\n\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\n")))
    return out.select("page_id", "domain", F.concat_ws("\n", llms_page(), share, linked).alias("content"))


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))


def llms_full_sections(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """page_id, domain, content with sections of what was extracted. extracted: page_id and arrays entities, concepts (names),
    claims (texts) and relationships (structs of source, type, target); pages without any have no sections."""
    e = extracted.select("page_id", "entities", "concepts", "claims", F.transform("relationships", lambda r: F.concat_ws(" ", r["source"], r["type"], r["target"])).alias("relationships"))
    out = pages.join(e, "page_id", "left")
    parts = [_section(name.title(), F.col(name)) for name in ("entities", "concepts", "claims", "relationships")]
    return out.select("page_id", "domain", F.concat_ws("\n", llms_page(), *parts).alias("content"))


#: What extraction leaves of a page, as its side files hold it.
EXTRACTION = (
    "entities array<struct<name:string,entity_type:string,description:string,aliases:array<string>,confidence:double,context:string>>, "
    "concepts array<struct<name:string,definition:string,category:string,related_concepts:array<string>,confidence:double,examples:array<string>>>, "
    "claims array<struct<claim:string,confidence:double,subject:string,predicate:string,object:string,temporal_context:string,qualifiers:array<string>>>, "
    "relationships array<struct<source_entity:string,relationship_type:string,target_entity:string,confidence:double,bidirectional:boolean,description:string>>"
)


def side_files(files: DataFrame) -> DataFrame:
    """files: path, content of `{id}_extraction.json` -> page_id and the arrays of EXTRACTION. Files that are no such JSON
    are left out."""
    name = F.regexp_extract("path", r"([^/]+)_extraction\.json$", 1)
    held = files.where(name != "").select(name.alias("page_id"), F.from_json("content", EXTRACTION, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("content").alias("v"))
    return held.where(F.schema_of_variant("v").startswith("OBJECT")).select("page_id", "x.*")


def _some(name: str, value: Column) -> Column:
    """`- name: value`, if there is a value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), value))


def _listed(values: Column, mark: str = ", ") -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), mark)


def _share(confidence: Column, default: float = 1.0) -> Column:
    return F.format_string("%.0f%%", 100 * F.coalesce(confidence, F.lit(default)))


def _block(title: str, items: Column, close: str = "") -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"<!-- {title} -->\n\n"), F.array_join(items, "\n"), F.lit(close)))


def _headed(x: Column, *lines: Column) -> Column:
    less = F.when(x["confidence"] < 1, F.concat(F.lit("- Confidence: "), F.format_string("%.2f", x["confidence"])))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("#### "), x["name"]), *lines[:-1], less, lines[-1]), F.lit("\n"))


def full_page(pages: DataFrame, extracted: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """page_id, domain, content: one page in full: title, metadata, summary, body, what was extracted of it (extracted: page_id
    and the arrays of EXTRACTION) and its links (links: src, dst; `links` of the pages themselves, too). Sections without
    content are left out; a page's links and backlinks stand in order."""
    out, has = pages, lambda c: c in pages.columns
    get = lambda c: F.col(c).cast("string") if has(c) else F.lit(None).cast("string")
    lists = lambda c, mark=", ": _listed(F.col(c), mark) if has(c) else F.lit("")
    text_id = F.col("page_id").cast("string")
    meta = [_some(n, c) for n, c in (
        ("id", text_id), ("domain", get("domain")), ("kind", get("kind")), ("status", get("status")), ("confidence", get("confidence")), ("created_at", get("created")), ("updated_at", get("updated")),
        ("entity_type", get("entity_type")), ("aliases", lists("aliases")), ("related_concepts", lists("related_concepts")), ("source_type", get("source_type")), ("tags", lists("tags")), ("sources", lists("sources", "; ")),
    )]
    metadata = F.concat_ws("\n", F.lit("<!-- Metadata -->"), *meta, F.lit(""))
    summary = F.when(F.coalesce(get("summary"), F.lit("")) != "", F.concat(F.lit("<!-- Summary -->\n> "), get("summary"), F.lit("\n")))
    body = F.concat(F.lit("<!-- Content -->\n\n"), F.trim(F.coalesce("body", F.lit(""))), F.lit("\n"))
    sections = []
    if extracted is not None:
        out = out.withColumn("__id", text_id).join(extracted.select(F.col("page_id").cast("string").alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("entities", "concepts", "claims", "relationships")]), "__id", "left")
        entity = lambda x: _headed(x, F.concat(F.lit("- Type: "), F.coalesce(x["entity_type"], F.lit(""))), _some("Description", x["description"]), _some("Aliases", _listed(x["aliases"])), _some("Context", x["context"]))
        concept = lambda x: _headed(x, _some("Definition", x["definition"]), _some("Category", x["category"]), _some("Related", _listed(x["related_concepts"])), _some("Examples", _listed(F.slice(x["examples"], 1, 3), "; ")))
        of = lambda x, n: F.when(F.coalesce(x[n], F.lit("")) != "", F.concat(F.lit(f"{n}="), x[n]))

        def claim(x):
            detail = F.concat_ws(", ", of(x, "subject"), of(x, "predicate"), of(x, "object"))
            under = lambda mark, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  - {mark}"), v))
            return F.concat_ws("\n", F.concat(F.lit("- "), x["claim"], F.lit(" ("), _share(x["confidence"]), F.lit(")")), under("", detail), under("temporal: ", x["temporal_context"]), under("qualifiers: ", _listed(x["qualifiers"], "; ")))

        def relationship(x):
            left = F.when(F.coalesce(x["bidirectional"], F.lit(False)), F.lit("<--[")).otherwise("--[")
            line = F.concat(F.lit("- "), x["source_entity"], F.lit(" "), left, x["relationship_type"], F.lit("]--> "), x["target_entity"], F.lit(" ("), _share(x["confidence"]), F.lit(")"))
            return F.concat_ws("\n", line, F.when(F.coalesce(x["description"], F.lit("")) != "", F.concat(F.lit("  - "), x["description"])))

        each = (("Entities", "entities", entity, ""), ("Concepts", "concepts", concept, ""), ("Claims", "claims", claim, "\n"), ("Relationships", "relationships", relationship, "\n"))
        sections += [_block(title, F.transform(f"__{c}", f), close) for title, c, f, close in each]
    if links is not None:
        own = links.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
        known = pages.select(text_id.alias("dst"), F.lit(True).alias("known")).distinct()
        forward = own.join(known, "dst", "left").groupBy(F.col("src").alias("__l")).agg(F.sort_array(F.collect_list("dst")).alias("__forward"), F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("dst")))).alias("__broken"))
        back = own.groupBy(F.col("dst").alias("__b")).agg(F.sort_array(F.collect_list("src")).alias("__back"))
        out = out.join(forward, text_id == F.col("__l"), "left").join(back, text_id == F.col("__b"), "left")
        kinds = ([("Links (from metadata):", F.col("links"))] if has("links") else []) + [("Forward links:", F.col("__forward")), ("Backlinks:", F.col("__back")), ("Broken links (targets not found):", F.col("__broken"))]
        part = lambda title, a: F.when(F.size(a) > 0, F.concat(F.lit(f"**{title}**\n"), F.array_join(F.transform(a, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"), F.lit("\n")))
        sections.append(_block("Links", F.array_compact(F.array(*[part(t, a) for t, a in kinds]))))
    title = F.concat(F.lit("# "), F.coalesce("title", text_id), F.lit("\n"))
    ends = [F.concat(s, F.lit("\n")) for s in sections]
    return out.select("page_id", "domain", F.concat_ws("\n", title, metadata, summary, body, *ends).alias("content"))


def page_content(columns: list[str]) -> Column:
    """A page row as a Markdown file with a YAML header, of the fields that it has. JSON scalars and lists are YAML as well."""
    fields = [f for f in ("page_id", "title", "kind", "domain", "status", "tags", "summary", "source", "confidence", "created", "updated") if f in columns]
    lines = [F.regexp_replace(F.to_json(F.struct(F.col(f).alias("x"))), r'^\{"x":(.*)\}$', f"{'id' if f == 'page_id' else f}: $1") for f in fields]
    shown = F.filter(F.array(*lines), lambda x: x != "{}")
    return F.concat(F.lit("---\n"), F.array_join(shown, "\n"), F.lit("\n---\n"), F.coalesce("body", F.lit("")))


def page_file(pages: DataFrame) -> DataFrame:
    """path, content: pages as files of their domain."""
    path = F.concat_ws("/", "domain", F.lit("pages"), F.concat(F.col("page_id").cast("string"), F.lit(".md")))
    return pages.select(path.alias("path"), page_content(pages.columns).alias("content"))


def export_stats(pages: DataFrame, backlinks: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """One row: n_pages, n_domains, n_with_backlinks and, with extracted (page_id), n_with_extractions."""
    if extracted is not None:
        own = extracted.select(F.col("page_id").cast("string").alias("__x")).distinct()
        with_extractions = pages.join(own, F.col("page_id").cast("string") == F.col("__x"), "left_semi").agg(F.count("*").alias("n_with_extractions"))
        return export_stats(pages, backlinks).join(with_extractions, F.lit(True))  # one row each
    b = backlinks.select(F.col("dst").alias("page_id"), "n_backlinks")
    return pages.join(b, "page_id", "left").agg(F.count("*").alias("n_pages"), F.countDistinct("domain").alias("n_domains"), F.count("n_backlinks").alias("n_with_backlinks"))


def sidecar(pages: DataFrame) -> DataFrame:
    """page_id, and the JSON of its metadata and counts."""
    body = F.coalesce("body", F.lit(""))
    counts = F.struct(T.word_count(body).alias("word_count"), F.char_length(body).alias("char_count"), (F.trim(body) != "").alias("has_content"))
    return pages.select("page_id", counts.alias("c"), F.to_json(F.struct("page_id", "title", "domain", "kind", "tags", counts.alias("_computed"))).alias("json")).select("page_id", "c.*", "json")


def graph_json(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """part (node or edge), key, json. Edges without a source or target are left out."""
    nodes = pages.select(F.lit("node").alias("part"), F.col("page_id").cast("string").alias("key"), F.to_json(F.struct(F.col("page_id").alias("id"), F.col("title").alias("label"), "domain", "kind")).alias("json"))
    ends = edges.where("source != '' and target != ''")
    return nodes.unionByName(ends.select(F.lit("edge").alias("part"), F.concat_ws("->", "source", "target").alias("key"), F.to_json(F.struct("source", "target", "type")).alias("json")))


def sitemap(pages: DataFrame, base: str, fallback: str) -> DataFrame:
    """loc, lastmod; write.format("xml") with rowTag `url` and rootTag `urlset` gives the file."""
    at = F.coalesce(F.date_format("updated", "yyyy-MM-dd"), F.lit(fallback))
    return pages.select(F.concat_ws("/", F.lit(base), "domain", F.col("page_id").cast("string")).alias("loc"), at.alias("lastmod"))


def template(body: Column, values: dict[str, Column]) -> Column:
    """Placeholders are replaced literally, key by key."""
    for k, v in values.items():
        body = F.replace(body, F.lit(k), v)
    return body


def governance_summary(pages: DataFrame, as_of: str, links: DataFrame, site: DataFrame, duplicates: DataFrame | None = None, contradictions: DataFrame | None = None) -> DataFrame:
    """check, n: a row per detector; duplicates and contradictions are counted where their detectors' rows are given."""
    from tessera.operators import governance as G
    from tessera.operators import links as L

    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    issues = G.lint(pages)
    out = one("lint_errors", issues.where("severity = 'error'"))
    for name, df in (("lint_warnings", issues.where("severity = 'warning'")), ("stale", G.staleness(pages, as_of).where("score >= 0.3")), ("low_quality", G.quality(pages).where("score <= 0.6")), ("broken_links", L.broken(links, site)), ("orphans", L.orphans(links, site))):
        out = out.unionByName(one(name, df))
    for name, df in (("duplicates", duplicates), ("contradictions", contradictions)):
        out = out if df is None else out.unionByName(one(name, df))
    return out


def report(rows: DataFrame, band: str, line: Column, order: Column, most: int) -> DataFrame:
    """section, text: the first `most` lines of each band."""
    top = rows.withColumn("__r", F.row_number().over(W.partitionBy(band).orderBy(order))).where(F.col("__r") <= most)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", line.alias("line")))), lambda x: x["line"]), "\n")
    return top.groupBy(F.col(band).alias("section")).agg(lines.alias("text"))
