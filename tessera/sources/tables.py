"""The model's tables, derived from the driver's Parquet tables.

pages(page_id, kind, title, domain, tags, summary, source, confidence, created, updated, body): documents and labels.
links(src, dst): hrefs of web pages. edges: orders, customers, nations, regions. changes, executions, failures, reviews:
events. claims: sentences of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import ship

AS_OF = "2024-07-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer splits than the session has cores (one row group is one task, however long its texts
    are) is dealt out first. Larger ones are read as they lie."""
    d, cores = read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Times are made from the id, so that every age occurs; kinds and summaries too."""
    d = documents(spark, sf_dir)
    marks = read(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    created = F.date_add(F.lit("2023-06-01").cast("date"), (i % 360).cast("int")).cast("timestamp_ntz")
    return (
        d.join(marks, "doc_id", "left")
        .select(
            i.alias("page_id"),
            _kind(i).alias("kind"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("source").alias("domain"),
            F.array("lang", "source").alias("tags"),
            F.when(i % 3 != 0, T.truncated(F.split_part("text", F.lit("\n"), F.lit(2)))).alias("summary"),
            F.when(i % 4 != 0, F.concat(F.lit("doc/"), i.cast("string"))).alias("source"),
            F.coalesce(F.col("quality") * 0.5 + 0.4, F.lit(0.5)).alias("confidence"),
            created.alias("created"),
            F.when(i % 7 == 0, F.lit(None).cast("timestamp_ntz")).when(i % 2 == 0, created).otherwise(F.date_add(created, (i % 31).cast("int")).cast("timestamp_ntz")).alias("updated"),
            F.col("text").alias("body"),
        )
    )


def _kind(i):
    return F.element_at(F.array(*[F.lit(k) for k in ("page", "entity", "concept", "source", "qa")]), (i % 5 + 1).cast("int"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, kind, title, domain, tags, body of pages(). Labels could only repeat rows here, so unless some document has two, they are
    not joined: the join would shuffle all texts."""
    marks = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    held = ("page_id", "kind", "title", "domain", "tags", "body")
    if not marks.where("n > 1").isEmpty():
        return pages(spark, sf_dir).select(*held)
    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    return d.select(i.alias("page_id"), _kind(i).alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("domain"), F.array("lang", "source").alias("tags"), F.col("text").alias("body"))


PAGES_SQL = """
pages_ AS (
  SELECT d.doc_id AS page_id, ['page','entity','concept','source','qa'][CAST(d.doc_id % 5 + 1 AS INT)] AS kind,
    split_part(text, chr(10), 1) AS title, d.source AS domain, [lang, d.source] AS tags,
    CASE WHEN d.doc_id % 3 <> 0 THEN CASE WHEN length(split_part(text, chr(10), 2)) > 200
      THEN substring(split_part(text, chr(10), 2), 1, 200) || '...' ELSE split_part(text, chr(10), 2) END END AS summary,
    CASE WHEN d.doc_id % 4 <> 0 THEN 'doc/' || d.doc_id END AS source,
    coalesce(quality * 0.5 + 0.4, 0.5)::DOUBLE AS confidence,
    (DATE '2023-06-01' + CAST(d.doc_id % 360 AS INT))::TIMESTAMP AS created,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN (DATE '2023-06-01' + CAST(d.doc_id % 360 AS INT))::TIMESTAMP
      ELSE (DATE '2023-06-01' + CAST(d.doc_id % 360 + d.doc_id % 31 AS INT))::TIMESTAMP END AS updated,
    text AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links between web pages: a page is named by the first word of its title."""
    p = read(spark, sf_dir, "pages")
    return p.select(
        page_name(F.col("html")).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("dst"),
    ).distinct()


def page_name(html):
    return F.regexp_extract(html, r"<title>([^ <]*)", 1)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(page_name(F.col("html")).alias("page_id")).distinct()


LINKS_SQL = """
site_ AS (SELECT DISTINCT regexp_extract(html, '<title>([^ <]*)', 1) AS page_id FROM pages),
links_ AS (SELECT DISTINCT regexp_extract(html, '<title>([^ <]*)', 1) AS src,
  unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS dst FROM pages)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type, weight."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return (
        o.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"), F.lit("placed_by").alias("type"), T.clamp(F.col("o_totalprice") / 500000.0).alias("weight"))
        .unionByName(c.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("in_nation").alias("type"), F.lit(1.0).alias("weight")))
        .unionByName(n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit("in_region").alias("type"), F.lit(1.0).alias("weight")))
    )


EDGES_SQL = """
edges_ AS (
  SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'placed_by' AS type, greatest(0.0, least(1.0, o_totalprice / 500000.0))::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation', 1.0 FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in_region', 1.0 FROM nation)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at least three words, with a confidence made from their length, numbered within their page."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", r"[.!?]\s+")).alias("claim_no", "text"))
    return d.select("page_id", F.col("claim_no").cast("long").alias("claim_no"), F.trim("text").alias("text")).where(T.word_count(F.col("text")) >= 3).withColumn(
        "confidence", (F.char_length("text") % 50) / 50.0
    )


CLAIMS_SQL = r"""
cut_ AS (SELECT doc_id AS page_id, regexp_split_to_array(text, '[.!?]\s+') AS parts FROM documents),
claims_ AS (SELECT page_id, claim_no, trim(part) AS text, (length(trim(part)) % 50) / 50.0 AS confidence
  FROM (SELECT page_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS claim_no FROM cut_)
  WHERE len(list_filter(regexp_split_to_array(trim(part), '\s+'), lambda w: w <> '')) >= 3)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, seq, ts, actor, change_type, value of the change log."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("actor"),
        F.when(F.col("event_id") % 3 == 0, "created").when(F.col("event_id") % 3 == 1, "updated").otherwise("merged").alias("change_type"), "value",
    )


CHANGES_SQL = """
changes_ AS (SELECT user_id AS page_id, event_id AS seq, ts, event_type AS actor,
  CASE event_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'merged' END AS change_type, value FROM events)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_name, execution_id, started_at, status, duration_seconds."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 11 == 0, "skipped").otherwise("completed")
    return e.select(F.concat(F.lit("job"), (F.col("user_id") % 8).cast("string")).alias("job_name"), F.col("event_id").alias("execution_id"), F.col("ts").alias("started_at"), status.alias("status"), F.col("value").alias("duration_seconds"))


EXECUTIONS_SQL = """
executions_ AS (SELECT 'job' || (user_id % 8) AS job_name, event_id AS execution_id, ts AS started_at,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'completed' END AS status, value AS duration_seconds FROM events)"""
