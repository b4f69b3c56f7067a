"""Full-text index and ranked search.

Score of a page: the sum over query tokens (repeats count) of tf / max(word_count, 1) / (1 + df), where titles weigh
three times and df counts pages of all domains. Ties (at 12 decimals) go to the least page id.

The stored index is a versioned set of tables (sources/versions.py). Its postings lie in blocks: a row holds a term's
postings of one range of pages, with their domain and word count inside and their greatest impact (tf / word_count) beside.
Ranges are classes of like word counts, cut by the hash of the page, and the same for all terms; so what the terms of a
query can add up to in a range is known from the blocks' heads alone. A search reads the heads, scores the ranges of
greatest bounds, and then only those whose bound reaches the worst of the best so far. Pages are joined for the rows that
are returned.
"""

from __future__ import annotations

import json
import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import scratch
from tessera.functions import text as T
from tessera.sources import versions

TITLE_WEIGHT = 3


def _counted(pages: DataFrame) -> DataFrame:
    """page_id, title, domain, words: the tokens of the title TITLE_WEIGHT times and those of the body. inline() keeps what
    is extracted in one place: a projection could be merged into those above and be computed for each use."""
    title, body = T.tokens(F.coalesce("title", F.lit(""))), T.tokens(F.coalesce("body", F.lit("")))
    held = pages.select("page_id", "title", "domain", F.inline(F.array(F.struct(title.alias("t"), body.alias("b")))))
    return held.select("page_id", "title", "domain", F.concat(*[F.col("t")] * TITLE_WEIGHT, F.col("b")).alias("words"))


def _term_counts(words: Column) -> Column:
    """(term, tf) of an array of tokens: counted in place, by the ends of runs of the sorted array."""
    held = F.sort_array(words)
    ends = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.coalesce(F.get(w, i) == F.get(w, i + 1), F.lit(False)))
    counted = F.transform(F.array(held), lambda w: F.transform(ends(w), lambda i: F.struct(F.get(w, i).alias("term"), i.alias("end"))))[0]
    tf = lambda c: F.transform(c, lambda x, i: F.struct(x["term"].alias("term"), (x["end"] - F.coalesce(F.get(c, i - 1)["end"], F.lit(-1))).cast("long").alias("tf")))
    return F.when(F.size(words) > 0, F.transform(F.array(counted), tf)[0])


def postings(pages: DataFrame) -> DataFrame:
    """page_id, term, tf: counted within each page, without a shuffle."""
    return _counted(pages).select("page_id", F.inline(_term_counts(F.col("words"))))


def documents(pages: DataFrame) -> DataFrame:
    return _counted(pages).select("page_id", "title", "domain", F.size("words").cast("long").alias("word_count"))


def term_df(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def query_tokens(query: str) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if re.fullmatch("[a-z0-9]{2,}", w)]


def _hits(pages: DataFrame, terms: list[str]) -> DataFrame:
    """page_id, title, domain, wc and tf0, tf1, ... of the pages that hold a term. One scan, tokens extracted once."""
    own = F.array(*[F.lit(t) for t in terms])
    found = F.filter("words", lambda w: F.array_contains(own, w))
    held = _counted(pages).select("page_id", "title", "domain", F.inline(F.array(F.struct(F.size("words").alias("wc"), found.alias("found")))))
    count = lambda t: F.size(F.filter("found", lambda w: w == t)).cast("long")
    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    return held.where(F.size("found") > 0).select("page_id", "title", "domain", "wc", *tf)


def search(pages: DataFrame, query: str, domain: str | None = None, limit: int = 10) -> DataFrame:
    """page_id, title, domain, score of the best pages. One scan extracts each page's tokens and writes what it holds of the
    query's terms; df and scores come from that table. A stored index needs no scan."""
    wanted = query_tokens(query)
    if not wanted:
        return pages.limit(0).select("page_id", "title", "domain", F.lit(0.0).alias("score"))
    terms = sorted(set(wanted))
    held, _ = scratch.written(_hits(pages, terms), "hits")
    df = held.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(terms))]).first()  # df counts pages of all domains
    held = held if domain is None else held.where(F.col("domain") == domain)
    score = sum((F.lit(float(wanted.count(t))) * F.col(f"tf{i}") / F.greatest("wc", F.lit(1)) / F.lit(1 + df[i]) for i, t in enumerate(terms)), F.lit(0.0))
    return held.select("page_id", "title", "domain", score.alias("score")).orderBy(F.desc(F.round("score", 12)), "page_id").limit(limit)


def search_index(posted: DataFrame, docs: DataFrame, query: str, limit: int = 10, domain: str | None = None) -> DataFrame:
    """The same over a stored index: only the postings of the query's terms are read."""
    wanted = query_tokens(query)
    spark = posted.sparkSession
    terms = spark.createDataFrame([(t, wanted.count(t)) for t in sorted(set(wanted))], "term string, times int")
    hits = posted.where(F.col("term").isin(sorted(set(wanted)))).join(F.broadcast(terms), "term")  # the query's words
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    part = F.col("times") * F.col("tf") / F.greatest("word_count", F.lit(1)) / (1 + F.col("df"))
    docs = docs if domain is None else docs.where(F.col("domain") == domain)
    return hits.join(F.broadcast(df), "term").join(docs, "page_id").groupBy("page_id", "title", "domain").agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 12)), "page_id").limit(limit)


# a stored index ------------------------------------------------------------------------------------------------------
#: Pages that a block aims at; text characters that one file of one bucket aims at; the most buckets.
BLOCK_PAGES, FILE_CHARS, BUCKETS = 4096, 1 << 23, 1024
#: Pages that the files of one number, over all buckets, aim at: what a frequent term can add to one file. Text characters
#: that a posting stands for.
FILE_PAGES, POSTING_CHARS = 1 << 16, 16
#: Blocks that are scored without a look at their bounds; ranges that are scored first where there are more.
FEW, FIRST = 1000, 8
#: Ranges that are broadcast; more are joined.
MOST = 100_000


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term) % buckets).cast("int")


def _cut(pages: int, chars: int) -> tuple[int, int, int]:
    """(buckets of terms, files of a bucket, parts of a word-count class). Files follow the pages, for a term of all pages has
    all its postings in one bucket; buckets follow the text of a file's pages. A part lies in one file."""
    files = max(1, math.ceil(pages / FILE_PAGES))
    buckets = min(BUCKETS, 8 << max(0, round(math.log2(1 + chars / files / FILE_CHARS / 8))))
    files = max(files, round(chars / buckets / FILE_CHARS))
    return buckets, files, files * max(1, math.ceil(pages / (8 * BLOCK_PAGES) / files))


def _layout(pages: DataFrame) -> tuple[int, int, int]:
    size = pages.agg(F.count("*").alias("n"), F.sum(F.char_length("body")).alias("c")).first()
    return _cut(size["n"], size["c"] or 0)


def _blocks(rows: DataFrame, layout: tuple[int, int, int]) -> DataFrame:
    """rows: page_id, domain, wc, term, tf -> one row a term and range, sorted by term within files of buckets."""
    buckets, files, parts = layout
    kind = F.floor(4 * F.log2(F.greatest("wc", F.lit(1)))).cast("int")  # quarters of octaves of word counts
    part = F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int")
    rows = rows.withColumn("range", kind * F.lit(parts) + part).withColumn("bucket", _bucket(F.col("term"), buckets))
    # one shuffle, a task a bucket and file; a frequent term's ranges lie in all files of its bucket, by their part
    dealt = rows.withColumn("file", F.col("bucket") * F.lit(files) + F.pmod("range", F.lit(files))).repartitionById(buckets * files, "file")
    found = dealt.groupBy("bucket", "file", "term", "range").agg(
        F.count("*").alias("n"), F.max(F.col("tf") / F.greatest("wc", F.lit(1))).alias("impact"), F.collect_list(F.struct("page_id", "tf", "wc", "domain")).alias("postings")
    )
    return found.sortWithinPartitions("bucket", "term", "range").drop("file")


def store(pages: DataFrame, path: str) -> int:
    """Add pages to the index as one segment: tokens are extracted once and shuffled once. Pages of a later segment replace
    those of earlier ones; write only what has changed. The new version."""
    layout = _layout(pages)
    rows = _counted(pages).select("page_id", "domain", F.size("words").cast("long").alias("wc"), F.inline(_term_counts(F.col("words"))))
    return _append(pages, path, _blocks(rows, layout), layout[0], pages.select("page_id", "title", "domain", F.lit(False).alias("gone")))


def _append(df: DataFrame, path: str, blocks: DataFrame | None, buckets: int, docs: DataFrame) -> int:
    spark, base = df.sparkSession, versions.current(df.sparkSession, path)
    held = versions.manifest(spark, path, base)
    new = _staged(path, blocks, buckets, docs)
    return versions.switch(spark, path, {t: [*held.get(t, []), new[t]] for t in new}, base)


def _staged(path: str, blocks: DataFrame | None, buckets: int, docs: DataFrame) -> dict[str, str]:
    """What a manifest holds of a segment: its paths, and their schemas, so that a search need not look into files for them."""
    staged = versions.stage(blocks, path, f"blocks-{buckets}", ("bucket",)) if blocks is not None else "none"
    schema = blocks.schema.json() if blocks is not None else "none"
    return {"blocks": staged, "documents": versions.stage(docs, path, "documents"), "block_schemas": schema, "document_schemas": docs.schema.json()}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).option("basePath", path).parquet(path)


def store_removed(gone: DataFrame, path: str) -> int:
    """A segment that takes the pages of `gone` (page_id) out of the index."""
    text = F.lit(None).cast("string")
    return _append(gone, path, None, 0, gone.select("page_id", text.alias("title"), text.alias("domain"), F.lit(True).alias("gone")))


def _documents(spark: SparkSession, held: dict) -> DataFrame:
    """page_id, title, domain, gone, segment of all segments."""
    out = None
    for i, p in enumerate(held["documents"]):
        rows = _read(spark, p, held["document_schemas"][i]).withColumn("segment", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def _heads(spark: SparkSession, held: dict, terms: list[str] | None) -> DataFrame:
    """segment, term, range, n, impact, postings of the segments' blocks; with terms, of their buckets alone."""
    out = None
    for i, p in enumerate(held["blocks"]):
        if p == "none":
            continue
        rows = _read(spark, p, held["block_schemas"][i])
        if terms is not None:
            buckets = int(re.search(r"/blocks-(\d+)-", p)[1])
            own = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
            rows = rows.where(F.col("bucket").isin(own) & F.col("term").isin(terms))
        rows = rows.select(F.lit(i).alias("segment"), "term", "range", "n", "impact", "postings")
        out = rows if out is None else out.unionByName(rows)
    return out


def _live(spark: SparkSession, held: dict) -> DataFrame | None:
    """page_id, segment of the pages as they are now; None if there is one segment, whose pages all are."""
    if len(held["documents"]) == 1:
        return None
    last = _documents(spark, held).groupBy("page_id").agg(F.max_by(F.struct("segment", "gone"), "segment").alias("x"))
    return last.where("not x.gone").select("page_id", "x.segment")


def _opened(heads: DataFrame, live: DataFrame | None) -> DataFrame:
    """term, page_id, tf, wc, domain of the blocks' live postings."""
    rows = heads.select("segment", "term", F.inline("postings"))
    return (rows if live is None else rows.join(live, ["page_id", "segment"], "left_semi")).select("term", "page_id", "tf", "wc", "domain")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of a stored index, of each page's last segment."""
    held = versions.manifest(spark, path)
    live, docs = _live(spark, held), _documents(spark, held)
    docs = docs.where("not gone") if live is None else docs.join(live, ["page_id", "segment"], "left_semi")
    return _opened(_heads(spark, held, None), live), docs.select("page_id", "title", "domain")


def compacted(spark: SparkSession, path: str) -> int:
    """Merge the segments into one that holds the live pages alone, as a new version: readers see the old one or the new."""
    base = versions.current(spark, path)
    held = versions.manifest(spark, path, base)
    rows, docs = stored(spark, path)
    layout = _cut(docs.count(), POSTING_CHARS * (_heads(spark, held, None).agg(F.sum("n")).first()[0] or 0))
    new = _staged(path, _blocks(rows, layout), layout[0], docs.withColumn("gone", F.lit(False)))
    return versions.switch(spark, path, {t: [x] for t, x in new.items()}, base)


def search_stored(spark: SparkSession, path: str, query: str, limit: int = 10, domain: str | None = None) -> DataFrame:
    """search() over a stored index."""
    wanted, held = query_tokens(query), versions.manifest(spark, path)
    docs, terms = _documents(spark, held), sorted(set(wanted))
    live = _live(spark, held)
    if live is not None:
        docs = docs.join(live, ["page_id", "segment"], "left_semi")
    if not terms or all(p == "none" for p in held["blocks"]):
        return docs.limit(0).select("page_id", "title", "domain", F.lit(0.0).alias("score"))
    heads = _heads(spark, held, terms)
    counts = heads.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks")).collect()  # the query's words
    df, blocks = {r["term"]: r["df"] for r in counts}, sum(r["blocks"] for r in counts)
    if live is not None:
        df = {r["term"]: r["df"] for r in _opened(heads, live).groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not df:
        return docs.limit(0).select("page_id", "title", "domain", F.lit(0.0).alias("score"))
    weight = F.element_at(F.create_map(*[x for t, n in df.items() for x in (F.lit(t), F.lit(wanted.count(t) / (1.0 + n)))]), F.col("term"))

    def scored(some: DataFrame) -> DataFrame:
        rows = _opened(some, live)
        rows = rows if domain is None else rows.where(F.col("domain") == domain)
        sums = rows.groupBy("page_id").agg(F.sum(F.col("tf") / F.greatest("wc", F.lit(1)) * weight).alias("score"))
        return sums.orderBy(F.desc(F.round("score", 12)), "page_id").limit(limit)

    if blocks > FEW:  # what a page of a range can score at most: the greatest impact of each term there
        bounds = heads.groupBy("range", "term").agg(F.max("impact").alias("impact")).groupBy("range").agg(F.sum(F.col("impact") * weight).alias("bound"))
        first = [r["range"] for r in bounds.orderBy(F.desc("bound")).limit(FIRST).collect()]
        best = scored(heads.where(F.col("range").isin(first))).collect()
        if len(best) == limit:  # no range below the worst of these can add a page
            enough = bounds.where(F.col("bound") >= best[-1]["score"] - 1e-9).select("range")
            heads = heads.join(F.broadcast(enough) if enough.count() <= MOST else enough, "range", "left_semi")
    top = scored(heads)
    return top.join(docs.select("page_id", "title", "domain"), "page_id").select("page_id", "title", "domain", "score").orderBy(F.desc(F.round("score", 12)), "page_id")
