"""Exact dedup by content sort. DataFrame functions only.

Sampled splitters deal the rows into ranges of their normalised bytes, an external sort of each range places equal texts
next to each other, and each text is compared whole with its neighbour. Of equal texts the one with the most code points
before normalisation stays, of those the smallest identifier.

1. A sample of rows, drawn by hash with odds that follow their bytes, gives the splitters; it holds OVER rows a range at
   most, RANGES ranges, so what the driver sees is bounded. A row's place in the order is its first bytes, its digest,
   its length and its id; so a group of copies, however large, is cut between its members, and no range holds much more
   than another, by bytes as by rows.
2. One shuffle moves each row to its range (the range's number is the partition), where it is sorted with spilling and
   held against the row before it, text against text. Equal neighbours are a run; runs are counted in their range.
3. Runs that go on in the next range are found by comparing the last text of a range with the first one of the next,
   again whole; what is joined over ranges is a row a range.

Normalised: without the characters of `[\\x20\\x09-\\x0D]`. Defined cases: null texts count as empty, and are equal to each
other and to texts of white space alone; very long texts are compared whole; null ids come after all others, and rows that
repeat an id are told apart by nothing, so one of them (any) is the one that is kept; an empty table gives an empty
result; ids must be whole numbers (else TypeError); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import whole_numbers, written

#: Text bytes that a range aims at, the most ranges, and sampled rows a range.
RANGE_BYTES, RANGES, OVER = 32 << 20, 20_000, 16
#: First bytes of a text that its place starts with; a row counts as so many bytes besides its text.
HEAD, ROW = 16, 500
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with norm, chars, and head and sha, which come first in the order."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    head = F.rpad(F.lower(F.hex(F.substring(F.col("norm").cast("binary"), 1, HEAD))), 2 * HEAD, "0")
    return rows.select("*", head.alias("head"), F.sha2("norm", 256).alias("sha"))


def _place() -> Column:
    """The order as one string: head, digest, falling length, id (null last)."""
    sixteen = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    id_key = F.when(F.col("doc_id").isNull(), F.lit("g")).otherwise(sixteen(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))))
    return F.concat("head", "sha", sixteen(F.lit(2**40) - F.col("chars")), id_key)


def splitters(docs: DataFrame, ranges: int, size: float) -> list[str]:
    """At most ranges - 1 rising splitters. size: the bytes of all rows, ROW of each included."""
    weight = F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(ROW)
    odds = weight * (ranges * OVER / size)
    dice = F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5
    # distinct: rows that repeat an id and a text share a hash, so they are drawn together
    found = sorted(r["k"] for r in _placed(docs.where(dice < odds)).select(_place().alias("k")).distinct().collect())
    cuts = set()
    for at in {i * len(found) // ranges for i in range(1, ranges)} - {0}:
        before, own = found[at - 1], found[at]
        same = next(j for j, (x, y) in enumerate(zip(before, own)) if x != y)
        cuts.add(own[: same + 1])  # the shortest start that tells it from the row before
    return sorted(cuts)


def _range_of(place: Column, cuts: list[str]) -> Column:
    """How many cuts are at or before a place; they are held in two levels, so a row meets about 2 * sqrt(cuts)."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= place))
    g = upto(F.split(F.lit(",".join(x[0] for x in groups)), ",")) - 1
    inside = F.split(F.get(F.split(F.lit(";".join(",".join(x) for x in groups)), ";"), g), ",")
    return F.when(g < 0, 0).otherwise(g * step + upto(inside)).cast("int")


def _runs(docs: DataFrame, range_bytes: int) -> DataFrame:
    """The rows without their texts, sorted in ranges: bucket, run (from 1), n (rows of the run), keep and place in it;
    first and last mark a bucket's ends, which keep their text in `edge`."""
    spark = docs.sparkSession
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    size = (total["b"] or 0) + ROW * total["n"]
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes))
    cuts = splitters(docs, ranges, size) if size else []
    placed = _placed(docs)
    dealt = placed.select("*", _place().alias("k")).select("*", _range_of(F.col("k"), cuts).alias("bucket")).drop("k")
    order = [F.col("head"), F.col("sha"), F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    along = W.partitionBy("bucket").orderBy(*order)
    rows = dealt.repartitionById(len(cuts) + 1, "bucket").select(
        "bucket", "doc_id", "sha", "head", "chars", "norm",
        F.row_number().over(along).alias("pos"),
        F.lag("norm").over(along).alias("before"),
        F.lead(F.lit(1)).over(along).isNull().alias("last"),
    )
    new = F.when(F.col("before") == F.col("norm"), 0).otherwise(1)
    first = F.col("pos") == 1
    rows = rows.select(
        "bucket", "doc_id", "sha", "pos", "last", first.alias("first"),
        F.sum(new).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("run"),
        F.when(first | F.col("last"), F.col("norm")).alias("edge"),
    )
    run = W.partitionBy("bucket", "run")
    return rows.select(
        "bucket", "run", "doc_id", "sha", "first", "last", "edge",
        F.count("*").over(run.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
        F.first("doc_id").over(run.orderBy("pos")).alias("keep"),
        F.row_number().over(run.orderBy("pos")).alias("place"),
    )


def _over_ranges(rows: DataFrame) -> DataFrame:
    """(bucket, run, chain, keep, n) of the runs that are parts of a longer one: chain is the bucket where it starts."""
    tops = rows.where("first").select("bucket", F.col("edge").alias("top"), F.col("n").alias("top_n"))
    ends = rows.where("last").select("bucket", F.col("edge").alias("end"), F.col("run").alias("runs"), F.col("n").alias("end_n"), F.col("keep").alias("end_keep"))
    before = ends.select((F.col("bucket") + 1).alias("bucket"), F.col("end").alias("text_before"))
    goes_on = F.coalesce(F.col("text_before") == F.col("top"), F.lit(False))
    links = tops.join(ends, "bucket").join(before, "bucket", "left").select("bucket", "runs", "top_n", "end_n", "end_keep", goes_on.alias("on"))
    along = W.orderBy("bucket")  # a row a range, RANGES at most
    links = (
        links.withColumn("own", ~(F.col("on") & (F.col("runs") == 1)))
        .withColumn("start", F.last(F.when(F.col("own"), F.col("bucket")), ignorenulls=True).over(along))
        .withColumn("chain", F.lag("start").over(along))
        .withColumn("next_on", F.coalesce(F.lead("on").over(along), F.lit(False)))
    )
    part = lambda c, r, n: F.struct(F.col(c).alias("chain"), r.cast("long").alias("run"), F.col(n).alias("n"))
    both = F.array(F.when(F.col("on"), part("chain", F.lit(1), "top_n")), F.when(F.col("own") & F.col("next_on"), part("bucket", F.col("runs"), "end_n")))
    parts = links.select("bucket", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("bucket", "p.*")
    whole = parts.groupBy("chain").agg(F.sum("n").alias("n"))
    keeps = links.select(F.col("bucket").alias("chain"), F.col("end_keep").alias("keep"))
    return parts.drop("n").join(whole, "chain").join(keeps, "chain").select("bucket", "run", "chain", "keep", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = whole_numbers(docs, id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, _ = written(_runs(docs, range_bytes), "content")
    longer = F.broadcast(_over_ranges(rows).withColumnsRenamed({"keep": "whole_keep", "n": "whole_n"}))  # two rows a range at most
    part = F.col("chain").isNotNull()
    return rows.drop("first", "last", "edge").join(longer, ["bucket", "run"], "left").select(
        "doc_id",
        F.when(part, F.col("whole_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("whole_n", "n").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce(F.col("chain") == F.col("bucket"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
o AS (SELECT *, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM o
"""
