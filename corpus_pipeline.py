"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of `documents`
(the last one: packed pieces). run() writes each stage's rows as Parquet and rereads them as the next one's docs. Empty
tables pass every stage; extra columns are carried through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, pii, quality
from tessera.llm.common import dropped, table, written

#: Near-duplicates: five-word shingles, a similarity of 0.8 or more.
WIDTH, SIMILAR = 5, ngram_join.PartEnum(num=80, den=100)


#: Rows of a batch that a task hands to Python; texts are long, and at the default of 10,000 a batch is a whole partition,
#: which stands in the executor's JVM and in its Python workers at once.
BATCH = 1000


def _bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Texts are judged whole, null ones as empty; rows that repeat
    an id or have none are judged one by one; without labels nothing is rejected."""
    _bounded_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(~quality.rejected(docs, model))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, of rows with one id that of the least text
    hash, and of rows with one id and text that whose columns come first as JSON. Rows of one id with unlike texts are
    unlike documents. Documents without words or without an id have no group and stay."""
    _bounded_batches(spark)
    found = ngram_join.jaccard_join(docs, width=WIDTH, how=SIMILAR)
    mark = "__kept"
    while any(c.startswith(mark) for c in docs.columns):  # an input may have any columns
        mark += "_"
    one, digest, times = (f"{mark}_{c}" for c in ("id", "hash", "rows"))
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    rows = found.where("group_id is not null").groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = rows.groupBy("group_id").agg(first, F.min_by("n", F.struct("doc_id", "text_hash")).alias("n"))
    kept, path = written(best.select(F.col("first.doc_id").alias(one), F.col("first.text_hash").alias(digest), F.col("n").alias(times)), "kept")
    # what stays grows with the corpus: one plan at every size
    same = (F.col("doc_id") == F.col(one)) & (F.xxhash64("text") == F.col(digest))
    out = docs.join(kept.hint("merge"), same)
    result = out.where(F.col(times) == 1).select(docs.columns)
    if kept.where(F.col(times) > 1).limit(1).count():  # copies of one id
        every = F.struct(*docs.columns)
        again = out.where(F.col(times) > 1).groupBy("doc_id", "text").agg(F.min_by(every, F.to_json(every)).alias("x"))
        result = result.unionByName(again.select("x.*"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = docs.where(F.col("doc_id").isNull() | wordless)
    return result.unionByName(alone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item, each row judged by its own whole text; null texts leak nothing, null and repeated
    ids are nothing special, and an empty benchmark leaves all."""
    _bounded_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, row by row, with personal data masked; null texts stay null."""
    _bounded_batches(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null texts are empty (one piece: the end token); rows that repeat an id are packed one
    by one."""
    import public_tokenizers

    _bounded_batches(spark)
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bestfit_packing", packing_stage),
]

#: A network, alignment and a tokenizer are no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
