"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its
    own; on a cluster that is an error, as executors would not see a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and reread it: lineage ends in files that outlive any executor, so the
    job's shuffle files go with it (else they stay until the driver collects its garbage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that are no longer read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def joined(spans: Column, *, kind: str = "kind") -> Column:
    """kind:start:end of each struct of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def whole_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """df, whose id columns must be whole numbers: other ids would silently turn null or collide."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, IntegralType):
            raise TypeError(f"{c} must be of a whole number type, not {df.schema[c].dataType.simpleString()}")
    return df


def sampled(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows, those of the least hash of `by`: the same rows whatever the partitions. No full sort: each
    task keeps its own `most`."""
    key = F.xxhash64(*[F.col(c).cast("string") for c in by])
    return rows.orderBy(key, *by).limit(most)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, text: one text of each key, that of the least hash; a key's repeated rows are reduced before the shuffle."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


#: monotonically_increasing_id() has a row's number in its partition in so many bits.
PLACE_BITS = 33


def before(n: str) -> Column:
    """Sum of n over the partitions before a row's, of a table with a row a partition."""
    return F.coalesce(F.sum(n).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def places(rows: DataFrame, deal: list, order: list, keep: list) -> tuple[DataFrame, str]:
    """keep, with `part` (the range a row lies in) and `place` (from 0, in the order of all), as a written table."""
    held, path = written(rows.repartitionByRange(*deal).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("at")), "places")
    held = held.withColumn("part", F.shiftright("at", PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", before("n").alias("offset"))  # a row a partition
    return held.join(F.broadcast(offsets), "part").withColumn("place", F.col("at") + F.col("offset")).drop("at", "offset"), path


def numbered(rows: DataFrame, key: str, deal: list, order: list, keep: list) -> tuple[DataFrame, str]:
    """keep (the key among it), with `pos`: a row's number, from 0, among its key's rows in the given order, which begins
    with the key. A key's rows may lie in many ranges: each learns where its key began. Also the written table's path."""
    held, path = places(rows, deal, order, keep)
    starts = held.groupBy(key, "part").agg(F.min("place").alias("start"))
    starts = starts.withColumn("start", F.min("start").over(W.partitionBy(key)))  # a row a range that holds the key
    return held.join(starts, [key, "part"]).withColumn("pos", F.col("place") - F.col("start")).drop("part", "place", "start"), path
