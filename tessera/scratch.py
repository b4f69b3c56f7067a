"""Tables that a job writes for itself and reads again: lineage ends in files that outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: monotonically_increasing_id() has a row's number in its partition in so many bits.
PLACE_BITS = 33
_own: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, else in the warehouse, which executors share too; a local
    session without either setting uses a folder of its own."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base is None:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    _paths.setdefault(app, []).append(f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}")
    return _paths[app][-1]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that are no longer read."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, str]:
    """rows with `n`: a row's number, from 1, among those of its key, in the given order; and the path of the table that it
    reads. Rows are sorted in ranges of key and order, so a key may have any number of them: each range learns from the
    others where its first key began."""
    deal = [key, *order]
    held, path = written(rows.repartitionByRange(*deal).sortWithinPartitions(*deal).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("__part", F.shiftright("__at", PLACE_BITS)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    sizes = held.groupBy(key, "__part").agg(F.count("*").alias("__size"))
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range that holds the key
    starts = held.groupBy(key, "__part").agg(F.min("__at").alias("__first")).join(sizes, [key, "__part"]).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    placed = held.join(starts, [key, "__part"])
    return placed.withColumn("n", F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*rows.columns, "n"), path


def cleared(spark: SparkSession) -> int:
    """Delete all that this session has in its shared folder; how many tables that were. Run it when their results have been
    written or read."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    dropped(spark, *paths)
    return len(paths)
