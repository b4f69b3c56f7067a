"""Tables in versions: what a commit writes is staged first and becomes visible by one rename of a manifest.

A root holds `data/` (Parquet, never changed once written) and `_versions/` (a small JSON file a version: the paths of each
table, in order). Readers take the last manifest, or one that they name. A write that fails leaves files that no manifest
names; two writers of one version can't both succeed, as the second finds the name taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/_versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def current(spark: SparkSession, root: str) -> int:
    """The last version; 0 if there is none."""
    return max(_versions(spark, root), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, list[str]]:
    """table -> paths, of a version (the last by default)."""
    version = current(spark, root) if version is None else version
    if version == 0:
        return {}
    fs, p = _fs(spark, f"{root}/_versions/v{version:08}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def switch(spark: SparkSession, root: str, tables: dict[str, list[str]], base: int) -> int:
    """Make `tables` the version after `base`, in one rename. Fails if another writer was first."""
    fs, staged = _fs(spark, f"{root}/_versions/.staged-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    _, final = _fs(spark, f"{root}/_versions/v{base + 1:08}.json")
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise RuntimeError(f"version {base + 1} of {root} was written by another writer")
    return base + 1


def stage(df: DataFrame, root: str, table: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write df where no manifest names it yet; its path."""
    path = f"{root}/data/{table}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return path


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Replace the given tables, all or none; other tables stay."""
    base = current(spark, root)
    staged = {name: [stage(df, root, name)] for name, df in tables.items()}
    return switch(spark, root, manifest(spark, root, base) | staged, base)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(*manifest(spark, root, version)[table])


def rollback(spark: SparkSession, root: str, to: int) -> int:
    """A new version that is as version `to` was."""
    return switch(spark, root, manifest(spark, root, to), current(spark, root))


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the last `keep` versions and the data that only they name; how many paths went. Run it when no reader
    has an older version open and no write is under way."""
    versions = _versions(spark, root)
    held = {p for v in versions[-keep:] for paths in manifest(spark, root, v).values() for p in paths if "/" in p}
    names = {p.rsplit("/", 1)[1] for p in held}
    fs, data = _fs(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in names] if fs.exists(data) else []
    for p in gone:
        fs.delete(p, True)
    for v in versions[:-keep]:
        fs.delete(_fs(spark, f"{root}/_versions/v{v:08}.json")[1], False)
    return len(gone)
