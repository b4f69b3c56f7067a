"""The ingest queue as data sources: an inbox of files read by adapters, and a sink of queue pages that commits.

Adapters are plug-ins: (name, takes(path, content), convert(path, content) -> (title, markdown)); the first that takes a
file converts it. The inbox lists a folder and reads its files in partitions of FILES; the sink writes each page to
`domains/{domain}/queue/{id}.md`. Tasks write into a staging folder of their own and the commit moves what they wrote, so a
task that is lost or tried twice leaves nothing; the same batch written again gives the same files. Paths are anything that
pyarrow.fs opens (a mount, hdfs, s3), which executors and driver must share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.operators import export, governance
from tessera.sources import pagefiles

#: Files of a partition.
FILES = 200


class Adapter(NamedTuple):
    name: str
    takes: Callable[[str, str], bool]
    convert: Callable[[str, str], tuple[str, str]]


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Some(InputPartition):
    pass


class _InboxReader(DataSourceReader):
    def __init__(self, path: str, adapters: list[Adapter]):
        self.path, self.adapters = path, adapters

    def partitions(self):
        from pyarrow import fs

        store, root = _files(self.path)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith("."))
        return [_Some(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [_Some([])]

    def read(self, partition):
        store, _ = _files(self.path)
        for name in partition.value:
            try:
                with store.open_input_stream(name) as f:
                    content = _text(f.read())
                adapter = next((a for a in self.adapters if a.takes(name, content)), None)
                title, markdown = adapter.convert(name, content) if adapter else (None, None)
            except Exception as e:  # one file that can't be read or converted is a row with its error
                yield name, None, None, None, f"{type(e).__name__}: {e}"
                continue
            error = "unsupported type" if adapter is None else "invalid format: empty" if not markdown.strip() else None
            yield name, adapter and adapter.name, title, markdown, error


def inbox(adapters: list[Adapter], name: str = "tessera_inbox") -> type[DataSource]:
    """A data source to register, whose rows are path, adapter, title, markdown, error."""

    class Inbox(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "path string, adapter string, title string, markdown string, error string"

        def reader(self, schema):
            return _InboxReader(self.options["path"], adapters)

    return Inbox


@dataclass
class _Wrote(WriterCommitMessage):
    folder: str
    pages: list


class _QueueWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def write(self, rows):
        store, root = _files(self.path)
        folder, pages = f"{root}/_staging/{self.run}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for n, r in enumerate(rows):
            with store.open_output_stream(f"{folder}/{n}.md") as f:
                f.write(r["content"].encode())
            pages.append(r["path"])
        return _Wrote(folder, pages)

    def commit(self, messages):
        store, root = _files(self.path)
        for m in filter(None, messages):
            for n, page in enumerate(m.pages):
                store.create_dir(f"{root}/{page}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{m.folder}/{n}.md", f"{root}/{page}")
        store.delete_dir(f"{root}/_staging/{self.run}")

    def abort(self, messages):
        from pyarrow import fs

        store, root = _files(self.path)
        if store.get_file_info(f"{root}/_staging/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staging/{self.run}")


class QueueSink(DataSource):
    """Writes rows of path and content as files below the option `path`."""

    @classmethod
    def name(cls):
        return "tessera_queue"

    def schema(self):
        return "path string, content string"

    def writer(self, schema, overwrite):
        return _QueueWriter(self.options["path"])


def queued(taken: DataFrame, domains: list[str], rules: list[tuple[str, str]], fallback: str) -> DataFrame:
    """taken: path, title, markdown and, if files state one, stated_domain -> page_id, domain, path, content of queue pages:
    routed, with an id that no other page has, and a header (kind source, status queued)."""
    stated = F.col("stated_domain") if "stated_domain" in taken.columns else F.lit(None).cast("string")
    routed = governance.route(taken.withColumns({"source_path": F.col("path"), "stated_domain": stated}), domains, rules, fallback)
    pages = pagefiles.with_ids(routed.select("path", "title", "domain", "markdown")).where("page_id is not null")
    page = pages.select("page_id", "title", F.lit("source").alias("kind"), "domain", F.lit("queued").alias("status"), F.col("path").alias("source"), F.col("markdown").alias("body"))
    file = F.concat_ws("/", F.lit("domains"), "domain", F.lit("queue"), F.concat("page_id", F.lit(".md")))
    return page.select("page_id", "domain", file.alias("path"), export.page_content(page.columns).alias("content"))


def write_queue(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Write queued() rows as files, all of them or none."""
    spark.dataSource.register(QueueSink)
    pages.select("path", "content").write.format("tessera_queue").mode("append").save(path)
