"""Page files: Markdown with a YAML header under <root>/<domain>/pages/*.md. YAML has no reader in Spark, so headers are
parsed in pandas batches to JSON, then held as VARIANT; the rest is columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import scratch
from tessera.functions import text as T

HEADER = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"


def has_header(content: Column) -> Column:
    return content.rlike(r"^---\s*\n")


def header(content: Column) -> Column:
    return F.regexp_extract(content, HEADER, 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, HEADER, "")


def _scalar(x: str):
    x = x.strip()
    if x[:1] == x[-1:] and x[:1] in "'\"" and len(x) > 1:
        return x[1:-1]
    if x in ("", "null", "~"):
        return None
    if x in ("true", "false"):
        return x == "true"
    if re.fullmatch(r"[+-]?\d+", x):
        return int(x)
    if re.fullmatch(r"[+-]?\d*\.\d+", x):
        return float(x)
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",")] if x[1:-1].strip() else []
    return x


def header_json(text: str | None) -> str | None:
    """The JSON of a header; None if it can't be read. PyYAML where it is installed, else keys with scalars and lists."""
    if text is None:
        return None
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        if yaml is not None:
            got = yaml.safe_load(text)
        else:
            got, key = {}, None
            for line in text.split("\n"):
                if not line.strip() or line.lstrip().startswith("#"):
                    continue
                if re.match(r"\s*- ", line) and key is not None:
                    got[key] = (got[key] or []) + [_scalar(line.strip()[2:])]
                    continue
                key, colon, value = line.partition(":")
                if not colon or key != key.lstrip():
                    return None
                got[key] = _scalar(value)
        return json.dumps(got, default=str) if isinstance(got, dict) else None
    except Exception:  # a bad header is data, not a failure
        return None


@F.pandas_udf(StringType())
def _as_json(s: pd.Series) -> pd.Series:
    return s.map(header_json, na_action="ignore")


def parsed(files: DataFrame) -> DataFrame:
    """files: path, content -> page_id, domain (of the folder), meta (VARIANT), body, _parse_error. The id is the header's,
    else the file's stem."""
    raw = F.when(has_header(F.col("content")), header(F.col("content")))
    rows = files.select("path", raw.alias("raw"), body(F.col("content")).alias("body")).withColumn("json", _as_json(F.coalesce("raw", F.lit(""))))
    meta = F.try_parse_json("json")
    bad = F.when(F.col("raw").isNotNull() & F.col("json").isNull(), "invalid header")
    got = rows.select("path", "body", meta.alias("meta"), bad.alias("_parse_error"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return got.select(
        F.coalesce(F.try_variant_get("meta", "$.id", "string"), stem).alias("page_id"), F.regexp_extract("path", r"([^/]+)/pages/[^/]+$", 1).alias("domain"), "meta", "body", "_parse_error"
    )


def pages(parsed_files: DataFrame) -> DataFrame:
    """The page model's columns, with its defaults."""
    get = lambda f, t="string": F.try_variant_get("meta", f"$.{f}", t)
    return parsed_files.select(
        "page_id", F.coalesce(get("kind"), F.lit("page")).alias("kind"), get("title").alias("title"), "domain", get("domain").alias("stated_domain"), F.coalesce(get("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        get("summary").alias("summary"), get("source").alias("source"), get("confidence", "double").alias("confidence"), F.try_to_timestamp(get("created")).cast("timestamp_ntz").alias("created"),
        F.try_to_timestamp(get("updated")).cast("timestamp_ntz").alias("updated"), "body", "_parse_error",
    )


# What a header must hold
STATUSES = ("draft", "published", "archived", "review")
REQUIRED = ("id", "title", "domain")
REQUIRED_BY_KIND = {"page": (), "entity": ("entity_type",), "concept": (), "source": ("source_type", "source_path"), "qa": ("question", "answer")}
# End of fixed values


def header_error(meta: Column) -> Column:
    """What is wrong with a page's header (VARIANT), the first of: no header, no kind, an unknown kind, a required text that
    is missing or blank, a time that is none, a status or confidence out of range. Null: nothing."""
    get = lambda f, t="string": F.try_variant_get(meta, f"$.{f}", t)
    is_text = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(meta, f"$.{f}", "variant")) == "STRING", F.lit(False))
    missing = lambda f: ~is_text(f) | ~F.coalesce(get(f).rlike(r"\S"), F.lit(False))
    timeless = lambda f: F.try_to_timestamp(get(f)).isNull()
    present = lambda f: F.try_variant_get(meta, f"$.{f}", "variant").isNotNull()
    kind = get("kind")
    out = F.when(meta.isNull() | (F.schema_of_variant(meta) == "OBJECT<>"), "no header").when(~present("kind"), "no kind")
    out = out.when(~is_text("kind") | ~kind.isin(*REQUIRED_BY_KIND), "invalid kind")
    for f in REQUIRED:
        out = out.when(missing(f), f"no {f}")
    for k, fields in REQUIRED_BY_KIND.items():
        for f in fields:
            out = out.when((kind == k) & missing(f), f"no {f}")
    out = out.when(timeless("updated_at"), "no updated_at").when((kind == "source") & timeless("ingested_at"), "no ingested_at")
    out = out.when(present("status") & ~F.coalesce(get("status").isin(*STATUSES), F.lit(False)), "invalid status")
    confident = F.coalesce(get("confidence", "double").between(0, 1), F.lit(False))
    return out.when(present("confidence") & ~confident, "invalid confidence")


def checked(parsed_files: DataFrame) -> DataFrame:
    """parsed() with `error`: why a page's header is not valid; null if it is."""
    return parsed_files.withColumn("error", F.coalesce("_parse_error", header_error(F.col("meta"))))


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, content of whole files; bytes that are not UTF-8 are read as Latin-1."""
    return spark.read.format("binaryFile").load(glob).select("path", decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


# adapters ------------------------------------------------------------------------------------------------------------
def adapter(path: Column, content: Column) -> Column:
    """The first adapter that takes a file: session transcript, vault note, Markdown, text."""
    note = path.rlike(r"\.(md|markdown)$") & content.rlike(r"\[\[[^\]|]+(\|[^\]]+)?\]\]|#[a-zA-Z0-9_\-]+")
    return (
        F.when(path.rlike(r"(^|/)session-[^/]*\.(?i:jsonl?)$"), "session").when(note, "vault").when(path.rlike(r"\.(md|markdown)$"), "markdown").when(path.rlike(r"\.(txt|text)$"), "text")
    )


def text_title(content: Column) -> Column:
    """The first line, if it is not empty, under 100 characters and no sentence; else null."""
    line = F.trim(F.split_part(content, F.lit("\n"), F.lit(1)))
    return F.when((line != "") & (F.char_length(line) < 100) & ~line.endswith("."), line)


def text_markdown(content: Column) -> Column:
    title = text_title(content)
    return F.when(title.isNotNull(), F.concat(F.lit("# "), title, F.lit("\n\n"), F.trim(F.regexp_replace(content, r"^[^\n]*\n?", "")))).otherwise(F.trim(content))


def vault_note(notes: DataFrame) -> DataFrame:
    """path, links, embeds, tags, daily, markdown of vault notes; embeds become links."""
    c = F.col("content")
    return notes.select(
        "path", F.array_distinct(T.links(c, T.PLAIN_LINK)).alias("links"), F.array_distinct(T.links(c, T.EMBED)).alias("embeds"), F.array_distinct(T.links(c, T.HASHTAG)).alias("tags"),
        F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^\d{4}-\d{2}-\d{2}").alias("daily"), F.trim(F.regexp_replace(c, T.EMBED, "[[$1]]")).alias("markdown"),
    )


def session_blocks(turns: DataFrame, per_block: int = 200) -> DataFrame:
    """turns: conv_id, turn, role, text -> conv_id, block, n_messages, markdown of `## n. Role` sections. A block holds
    per_block turn numbers, so no conversation is gathered whole; in order of block they are the conversation."""
    section = F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(". "), F.initcap("role"), F.lit("\n\n"), F.trim("text"))
    one = F.struct("turn", F.when(F.trim("text") != "", section).alias("md"))
    kept = F.filter(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["md"]), lambda m: m.isNotNull())
    block = F.floor(F.coalesce("turn", F.lit(0)) / per_block).alias("block")
    return turns.groupBy("conv_id", block).agg(F.count("*").alias("n_messages"), F.array_join(kept, "\n\n").alias("markdown"))


def sessions(turns: DataFrame) -> DataFrame:
    """conv_id, n_messages, markdown of conversations that fit a row; for very long ones take session_blocks(). Numbers
    count messages without text, which give no section."""
    blocks = session_blocks(turns)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "markdown"))), lambda x: x["markdown"])
    return blocks.groupBy("conv_id").agg(F.sum("n_messages").alias("n_messages"), F.array_join(F.filter(parts, lambda m: m != ""), "\n\n").alias("markdown"))


def transcript_messages(lines: DataFrame) -> DataFrame:
    """lines: path, line_no, value of JSON-lines transcripts -> path, turn, role, text, session_id, capture_hook. Bad lines
    are skipped; content is a string or blocks, of which text is kept and tool activity named."""
    return _messages(lines.select("path", "line_no", F.try_parse_json("value").alias("m")))


def transcript_file_messages(files: DataFrame) -> DataFrame:
    """The same of `.json` transcripts (path, content of whole files): a list of messages, or an object that holds one as
    `messages`."""
    v = files.select("path", F.try_parse_json("content").alias("v"))
    held = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.messages", "array<variant>"))
    return _messages(v.select("path", F.posexplode(held).alias("line_no", "m")))


def transcript_meta(messages: DataFrame) -> DataFrame:
    """path, n_messages, session_id (the first given), capture_hook (the last given, else `unknown`)."""
    hook = F.max_by("capture_hook", F.when(F.col("capture_hook").isNotNull(), F.col("turn")))
    first = F.min_by("session_id", F.when(F.coalesce("session_id", F.lit("")) != "", F.col("turn")))
    return messages.groupBy("path").agg(F.count("*").alias("n_messages"), first.alias("session_id"), F.coalesce(hook, F.lit("unknown")).alias("capture_hook"))


def _messages(rows: DataFrame) -> DataFrame:
    """rows: path, line_no, m (VARIANT)."""
    v = rows.where(F.schema_of_variant("m").startswith("OBJECT"))
    get = lambda f, t="string": F.try_variant_get("m", f"$.{f}", t)
    blocks = F.from_json(F.to_json(F.try_variant_get("m", "$.content", "variant")), "array<struct<type:string,text:string,name:string>>")
    shown = F.array_join(
        F.array_compact(
            F.transform(
                blocks,
                lambda b: F.when((b["type"] == "text") & (F.trim(b["text"]) != ""), F.trim(b["text"]))
                .when(b["type"] == "tool_use", F.concat(F.lit("_[tool use: "), F.coalesce(b["name"], F.lit("tool")), F.lit("]_")))
                .when(b["type"] == "tool_result", F.lit("_[tool result]_")),
            )
        ),
        "\n\n",
    )
    is_text = F.schema_of_variant(F.try_variant_get("m", "$.content", "variant")) == "STRING"
    return v.select("path", F.col("line_no").alias("turn"), get("role").alias("role"), F.when(is_text, F.trim(get("content"))).otherwise(shown).alias("text"), F.coalesce(get("session_id"), get("sessionId")).alias("session_id"), get("_capture_hook").alias("capture_hook"))


def with_ids(pages: DataFrame, most: int = 100) -> DataFrame:
    """page_id of `{slug(domain)}-{slug(title)}` in `most` code points, without the domain if under 10 would be left for the
    title. No id stands for two paths: of pages that would share one, the first in order of title and path keeps it; the
    others try -2, -3 and so on (within `most`), and go on where a number is another page's id, until none repeats. (For
    entities the domain is the entity's type, for concepts null.) A path is one page; pages without a slug have no id."""
    domain = T.slugify(F.col("domain"))
    room = F.lit(most) - F.char_length(domain) - 1
    cut = F.rtrim(F.substring(F.col("__s"), F.lit(1), room), F.lit("-"))
    named = F.coalesce(F.when((F.col("domain") != "") & (room >= 10), F.concat_ws("-", domain, cut)), F.col("__s"))
    first = pages.groupBy("path").agg(F.min(F.struct("title", "domain")).alias("x")).select("path", "x.*")
    named = first.withColumn("__s", T.slugify(F.col("title"), most)).where("__s != ''").select("path", F.coalesce("title", F.lit("")).alias("title"), named.alias("base"))
    ids, _ = unique_ids(named, most)
    return pages.join(ids, "path", "left")


#: Numbers that are looked at ahead of a base's last one after the first round; twice as many each round.
AHEAD = 4


def _past_taken(last: DataFrame, taken: list[DataFrame], most: int, ahead: int) -> DataFrame:
    """last: base, last, lost -> base, last: moved on by whole steps of `lost` numbers that are all taken, as rounds would
    one by one; so a small base next to a large one of the same beginning is done in few rounds."""
    free = last.withColumn("k", F.explode(F.sequence(F.col("last") + 1, F.col("last") + ahead)))
    more = F.concat(F.lit("-"), F.col("k").cast("string"))
    free = free.select("base", "k", F.concat(F.substring(F.col("base"), F.lit(1), F.lit(most) - F.char_length(more)), more).alias("page_id"))
    for old in taken:
        free = free.join(old.select("page_id"), "page_id", "left_anti")
    free = last.join(free.groupBy("base").agg(F.min("k").alias("k")), "base", "left")
    steps = F.floor((F.coalesce("k", F.col("last") + ahead + 1) - F.col("last") - 1) / F.col("lost"))
    return free.select("base", (F.col("last") + steps * F.col("lost")).alias("last"))


def unique_ids(named: DataFrame, most: int) -> tuple[DataFrame, int]:
    """named: path, title, base -> (path, page_id), each id once; and the rounds that it took. In each round the pages of a
    base that have no id yet try the numbers that follow the last one tried for it. A number that is taken, or that a page
    of a lesser base tries as well, is given up for the next round."""
    spark = named.sparkSession
    rows, path = scratch.numbered(named, "base", "title", "path")
    waiting, rounds = rows.select("path", "base", "n", F.lit(0).cast("long").alias("skipped")), 0
    taken = []
    while True:
        more = F.concat(F.lit("-"), (F.col("n") + F.col("skipped")).cast("string"))
        tried = F.when(F.col("n") + F.col("skipped") == 1, F.col("base")).otherwise(F.concat(F.substring(F.col("base"), F.lit(1), F.lit(most) - F.char_length(more)), more))
        trying = waiting.withColumn("page_id", tried)
        one = F.struct((F.col("n") + F.col("skipped") != 1).alias("numbered"), "base", "n", "path")
        won = trying.groupBy("page_id").agg(F.min(one).alias("x")).select("page_id", "x.path")
        for old in taken:
            won = won.join(old.select("page_id"), "page_id", "left_anti")
        won, _ = scratch.written(won, "ids")
        taken.append(won)
        rounds += 1
        lost = trying.join(won.select("path"), "path", "left_anti")
        if not lost.limit(1).count():
            break
        tries = trying.groupBy("base").agg(F.max(F.col("n") + F.col("skipped")).alias("last"))
        last = _past_taken(tries.join(lost.groupBy("base").agg(F.count("*").alias("lost")), "base"), taken, most, AHEAD << rounds)
        left, _ = scratch.numbered(lost.select("path", "base", F.col("n").alias("place")), "base", "place")
        waiting, _ = scratch.written(left.join(last, "base").select("path", "base", "n", F.col("last").alias("skipped")), "waiting")
    scratch.dropped(spark, path)
    ids = taken[0]
    for t in taken[1:]:
        ids = ids.unionByName(t)
    return ids.select("path", "page_id"), rounds
