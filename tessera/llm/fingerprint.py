"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles (five lower-cased words; a shorter text is one
shingle; a text without words has none). Sketches of parts merge into the sketch of the whole: the k smallest of
their union. From sketches alone come resemblance, containment and the number of distinct shingles; all three are
exact while the sets have at most k shingles.

Defined cases: null text counts as empty; very long texts are read whole; two empty sketches resemble each other fully
(1.0); rows with one doc_id are put in order by their text's hash, then the text; null ids come first; an empty table
gives an empty result; a table of one row is its own next document; ids must be whole numbers (else TypeError); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import whole_numbers

K = 128
WIDTH = 5
#: Rows that a range of ids holds, and the most ranges.
ROWS, RANGES = 250, 40_000
SPACE = r"[ \t-\r]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), SPACE), ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int = WIDTH) -> Column:
    """Hashes of each `width` words in a row; of all words where there are fewer."""
    n = F.size(hashes)
    at = F.sequence(F.lit(0), n - width)
    full = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    return F.when(n >= width, full).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text_col: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of a text column. The word hashes are a step of their own, so they are made once."""
    held = f"{name}__words"
    return (
        df.withColumn(held, word_hashes(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn(name, bottom(shingles(F.col(held), width), k))
        .drop(held)
    )


def merged(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """The sketch of each key's union. A key may hold any number of rows: each task keeps its k smallest hashes of a
    key before the shuffle (the rank filter is pushed below it), so no group is gathered."""
    hashes = df.select(key, F.explode(sketch).alias("h")).distinct()
    least = hashes.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches' sets."""
    union = bottom(F.concat(a, b), k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's count over a's count."""
    got = resemblance(a, b, k) * distinct_count(bottom(F.concat(a, b), k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), got))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def range_of(df: DataFrame, id_col: str, text_col: str, rows: int = ROWS, most: int = RANGES) -> Column:
    """A row's range of ids, as (range, part) in order; ranges hold about `rows` rows each, or the rows over `most`. The
    bounds are approximate quantiles (one list, found without a shuffle of rows), held in two levels so that a row meets
    about 2 * sqrt(ranges). An id that many rows have, and null ids, are cut into parts by the hash of the text."""
    stats = df.agg(F.count("*").alias("n"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    ranges = int(min(most, max(1, stats["n"] // rows)))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(id_col, shares, max(10_000, 10 * ranges)).alias("b")).first()["b"] if shares else None
    times: dict[int, int] = {}
    for b in found or []:
        times[b] = times.get(b, 0) + 1
    bounds = sorted(times)
    share = F.xxhash64(text_col).cast("double") / 2.0**64 + 0.5
    part = lambda n: F.least(F.floor(share * n), n - 1).cast("int")
    none = F.struct(F.lit(-1).alias("range"), part(F.lit(max(1, round(stats["nulls"] * ranges / max(1, stats["n"]))))).alias("part"))
    if not bounds:
        return F.when(F.col(id_col).isNull(), none).otherwise(F.struct(F.lit(0).alias("range"), F.lit(0).alias("part")))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda values, mark: f"array({', '.join(f'{v}{mark}' for v in values)})"
    nested = lambda lists, mark: F.expr(f"array({', '.join(array(x, mark) for x in lists)})")
    heads, below = F.expr(array((g[0] for g in groups), "L")), nested(groups, "L")
    g = F.size(F.filter(heads, lambda b: b <= F.col(id_col))) - 1
    inside = F.size(F.filter(F.get(below, g), lambda b: b <= F.col(id_col)))
    at = F.when(g < 0, 0).otherwise(g * step + inside)  # bounds at or below the id
    last = F.get(F.get(below, g), inside - 1)
    repeats = F.get(F.get(nested([[times[b] for b in x] for x in groups], ""), g), inside - 1)
    own = F.when((last == F.col(id_col)) & (repeats > 1), part(repeats)).when((last != F.col(id_col)) & (repeats > 1), repeats)
    return F.when(F.col(id_col).isNull(), none).otherwise(F.struct(at.alias("range"), F.coalesce(own, F.lit(0)).cast("int").alias("part")))


def with_next(df: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """df with `next_<column>` of the text and of the carried columns of the row that follows by id (after the last: the
    first). Rows are dealt into ranges of ids, so no task orders the whole table; only the first text of each range is
    looked up across ranges, and that join needs no second shuffle of the rows. Carried columns of a range's last row are
    null: they are to be made of the next text."""
    place = range_of(df, id_col, text_col)
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.col(text_col)]
    rows = df.withColumn("__range", place).withColumn("__next", F.lead(F.struct(text_col, *carried)).over(W.partitionBy("__range").orderBy(*order)))
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    placed = df.select(id_col, text_col).withColumn("__range", place)
    least = placed.select("__range", key.alias("k")).groupBy("__range").agg(F.min("k").alias("k"))
    least = F.broadcast(least.select("__range", F.col("k.id").alias("__id"), F.col("k.hash").alias("__hash")))  # a row per range, so RANGES and a few
    heads = placed.join(least, "__range").where(F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")))
    firsts = heads.groupBy("__range").agg(F.min(text_col).alias("__first"))
    along = W.orderBy("__range")  # a row per range
    every = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow = firsts.select("__range", F.coalesce(F.lead("__first").over(along), F.first("__first").over(every)).alias("__after"))
    return rows.join(follow, "__range").select(
        *df.columns, F.coalesce(F.col("__next")[text_col], "__after").alias(f"next_{text_col}"), *[F.col("__next")[c].alias(f"next_{c}") for c in carried]
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, text, and its sketch."""
    return with_sketch(whole_numbers(docs, id_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sketch", k, width)


def digest(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike sketches find them."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    paired = with_next(fingerprint(docs, k=k), "doc_id", "text", ["sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    paired = paired.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    # the next sketch has been made, but for the last row of a range
    paired = paired.withColumn("after", F.when(F.col("next_sketch").isNull(), F.col("next_text")))
    both = with_sketch(with_sketch(paired, "after", "after_sketch", k).drop("text", "next_text", "after"), "edited", "edited_sketch", k)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", "after_sketch"), k).alias("near_next"),
    )
