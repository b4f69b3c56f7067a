"""Duplicate pages and contradicting claims, by exact blocking and set-similarity joins instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T
from tessera.operators import pairing, prefixes

# Fixed values
ABBREVIATIONS = (
    ("aws", "amazon web services"),
    ("gcp", "google cloud platform"),
    ("npm", "node package manager"),
    ("api", "application programming interface"),
    ("sdk", "software development kit"),
    ("llm", "large language model"),
    ("ml", "machine learning"),
    ("ai", "artificial intelligence"),
    ("ci/cd", "continuous integration continuous deployment"),
    ("orm", "object relational mapping"),
)
# End of fixed values


def _described(pages: DataFrame) -> DataFrame:
    """id, name, aliases, urls, tags and long words (sorted hashes) of the first row of each id, as a table: the blocks and
    the scores read it by columns."""
    has = lambda c, t: F.col(c) if c in pages.columns else F.lit(None).cast(t)
    name = T.normal_name(F.coalesce("title", F.lit("")))
    short = F.array(*[F.lit(x) for pair in ABBREVIATIONS for x in pair])
    rows = pages.select(
        F.col("page_id").alias("id"),
        name.alias("name"),
        F.coalesce(F.transform(has("aliases", "array<string>"), T.normal_name), F.array().cast("array<string>")).alias("aliases"),
        F.nullif(has("source_url", "string"), F.lit("")).alias("source_url"),
        F.nullif(has("github_url", "string"), F.lit("")).alias("github_url"),
        F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>"))).alias("tags"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.char_length(F.coalesce("body", F.lit(""))).alias("length"),
        F.array_contains(short, name).alias("abbreviation"),
    )
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # else no text need be moved
        first = W.partitionBy("id").orderBy("name", "length")
        rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    long_words = F.array_distinct(F.transform(F.filter(T.words(F.col("body")), lambda w: F.char_length(w) > 2), lambda w: F.xxhash64(w)))
    return scratch.written(rows.withColumn("long_words", F.sort_array(long_words)).withColumn("n_words", F.size("long_words")).drop("body"), "described")[0]


def _cells(d: DataFrame) -> DataFrame:
    """Rows of d, none of them an abbreviation, by what candidates share (pairing.KINDS), in cells: a group of more than pairing.SMALL rows is cut into
    blocks, of which each two meet in one cell; smaller ones are dealt out together. Pairs are made within cells alone, so
    no pair that does not qualify is ever shuffled."""
    none = lambda side: F.lit(side).alias("part")
    key = lambda kind, c, part: d.where(F.coalesce(F.col(c), F.lit("")) != "").select("id", F.lit(kind).alias("kind"), F.col(c).alias("key"), none(part))
    own = [key(c, c, 0) for c in pairing.SYMMETRIC]
    alias = d.select("id", F.lit("alias").alias("kind"), F.explode(F.array_distinct("aliases")).alias("key"), none(0)).where("key != ''")
    own += [alias, key("alias", "name", 1)]
    rows = own[0]
    for x in own[1:]:
        rows = rows.unionByName(x)
    rows = rows.where("id is not null")
    n = rows.groupBy("kind", "key").agg(*[F.count_if(F.col("part") == p).alias(f"n{p}") for p in (0, 1)])
    two = F.col("kind").isin(*pairing.SYMMETRIC)
    n = scratch.written(n.where((two & (F.col("n0") > 1)) | (F.col("n0") > 0) & (F.col("n1") > 0)), "groups")[0]
    some = n.where(F.col("n0") + F.col("n1") <= pairing.SMALL).agg(F.coalesce(F.sum(F.col("n0") + F.col("n1")), F.lit(0)).alias("n")).first()["n"]
    batches = some // (pairing.BLOCK // 2) + 1
    rows = rows.join(n, ["kind", "key"])
    small = F.col("n0") + F.col("n1") <= pairing.SMALL
    blocks = lambda c: F.when(small, 1).otherwise(F.ceil(F.col(c) / pairing.BLOCK))
    rows = rows.withColumns({"cell": F.when(small, F.pmod(F.xxhash64("key"), F.lit(batches)).cast("string")).otherwise(F.concat(F.lit("="), "key")), "own": F.when(F.col("part") == 0, blocks("n0")).otherwise(blocks("n1"))})
    rows = rows.withColumn("other", F.when(two, F.col("own")).when(F.col("part") == 0, blocks("n1")).otherwise(blocks("n0")))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.col("own"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    left = F.when(two, F.col("p") <= F.col("q")).otherwise(F.col("part") == 0)
    return rows.select("id", "kind", "key", "cell", F.when(left, F.col("p")).otherwise(F.col("q")).alias("i"), F.when(left, F.col("q")).otherwise(F.col("p")).alias("j"), F.when(left, 0).otherwise(1).alias("side"), (two & (F.col("p") == F.col("q"))).alias("same"))


def _abbreviated(d: DataFrame, min_score: float, alone: float, schema: str) -> DataFrame:
    """The pairs of d that have an abbreviation: blocks of such rows against all rows, a scan each, so that no row of d is
    shuffled or repeated. alone: the least score of a pair that shares nothing but the abbreviation."""
    d = d.where("id is not null")
    short = d.where("abbreviation")
    rows, words = short.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    blocks = max(-(-rows // pairing.BLOCK), -(-words // pairing.ROUND_WORDS))
    out = d.limit(0).mapInPandas(lambda batches: iter(()), schema)
    for i in range(blocks):
        own = short.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()  # a block of bounded size
        held = d.sparkSession.sparkContext.broadcast(own)

        def run(batches, held=held):
            a = held.value.to_pandas()
            for b in batches:
                for part in pairing.cut(b):
                    yield pairing.compared(a, part, "abbreviation", False, min_score, alone)

        out = d.mapInPandas(run, schema) if i == 0 else out.unionByName(d.mapInPandas(run, schema))
    return out


def duplicates(pages: DataFrame, min_score: float = 0.3, exclude_kinds: tuple[str, ...] = ("source",), backlinks: DataFrame | None = None, domains: tuple[str, ...] | None = None, products: bool = True, marked: bool = False, abbreviated: bool = False) -> DataFrame:
    """id_1 < id_2, score, action, band, primary_id. score: 0.4 equal names + 0.3 alias + 0.2 equal url + 0.1 three tags
    in common + 0.1 * Jaccard of words of over two letters, from 0.3 on.

    For min_score above 0.2 every pair shares a name, an alias or a url, or one name is a known abbreviation; so candidates
    come from groups of rows that share one, compared block by block, and abbreviations are compared with every page; only
    at 0.3 itself do they make a pair with each, unless products is false: then pairs that have nothing but an abbreviation
    are left to duplicate_classes(). domains: those whose pages are compared; all by default. marked: with short_1, short_2,
    whether a name is a known abbreviation. abbreviated: only the pairs that have one, which is all that
    duplicate_classes() reads.
    """
    if min_score <= 0.2:
        raise ValueError("at 0.2 or less every pair of pages is a candidate")
    rows = pages.where(~F.coalesce("kind", F.lit("page")).isin(*exclude_kinds))
    rows = rows if domains is None else rows.where(F.col("domain").isin(*domains))
    d = _described(rows)
    kind = d.schema["id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, a_length int, b_length int, a_short boolean, b_short boolean, score double"
    # a pair that has an abbreviation alone scores more than 0.3 only by its words or tags
    out = _abbreviated(d, min_score, min_score if products else max(min_score, 0.3 + 1e-9), schema)
    if not abbreviated:
        rest = d.where("not abbreviation")
        held = _cells(rest).join(rest, "id").repartition("kind", "cell", "i", "j")
        out = held.groupBy("kind", "cell", "i", "j").applyInPandas(lambda cell: pairing.scored(cell, min_score), schema).unionByName(out)
    if backlinks is not None:  # id, n_backlinks
        for s in "ab":
            out = out.join(backlinks.select(F.col("id").alias(s), F.col("n_backlinks").alias(f"{s}_links")), s, "left")
    rank = lambda s: F.struct(-(F.coalesce(F.col(f"{s}_links"), F.lit(0)) if backlinks is not None else F.lit(0)), -F.col(f"{s}_length"), F.col(s))
    return out.select(
        F.col("a").alias("id_1"),
        F.col("b").alias("id_2"),
        "score",
        F.when(F.col("score") > 0.8, "merge").when(F.col("score") >= 0.5, "redirect").otherwise("keep_both").alias("action"),
        F.when(F.col("score") > 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low").alias("band"),
        F.when(rank("a") <= rank("b"), F.col("a")).otherwise(F.col("b")).alias("primary_id"),
        *([F.col("a_short").alias("short_1"), F.col("b_short").alias("short_2")] if marked else []),
    )


def duplicate_classes(pages: DataFrame, pairs: DataFrame, exclude_kinds: tuple[str, ...] = ("source",)) -> DataFrame:
    """id, score, n_pairs: the pages whose name is a known abbreviation, each of which makes a pair of score 0.3 with every
    page that it has no pair of `pairs` (duplicates(products=False)) with. A row stands for n_pairs pairs, of two
    abbreviations with the lesser id; abbreviation_pairs() writes them out."""
    d = pages.where(~F.coalesce("kind", F.lit("page")).isin(*exclude_kinds)).select(F.col("page_id").alias("id"), T.normal_name(F.coalesce("title", F.lit(""))).alias("name")).groupBy("id").agg(F.min("name").alias("name"))
    known = F.col("name").isin(*[x for pair in ABBREVIATIONS for x in pair])
    total = d.count()
    short = d.where(known).select("id")
    # of two abbreviations the greater id leaves the pair to the lesser one
    place = scratch.numbered(short.withColumn("k", F.lit(0)), "k", "id")[0].select("id", "n")
    if "short_1" not in pairs.columns:
        for i in "12":
            pairs = pairs.join(short.select(F.col("id").alias(f"id_{i}"), F.lit(True).alias(f"short_{i}")), f"id_{i}", "left")
    one = F.when(F.coalesce("short_1", F.lit(False)), F.col("id_1")).when(F.col("short_2"), F.col("id_2"))
    taken = pairs.select(one.alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("taken"))
    n = F.lit(total) - F.col("n") - F.coalesce("taken", F.lit(0))
    return place.join(taken, "id", "left").select("id", F.lit(0.3).alias("score"), n.alias("n_pairs"))


def abbreviation_pairs(pages: DataFrame, classes: DataFrame, pairs: DataFrame, of: list, exclude_kinds: tuple[str, ...] = ("source",)) -> DataFrame:
    """id_1, id_2: the pairs that the classes of the ids `of` stand for."""
    d = pages.where(~F.coalesce("kind", F.lit("page")).isin(*exclude_kinds)).select(F.col("page_id").alias("other")).distinct()
    ids = classes.where(F.col("id").isin(of)).select("id")
    all_ids = classes.select(F.col("id").alias("other"), F.lit(1).alias("both"))
    met = d.join(all_ids, "other", "left").join(F.broadcast(ids), F.col("other") != F.col("id")).where("both is null or id < other")  # the ids that were asked for
    found = met.select(F.least("id", "other").alias("id_1"), F.greatest("id", "other").alias("id_2"))
    return found.join(pairs.select("id_1", "id_2"), ["id_1", "id_2"], "left_anti")


def merged(keep: DataFrame, gone: DataFrame) -> DataFrame:
    """keep and gone share `pair`: one row each. Bodies are appended, tags united."""
    g = gone.select("pair", F.col("page_id").alias("g_id"), F.col("title").alias("g_title"), F.col("tags").alias("g_tags"), F.col("body").alias("g_body"))
    return keep.join(g, "pair").select(
        "page_id",
        "title",
        F.sort_array(F.array_union("tags", "g_tags")).alias("tags"),
        F.concat(F.rtrim("body"), F.lit("\n\n## Content from "), F.coalesce("g_title", F.col("g_id").cast("string")), F.lit("\n\n"), F.trim("g_body")).alias("body"),
    )


def merge_duplicates(pages: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """pairs: primary_id, secondary_id, each page in one pair at most. The tables after the merge: `pages` (primaries with the
    secondary's content and tags, secondaries gone, links of all pages to them rewritten), `redirects` (redirect_from,
    redirect_to, domain, body) and `archive` (the secondaries' rows as they were)."""
    p = pairs.select(F.col("primary_id").alias("__p"), F.col("secondary_id").alias("__s"))
    keep = pages.join(p, F.col("page_id") == F.col("__p")).withColumn("pair", F.col("__p"))
    archive = pages.join(p, F.col("page_id") == F.col("__s"), "left_semi")
    gone = pages.join(p, F.col("page_id") == F.col("__s")).withColumn("pair", F.col("__p"))
    joined = merged(keep.select("pair", *pages.columns), gone.select("pair", *pages.columns)).select("page_id", F.col("tags").alias("__tags"), F.col("body").alias("__body"))
    rest = pages.join(p.select(F.col("__s").alias("page_id")), "page_id", "left_anti").join(joined, "page_id", "left")
    rest = rest.withColumns({"tags": F.coalesce("__tags", "tags"), "body": F.coalesce("__body", "body")}).select(pages.columns)
    # each body is rewritten once, by the secondaries that it links to
    text = F.col("page_id").cast("string")
    to = p.select(F.col("__s").cast("string").alias("dst"), F.col("__p").cast("string").alias("to"))
    hit = rest.select(text.alias("__id"), F.explode(F.array_distinct(T.links(F.coalesce("body", F.lit(""))))).alias("dst")).join(to, "dst")
    by_page = hit.groupBy("__id").agg(F.sort_array(F.collect_set(F.struct("dst", "to"))).alias("__to"))  # at most the links of one body
    body = F.aggregate("__to", F.col("body"), lambda b, x: rewritten_links(b, x["dst"], x["to"]))
    out = rest.withColumn("__id", text).join(by_page, "__id", "left").withColumn("body", F.when(F.col("__to").isNull(), F.col("body")).otherwise(body))
    note = F.concat(F.lit("# Redirect\n\nThis page has been merged into [["), F.col("redirect_to").cast("string"), F.lit("]].\n"))
    redirects = gone.select(F.col("__s").alias("redirect_from"), F.col("__p").alias("redirect_to"), "domain").withColumn("body", note)
    return {"pages": out.select(pages.columns), "redirects": redirects, "archive": archive}


def rewritten_links(body, old, new):
    """[[old]] and [[old|text]] point to new."""
    return F.replace(F.replace(body, F.concat(F.lit("[["), old, F.lit("]]")), F.concat(F.lit("[["), new, F.lit("]]"))), F.concat(F.lit("[["), old, F.lit("|")), F.concat(F.lit("[["), new, F.lit("|")))


def similar_pairs(left: DataFrame, right: DataFrame, above: float) -> DataFrame:
    """left, right: id and words (a set) -> a, b, similarity over a Jaccard threshold. Equal sets are one class, so repeats
    meet no more than one set does; ids are joined to the classes' pairs last. A class's words are put in order of falling
    rarity; sets that reach the threshold share a word of their first n - ceil(above * n) + 1, so only those join."""
    named = lambda df: df.select("id", F.array_sort("words").alias("words")).withColumn("c", F.sha1(F.array_join("words", "\x1f")))
    l, r = named(left), named(right)
    classes = lambda df: df.groupBy("c").agg(F.first("words").alias("words"))
    lc, rc = classes(l), classes(r)
    rank = lc.unionByName(rc).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def prefix(df, name):
        x = df.select("c", F.size("words").alias("n"), F.explode("words").alias("w")).join(rank, "w")
        place = F.row_number().over(W.partitionBy("c").orderBy("f", "w"))
        return x.withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(above * F.col("n") - 1e-9) + 1).select(F.col("c").alias(name), "w", F.col("n").alias(f"n_{name}"))

    pairs = prefix(lc, "ca").join(prefix(rc, "cb"), "w").where(f"n_ca >= {above} * n_cb - 1e-9 and n_cb >= {above} * n_ca - 1e-9").select("ca", "cb").distinct()
    sets = lambda df, name, w: df.select(F.col("c").alias(name), F.col("words").alias(w))
    found = pairs.join(sets(lc, "ca", "wa"), "ca").join(sets(rc, "cb", "wb"), "cb").withColumn("similarity", T.jaccard(F.col("wa"), F.col("wb")))
    found = found.where(F.col("similarity") > above).select("ca", "cb", "similarity")
    ids = lambda df, name, c: df.select(F.col("id").alias(name), F.col("c").alias(c))
    return found.join(ids(l, "a", "ca"), "ca").join(ids(r, "b", "cb"), "cb").select("a", "b", "similarity")


def _paired(found: DataFrame, kind, confidence, sev) -> DataFrame:
    """(a, b, ...) of claim ids in either order -> page and claim numbers, the earlier claim first."""
    first, second = F.least("a", "b"), F.greatest("a", "b")
    return found.where("a.page_id != b.page_id").select(
        first["page_id"].alias("page_1"), first["claim_no"].alias("claim_1"), second["page_id"].alias("page_2"), second["claim_no"].alias("claim_2"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), confidence.alias("confidence"), sev.alias("severity"),
    )


def number_gaps(c: DataFrame) -> DataFrame:
    """c: masked, numbers -> masked, numbers, other, gap: the distinct number lists of a masked text that share no number,
    each pair once."""
    lists = c.select("masked", "numbers").distinct()
    pairs = lists.join(lists.select("masked", F.col("numbers").alias("other")), "masked").where("numbers < other")
    gap = F.array_min(F.flatten(F.transform("numbers", lambda x: F.transform("other", lambda y: F.abs(x - y)))))
    return pairs.withColumn("gap", gap).where("gap > 0")


def numeric_contradictions(claims: DataFrame) -> DataFrame:
    """Claims of two pages that differ in numbers alone: an equi-join on the text with its numbers masked, of distinct
    number lists first, so that repeated claims meet no more than others; then the claims of those lists."""
    return _numeric(claims.select("page_id", "claim_no", T.numbers(F.col("text")).alias("numbers"), T.masked_numbers(F.col("text")).alias("masked")))


def _numeric(features: DataFrame) -> DataFrame:
    c = features.where(F.size("numbers") > 0).select(F.struct("page_id", "claim_no").alias("a"), "masked", "numbers")
    found = number_gaps(c).join(c, ["masked", "numbers"]).join(c.select(F.col("a").alias("b"), "masked", F.col("numbers").alias("other")), ["masked", "other"])
    return _paired(found, "numerical", F.lit(0.85), F.when(F.col("gap") > 10, "high").otherwise("medium"))


#: What the words of two claims must be alike above, by the detector.
ALIKE = {"negation": 0.75, "temporal": 0.7}
#: Classes of one side that meet in one task for a shared word.
CELL = 1000


def _digest(words):
    return F.unhex(F.sha1(F.array_join(F.transform(words, lambda x: x.cast("string")), " ")))


def claim_features(claims: DataFrame) -> DataFrame:
    """page_id, claim_no, sides, numbers, masked: what all detectors read of a claim. A side is (kind, role, c, words): the
    detector (of times, one for each pair of opposite words), which of its two sides the claim stands on, and the claim's
    other words as sorted hashes, with their digest as their class. inline() keeps each step's columns in one place: merged
    projections would match the patterns once for each use."""
    text, low = F.col("text"), F.col("low")
    held = claims.select("page_id", "claim_no", "text", F.inline(F.array(F.struct(F.lower("text").alias("low"), T.negated(text).alias("no"), T.temporal(text).alias("at_time")))))
    kept = F.array_distinct(T.words(F.when(F.col("no"), T.without_negation(low)).otherwise(low)))
    timed = F.when(F.col("at_time"), F.array_distinct(T.words(T.without_temporal(low))))
    held = held.select("page_id", "claim_no", "text", "low", "no", F.inline(F.array(F.struct(kept.alias("n"), timed.alias("t")))))
    hashed = lambda c: F.sort_array(F.transform(c, lambda x: F.xxhash64(x)))
    held = held.select("page_id", "claim_no", "text", "low", "no", F.inline(F.array(F.struct(hashed("n").alias("n"), hashed("t").alias("t")))))
    marked = lambda c: F.struct(_digest(c).alias("c"), F.col(c).alias("words"))
    held = held.select("page_id", "claim_no", "text", "low", "no", F.inline(F.array(F.struct(marked("n").alias("n"), F.when(F.col("t").isNotNull(), marked("t")).alias("t")))))
    side = lambda kind, role, w: F.struct(F.lit(kind).alias("kind"), role.alias("role"), w["c"].alias("c"), w["words"].alias("words"))
    sides = [side("negation", F.when(F.col("no"), 0).otherwise(1), F.col("n"))]
    for i, pair in enumerate(T.OPPOSITE):
        sides += [F.when(F.col("t").isNotNull() & F.contains(low, F.lit(w)), side(f"temporal{i}", F.lit(role), F.col("t"))) for role, w in enumerate(pair)]
    return held.select("page_id", "claim_no", F.array_compact(F.array(*sides)).alias("sides"), T.numbers(text).alias("numbers"), T.masked_numbers(text).alias("masked"))


#: Classes or texts that are broadcast to find their rows again; more are joined.
MOST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids as a table, which is broadcast if it is no larger than MOST_IDS."""
    held, _ = scratch.written(ids, "ids")
    return F.broadcast(held) if held.count() <= MOST_IDS else held


def alike_classes(classes: DataFrame, above=None, same: bool = False) -> DataFrame:
    """classes: kind, role, c, words (rows of a class may repeat) -> kind, ca, cb, similarity of classes of the two sides of
    a kind that are alike above its threshold; same: of one side, each pair once. Words that can make no pair, since the
    other side has none, come first in the order, then those of few pairs: sets that reach a threshold share one of their
    first n - ceil(threshold * n) + 1, at places that leave enough words behind them. So a class of too many words without
    a pair is dropped before any other word of it is looked at. A prefix is taken where its class lies; a row of it is one
    word and a map of the whole set in 64 bits, which bounds what two sets can share, so the sets themselves move only for
    the pairs that are left, to be compared. Words of many sets are cut into cells of CELL sets a side."""
    above = F.when(F.col("kind") == "negation", ALIKE["negation"]).otherwise(ALIKE["temporal"]) if above is None else F.lit(above)
    salt = F.xxhash64("kind")
    classes = classes.where(F.size("words") > 0).select("kind", "role", "c", "words")
    of = lambda role, f: classes.where(F.col("role") == role).select(salt.alias("salt"), F.explode("words").alias("w")).select(F.col("w").bitwiseXOR(F.col("salt")).alias("w")).groupBy("w").agg(F.count("*").alias(f))
    rank = of(0, "f").where("f > 1") if same else of(0, "f").join(of(1, "g"), "w").select("w", (F.col("f") * F.col("g")).alias("f"))
    rank, _ = scratch.written(rank, "words")
    known = rank.sparkSession.sparkContext.broadcast(prefixes.ranked(rank))
    h = F.xxhash64("kind", "c").alias("h")
    rows = classes.select(h.alias("c"), "role", above.cast("double").alias("above"), salt.alias("salt"), "words")
    prefix, _ = scratch.written(rows.mapInArrow(prefixes.taken(known), prefixes.SCHEMA), "prefix")

    blocks = lambda r: F.ceil(F.count_if(F.col("role") == r) / CELL)
    many = prefix.groupBy("w").agg(blocks(0).alias("s0"), blocks(0 if same else 1).alias("s1")).where("s0 > 1 or s1 > 1")  # of CELL rows each
    held = prefix.join(F.broadcast(many), "w", "left").withColumns({f"s{i}": F.greatest(F.lit(1), F.coalesce(F.col(f"s{i}"), F.lit(1))) for i in (0, 1)})
    first = F.col("role") == 0
    own, other = F.when(first, F.col("s0")).otherwise(F.col("s1")), F.when(first, F.col("s1")).otherwise(F.col("s0"))
    held = held.withColumn("p", F.pmod("c", own)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    low = F.col("p") <= F.col("q") if same else first
    side = F.when(F.col("p") == F.col("q"), 2).when(low, 0).otherwise(1) if same else F.col("role")
    cell = F.when(low, F.col("p") * F.col("s1") + F.col("q")).otherwise(F.col("q") * F.col("s1") + F.col("p"))
    dealt = held.select("w", cell.alias("cell"), side.alias("role"), "c", "above", "n", "k", "at", "bits").repartition("w", "cell").distinct()
    named = lambda i: dealt.select("w", "cell", *[F.col(x).alias(f"{x}{i}") for x in ("role", "c", "above", "n", "k", "at", "bits")])
    share, n0, n1 = F.col("above0"), F.col("n0"), F.col("n1")
    left = F.least(F.col("k0") - F.col("at0"), F.col("k1") - F.col("at1"))  # words that may be shared, this one included
    # not an equality: as a key of the join it would have both sides dealt anew; on both sides, they are one exchange
    met = named(0).join(named(1), ["w", "cell"]).where("above0 <= above1 and above0 >= above1").where("c0 < c1 and (role0 = 2 or role0 != role1)" if same else "role0 = 0 and role1 = 1")
    met = met.where((n0 >= share * n1 - 1e-9) & (n1 >= share * n0 - 1e-9) & (left >= share / (1 + share) * (n0 + n1) - 1e-9))
    met = met.where(F.bit_count(F.col("bits0").bitwiseXOR(F.col("bits1"))) <= (1 - share) / (1 + share) * (n0 + n1) + 1e-9)
    pairs, _ = scratch.written(met.select(F.col("c0").alias("h0"), F.col("c1").alias("h1")).distinct(), "met")

    ids = pairs.select(F.explode(F.array("h0", "h1")).alias("h")).distinct()
    sets, _ = scratch.written(classes.withColumn("h", h).join(few(ids), "h", "left_semi").groupBy("h", "kind", "role", "c").agg(F.first("words").alias("words")), "sets")
    of = lambda role, i: sets.where(F.col("role") == role).select(F.col("h").alias(f"h{i}"), F.col("kind").alias(f"kind{i}"), F.col("c").alias(f"c{i}"), F.col("words").alias(f"words{i}"))
    met = pairs.join(of(0, 0), "h0").join(of(0 if same else 1, 1), "h1").where("kind0 = kind1")
    shared = F.size(F.array_intersect("words0", "words1"))
    found = met.select(F.col("kind0").alias("kind"), F.col("c0").alias("ca"), F.col("c1").alias("cb"), F.inline(F.array(F.struct(shared.alias("both"), (F.size("words0") + F.size("words1")).alias("sum")))))
    return found.select("kind", "ca", "cb", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity")).where(F.col("similarity") > above)


def _text_words(texts: DataFrame) -> DataFrame:
    """text, c, words: a text's words as sorted hashes, and their digest, its class. Texts without words are left out."""
    words = F.sort_array(F.transform(F.array_distinct(T.words(F.col("text"))), lambda w: F.xxhash64(w)))
    return texts.select("text", F.inline(F.array(F.struct(words.alias("words"))))).where(F.size("words") > 0).withColumn("c", _digest("words"))


def alike_texts(texts: DataFrame, above: float) -> DataFrame:
    """text (rows may repeat) -> left < right: texts whose words are alike above a threshold, each pair once. Texts of equal
    words are a class. Only texts that have a partner are moved."""
    held = _text_words(texts.select("text"))
    classes = held.select(F.lit("text").alias("kind"), F.lit(0).alias("role"), "c", "words")
    found, _ = scratch.written(alike_classes(classes, above, same=True).select("ca", "cb"), "found")
    ids = found.select(F.explode(F.array("ca", "cb")).alias("c"))
    if above < 1:
        t = F.xxhash64("text")
        ids = ids.unionByName(held.groupBy("c").agg(F.min(t).alias("t"), F.max(t).alias("u")).where("t < u").select("c"))
    some, _ = scratch.written(held.join(few(ids.distinct()), "c", "left_semi").select("c", "text").distinct(), "texts")
    side = lambda name, c: some.select(F.col("text").alias(name), F.col("c").alias(c))
    pairs = found.join(side("x", "ca"), "ca").join(side("y", "cb"), "cb").select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))
    own = side("left", "c").join(side("right", "c"), "c").where("left < right").select("left", "right")
    return pairs.unionByName(own) if above < 1 else pairs


#: Members of a group that lie in one cell when pairs of groups are written out.
MEMBERS = 1000


def members(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs: x, y (keys of groups) and more -> a, b and more, for each member a of x and b of y. of: key, id. What is moved
    are the members of the smaller group of each pair, to cells of MEMBERS members of the larger one; the pairs of members
    are made there and not moved."""
    n = of.groupBy("key").agg(F.count("*").alias("n"))
    sized = pairs.join(n.select(F.col("key").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("key").alias("y"), F.col("n").alias("ny")), "y")
    more = [c for c in pairs.columns if c not in ("x", "y")]
    turned = F.col("nx") > F.col("ny")
    sized = sized.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("s"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("key"), F.ceil(F.greatest("nx", "ny") / MEMBERS).alias("cells"), turned.alias("turned"), *more)
    small = sized.join(of.select(F.col("key").alias("s"), F.col("id").alias("i")), "s").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    large = of.join(n, "key").select("key", F.col("id").alias("j"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)).alias("cell"))
    met = small.select("key", "cell", "i", "turned", *more).join(large.repartition("key", "cell"), ["key", "cell"])
    return met.select(F.when(F.col("turned"), F.col("j")).otherwise(F.col("i")).alias("a"), F.when(F.col("turned"), F.col("i")).otherwise(F.col("j")).alias("b"), *more)


def _opposed(features: DataFrame, kinds: str) -> DataFrame:
    """Contradictions of the detectors whose name begins with `kinds`, of claim_features()."""
    sides = features.select(F.struct("page_id", "claim_no").alias("id"), F.inline("sides")).where(F.startswith("kind", F.lit(kinds)))
    side = lambda role, name, c: sides.where(F.col("role") == role).select("kind", F.col("id").alias(name), F.col("c").alias(c))
    found = alike_classes(sides.select("kind", "role", "c", "words")).join(side(0, "a", "ca"), ["ca", "kind"]).join(side(1, "b", "cb"), ["cb", "kind"])
    neg = F.col("kind") == "negation"
    raw = F.when(neg, 0.7 + F.col("similarity") * 0.25).otherwise(0.75 + F.col("similarity") * 0.15)
    kind = F.when(neg, "negation").otherwise("temporal")
    return _paired(found, kind, F.least(F.lit(0.95), raw), T.severity(raw)).distinct()


def negation_contradictions(claims: DataFrame) -> DataFrame:
    """A negated and a plain claim whose words, without negations, are alike to more than 0.75."""
    return _opposed(claim_features(claims), "negation")


def temporal_contradictions(claims: DataFrame) -> DataFrame:
    """Claims with opposite words of time whose other words are alike to more than 0.7."""
    return _opposed(claim_features(claims), "temporal")


CASCADE = ("negation", "temporal", "numerical", "semantic")


def contradictions(claims: DataFrame, semantic=None) -> DataFrame:
    """One row per contradicting pair of claims, by the first detector that finds it. semantic: a function of claims that
    returns rows of the same columns (a model's verdicts); none by default."""
    features, _ = scratch.written(claim_features(claims), "claims")  # claims are read once
    found = _opposed(features, "").unionByName(_numeric(features))
    if semantic is not None:
        found = found.unionByName(semantic(claims))
    order = F.array_position(F.array(*[F.lit(k) for k in CASCADE]), F.col("kind"))
    best = F.min_by(F.struct("kind", "confidence", "severity"), order).alias("x")
    return found.groupBy("page_1", "claim_1", "page_2", "claim_2").agg(best).select("page_1", "claim_1", "page_2", "claim_2", "x.*")


def contradiction_report(found: DataFrame) -> DataFrame:
    """kind, band (0.8 and 0.65 of confidence), n."""
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.65, "medium").otherwise("low")
    return found.groupBy("kind", band.alias("band")).agg(F.count("*").alias("n"))


def auto_merges(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs that may be merged without review."""
    return pairs.where((F.col("band") == "high") & (F.col("score") >= least))


# promotion as changes of the pages table ------------------------------------------------------------------------------
SHARED = "shared"


def promoted(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """pages: page_id, domain, kind, title, body, ... with the pages of `chosen` (page_id, a string) moved to the shared
    domain, a tombstone left in each one's place, and links of other pages to them pointing to shared/<id>. Each body is
    rewritten once, by the chosen ids that it links to. A promoted page's own links, but those to itself, point to shared/
    as well. Pages that are shared already are left as they are."""
    here = pages.where(F.col("domain") != SHARED).select(F.col("page_id").cast("string").alias("page_id"))
    chosen = chosen.select(F.col("page_id").cast("string").alias("page_id")).join(here, "page_id", "left_semi")
    gone = chosen.select(F.col("page_id").cast("string").alias("dst")).distinct()
    text = pages.withColumn("__id", F.col("page_id").cast("string"))
    hit = text.select("__id", F.explode(F.array_distinct(T.links(F.coalesce("body", F.lit(""))))).alias("dst")).join(gone, "dst").where("__id != dst")
    by_page = hit.groupBy("__id").agg(F.sort_array(F.collect_set("dst")).alias("__to"))  # at most the links of one body
    out = text.join(by_page, "__id", "left").join(gone.withColumn("__gone", F.lit(True)), F.col("__id") == F.col("dst"), "left").drop("dst")

    def linked(body, to):
        return F.regexp_replace(body, F.concat(F.lit(r"\[\[(\Q"), to, F.lit(r"\E)(?:\|[^\]]+)?\]\]")), F.lit("[[shared/$1]]"))

    body = F.when(F.col("__to").isNull(), F.col("body")).otherwise(F.aggregate("__to", F.col("body"), linked))
    others = F.concat(F.lit(r"\[\[(?!shared/)(?!\Q"), "__id", F.lit(r"\E[|\]])([^|\]]+)(?:\|[^\]]+)?\]\]"))
    moved = out.where("__gone").withColumns({"domain": F.lit(SHARED), "body": F.regexp_replace(body, others, F.lit("[[shared/$1]]"))})
    stone = out.where("__gone").withColumns({"kind": F.lit("tombstone"), "body": F.concat(F.lit("Moved to [[shared/"), "__id", F.lit("]]\n"))})
    rest = out.where("__gone is null").withColumn("body", body)
    return rest.unionByName(moved).unionByName(stone).select(pages.columns)


def unpromoted(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The inverse: pages of `chosen` go back to the domains that their tombstones stand in, tombstones go, and links to
    shared/<id> point to <id>; a page that goes back keeps links to shared/ only for pages that stay there."""
    text_id = F.col("page_id").cast("string")
    back = chosen.select(text_id.alias("dst")).distinct()
    stones = pages.where("kind = 'tombstone'").join(back, text_id == F.col("dst")).select("dst", F.col("domain").alias("__home"))
    text = pages.withColumn("__id", text_id)
    text = text.join(stones.withColumnRenamed("dst", "__dst"), F.col("__id") == F.col("__dst"), "left").where("__home is null or kind != 'tombstone'")
    hit = text.select("__id", "__home", F.explode(F.array_distinct(T.links(F.coalesce("body", F.lit(""))))).alias("dst")).where("dst like 'shared/%'").withColumn("dst", F.expr("substring(dst, 8)"))
    stay = pages.where((F.col("domain") == SHARED) & (F.col("kind") != "tombstone")).select(text_id.alias("dst")).join(stones.select("dst"), "dst", "left_anti")
    own = hit.where("__home is not null").join(stay, "dst", "left_anti")
    hit = hit.where("__home is null").join(stones.select("dst"), "dst", "left_semi").unionByName(own)
    by_page = hit.groupBy("__id").agg(F.sort_array(F.collect_set("dst")).alias("__to"))
    out = text.join(by_page, "__id", "left")
    undo = lambda b, to: F.replace(b, F.concat(F.lit("[[shared/"), to, F.lit("]]")), F.concat(F.lit("[["), to, F.lit("]]")))
    body = F.when(F.col("__to").isNull(), F.col("body")).otherwise(F.aggregate("__to", F.col("body"), undo))
    return out.withColumns({"domain": F.coalesce("__home", "domain"), "body": body}).select(pages.columns)
