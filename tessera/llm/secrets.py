"""Secret scans: patterns, and a battery of randomness tests under false-discovery control. DataFrame functions only.

Base kinds (assign, access, hex) are found leftmost and non-overlapping per kind and always kept. The method adds
`random` spans: runs of 20 or more encoding symbols whose encoding is inferred from their symbols (hex, base32, base36,
base64, letters of one case, letters of both). Each is held against one hypothesis, that it is ordinary writing: words,
names and numbers run together. Three tests tell writing from random symbols, each as a deviate whose mean and spread
ordinary writing sets (WRITING):

* uniformity: the chi-squared statistic of the alphabet's symbol counts, and of its rare and common letters as two cells;
* runs: how often neighbours are of different classes (case, digits, signs; vowels where there are letters of one case);
* serial correlation of neighbouring symbols' indices, at lag 1.

Their sum over its spread in ordinary writing is one deviate, its upper normal tail (by a bound from above) one p-value.
No token is set aside before: the Benjamini-Hochberg step-up at level `q` counts every token that has an encoding, its
p-value weighted by its bits (length times bits a symbol, mean one over the corpus), so that long tokens, which the tests
tell apart best, need less. The step-up needs only a histogram of -log10 p in steps of 0.01, so what meets in one place is
some thousand rows at any corpus size.

A run has no encoding if it is of digits alone (dates, numbers and counters are as even as random ones), or if it has signs
and letters of one case (paths and slugs). An added span never overlaps a base span. Positions come from splitting a text
by the pattern that also extracts the matches: gap and match lengths add up to offsets (code points, end exclusive).

Defined cases: null text counts as empty; very long texts are scanned whole; null ids and repeated rows are kept as they
are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import joined, written

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABET = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base52": UPPER + LOWER, "base26": LOWER}
#: Letters that are rare in writing (of hex: b, c, f), about half of them.
RARE, RARE_HEX = "[bfgjkmpqvwxyz]", "[bcf]"
#: Places where neighbours are of different classes.
CHANGES = "(?<=[A-Z])(?=[^A-Z])|(?<=[a-z])(?=[^a-z])|(?<=[0-9])(?=[^0-9])|(?<=[+/])(?=[^+/])"
VOWELS = "(?<=[aeiouy])(?=[^aeiouy])|(?<=[^aeiouy])(?=[aeiouy])"
#: Ordinary writing in each encoding: sum of squared symbol shares; spread of chi-squared over sqrt(length); share of rare
#: letters; share of changes; serial correlation; mean and spread of the three tests' sum. Measured on words of technical
#: prose and of the documents run together in the usual ways (cases, numbers, signs) at 20 to 80 symbols; where the two
#: differ, what lies nearer to random symbols is taken.
WRITING = {
    "hex": (0.115, 3.1, 0.25, 0.27, 0.55, 0.2, 2.3),
    "base32": (0.051, 2.3, 0.26, 0.13, 0.25, -0.4, 1.65),
    "base36": (0.046, 2.6, 0.26, 0.13, 0.11, -0.4, 1.45),
    "base64": (0.040, 4.2, 0.26, 0.31, 0.035, -0.4, 1.5),
    "base52": (0.048, 3.6, 0.26, 0.28, 0.165, -0.4, 1.75),
    "base26": (0.058, 2.1, 0.26, 0.60, 0.0, -0.4, 1.65),
}
STEP = 100


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of a pattern's matches; keep(match) drops failing ones after they have taken their place."""
    kind = KINDS[rank]
    none = F.array().cast(SPANS)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))).cast(SPANS)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(keep(x["hit"]), one).otherwise(none) if keep else one).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, add, lambda acc: acc["spans"])).otherwise(none)


def _long_value(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 1)) >= 6


def _encoding(s: Column) -> Column:
    """The encoding of a run of symbols; null if it has none."""
    cased, digit = s.rlike("[a-z]") & s.rlike("[A-Z]"), s.rlike("[0-9]")
    return (
        F.when(s.rlike("^[a-z]+$") | s.rlike("^[A-Z]+$"), "base26")
        .when(s.rlike("^[A-Za-z]+$"), "base52")
        .when(digit & s.rlike("[A-Za-z]") & s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(digit & s.rlike("[A-Z]") & s.rlike("^[A-Z2-7]+$"), "base32")
        .when(digit & s.rlike("[A-Za-z]") & s.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(cased & (s.rlike("^[A-Za-z0-9+/]+$") | s.rlike("^[A-Za-z0-9_-]+$")), "base64")
    )


def _battery(tokens: Column) -> Column:
    """start, end, bits, t (the tests' joint deviate, from ordinary writing towards randomness) of each token that has an
    encoding. tokens: array of (start, end, s)."""

    def pick(kind, values):
        out = F.lit(values["base64"])
        for e in ("hex", "base32", "base36", "base52", "base26"):
            out = F.when(kind == e, F.lit(values[e])).otherwise(out)
        return out

    def encoded(x):
        s, kind = x["s"], _encoding(x["s"])
        plain = F.when(kind.isin("hex", "base36", "base26"), F.lower(s)).otherwise(F.translate(s, "-_", "+/"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), plain.alias("s"))

    def indexed(x):
        chars = F.split(x["s"], "")
        alphabet = pick(x["kind"], ALPHABET)
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["kind"].alias("kind"),
            x["s"].alias("s"),
            F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")).alias("v"),
            F.aggregate(
                F.array_distinct(chars),
                F.lit(0.0),
                lambda a, c: a + F.pow(F.char_length(x["s"]) - F.char_length(F.replace(x["s"], c)), F.lit(2.0)),
            ).alias("squares"),
        )

    def tested(x):
        v, n, kind, s = x["v"], F.size(x["v"]).cast("double"), x["kind"], x["s"]
        k = pick(kind, {e: float(len(a)) for e, a in ALPHABET.items()})
        s2, chi_sd, rare_share, change_share, serial_mean, mean, sd = (pick(kind, {e: w[i] for e, w in WRITING.items()}) for i in range(7))
        chi = k / n * x["squares"] - n
        even = (k * (1 + (n - 1) * s2) - n - chi) / (chi_sd * F.sqrt(n))
        letters = F.regexp_count(F.lower(s), F.lit("[a-z]")).cast("double")
        rare = F.when(kind == "hex", F.regexp_count(s, F.lit(RARE_HEX))).otherwise(F.regexp_count(F.lower(s), F.lit(RARE)))
        spread = (rare - letters * rare_share) / F.sqrt(F.greatest(letters, F.lit(1.0)) * rare_share * (1 - rare_share))
        changes = F.when(kind == "base26", F.regexp_count(s, F.lit(VOWELS))).otherwise(F.regexp_count(s, F.lit(CHANGES)))
        runs = (changes - (n - 1) * change_share) / F.sqrt(1.25 * (n - 1) * change_share * (1 - change_share))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (a - (k + 1) / 2) * (b - (k + 1) / 2))
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + y) / ((n - 1) * (k * k - 1) / 12)
        total = (even + spread) / 1.55 + F.when(kind == "base26", -runs).otherwise(runs) + (serial_mean - serial) * F.sqrt(n)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (n * F.log2(k)).alias("bits"), ((total - mean) / sd).alias("t"))

    return F.transform(F.transform(F.filter(F.transform(tokens, encoded), lambda x: x["kind"].isNotNull()), indexed), tested)


def _minus_log10_p(t: Column) -> Column:
    """-log10 of Sampford's upper bound of the upper normal tail; 0 where t is not above 0."""
    t = F.greatest(t, F.lit(0.0))
    bound = t * t / 2 / math.log(10) + math.log10(math.sqrt(2 * math.pi)) - F.log10(4 / (3 * t + F.sqrt(t * t + 8)))
    return F.when(t > 0, bound).otherwise(0.0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """One row per document: its id and `spans` (start, rank, kind, end), by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        F.concat(_spans(text, ASSIGN, 0, _long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2)).alias("base"),
        F.transform(
            _spans(text, RUN, 3),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("s")),
        ).alias("tokens"),
    )
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    tested = scanned.select("doc_id", "base", _battery(F.filter("tokens", free)).alias("tokens"))
    kept, _ = written(tested, "secrets")

    # Benjamini-Hochberg from a histogram: a bucket's lower edge bounds its p-values from above
    level = lambda x: F.floor(F.least(_minus_log10_p(x["t"]) + F.log10(x["bits"]), F.lit(60.0)) * STEP)
    buckets = (
        kept.where(F.size("tokens") > 0)
        .select(F.explode("tokens").alias("x"))
        .select(level(F.col("x")).alias("level"), "x.bits")
        .groupBy("level")
        .agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))
        .orderBy(F.desc("level"))
        .collect()  # at most 60 * STEP rows and a few
    )
    m, cut, seen = sum(b["n"] for b in buckets), None, 0
    mean_bits = sum(b["bits"] for b in buckets) / m if m else 1.0
    for b in buckets:
        seen += b["n"]
        if m * mean_bits * 10 ** (-b["level"] / STEP) <= q * seen:
            cut = b["level"]
    added = F.transform(
        F.filter("tokens", lambda x: level(x) >= F.lit(cut).cast("long")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), x["end"].alias("end")),
    ).cast(SPANS)
    return kept.select("doc_id", F.sort_array(F.concat("base", F.coalesce(added, F.array().cast(SPANS)) if cut is not None else F.array().cast(SPANS))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets()'s rows."""

    def count(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select(
        "doc_id",
        *[count(r) for r in range(3)],
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(3),
    )
