"""Column functions over page text. Built-in functions only, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PART = r"[\p{L}\p{M}\p{N}_]"
TOKEN = rf"(?<!{WORD_PART})[a-z0-9]{{2,}}+(?!{WORD_PART})"
WIKI_LINK = r"\[\[([^|\]]+)(?:\|[^\]]+)?\]\]"
RAW_LINK = r"\[\[([^\]]+)\]\]"
EMBED = r"!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
PLAIN_LINK = r"(?<!!)\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
HASHTAG = r"#([a-zA-Z0-9_\-]+)"

# Fixed values
TIME_SENSITIVE = (r"\b20\d{2}\b", r"\bcurrent\b", r"\blatest\b", r"\bupcoming\b", r"\brecent\b", r"\bnew\b", r"\btoday\b", r"\bnow\b", r"\bversion\s+\d+", r"\bv\d+\.\d+")
NEGATION = (r"\bno(t|w)?\b", r"\bdon't\b", r"\bdoesn't\b", r"\bdidnt'\b", r"\bwill not\b", r"\bcannot\b", r"\bcan't\b", r"\bwillnot\b")
TEMPORAL = ("before", "after", "during", "earlier", "later", "previously", "formerly", "then", "now", "originally", "subsequently")
OPPOSITE = (("before", "after"), ("earlier", "later"), ("formerly", "now"))
# End of fixed values

_NEGATION = "|".join(NEGATION)
_TEMPORAL = rf"\b({'|'.join(TEMPORAL)})\b"


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more of a-z and 0-9, in order, with repeats. A word is a run of letters, marks, digits
    and underscores; runs that hold anything else are no tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def links(text: Column, pattern: str = WIKI_LINK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def slug_ascii(text: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def decompose(text: Column) -> Column:
    """NFKD without what is not ASCII. Spark has no such function: a pandas UDF."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkd(s):
        return s.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    return nfkd(text)


def slugify(text: Column, most: int = 100) -> Column:
    return F.rtrim(F.substring(slug_ascii(decompose(text)), 1, most), F.lit("-"))


def title_case(text: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter; initcap() starts words at white space only."""

    @F.pandas_udf("string")
    def titled(s):
        return s.map(str.title, na_action="ignore")

    return titled(text)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", source, target, kind)), 1, 16)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normal_name(name: Column) -> Column:
    return F.array_join(F.filter(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: ~w.isin("the", "a", "an", "")), " ")


def time_sensitive(text: Column) -> Column:
    # all begin at a word's edge: looked for once, not by each of them
    return F.lower(text).rlike(r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in TIME_SENSITIVE) + ")")


def url_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("https?://"))


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days, never negative; null where the time is."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)).cast("int")


def age_factor(days: Column, most: int = 365) -> Column:
    return F.when(days <= 0, 1.0).when(days >= most, 0.0).otherwise(1.0 - days / F.lit(float(most)))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), lambda x: x.cast("double"))


def masked_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "NUM")


def negated(text: Column) -> Column:
    low = F.lower(text)
    # one of these stands in every negation; looking for them is cheaper than the pattern
    return (F.contains(low, F.lit("no")) | F.contains(low, F.lit("n't")) | F.contains(low, F.lit("didnt'"))) & low.rlike(_NEGATION)


def without_negation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(text)), _NEGATION, ""))


def temporal(text: Column) -> Column:
    return F.lower(text).rlike(_TEMPORAL)


def without_temporal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _TEMPORAL, "")


def opposite(a: Column, b: Column) -> Column:
    """Whether two lower-cased texts hold the two words of a pair, as substrings."""
    out = F.lit(False)
    for x, y in OPPOSITE:
        out = out | (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    return out


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.7, "medium").otherwise("low")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def truncated(text: Column, most: int = 200, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


# Failure reasons by the first pair of words that the error holds
FAILURES = (
    ("llm_timeout", ("timeout",)),
    ("network_error", ("network", "connection")),
    ("temporary_error", ("temporary", "try again")),
    ("invalid_format", ("invalid", "format")),
    ("corrupted_file", ("corrupt",)),
    ("unsupported_type", ("unsupported", "type")),
    ("permission_denied", ("permission",)),
    ("missing_metadata", ("metadata",)),
    ("schema_validation_failed", ("schema", "validation")),
    ("config_error", ("config",)),
)
TRANSIENT = ("llm_timeout", "network_error", "temporary_error")
PERMANENT = ("invalid_format", "corrupted_file", "unsupported_type", "permission_denied")
RETRY_SECONDS = (300, 1800, 7200, 21600, 86400)
# End of fixed values


def failure_reason(error: Column) -> Column:
    e, out = F.lower(error), None
    for reason, marks in FAILURES:
        hit = e.contains(marks[0]) if len(marks) == 1 else e.contains(marks[0]) | e.contains(marks[1])
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise("unknown")


def retry_seconds(failures: Column) -> Column:
    """The delay after so many failures, by table."""
    return F.element_at(F.array(*[F.lit(s) for s in RETRY_SECONDS]), F.greatest(F.lit(1), F.least(failures, F.lit(len(RETRY_SECONDS)))).cast("int"))


def exponential_seconds(attempt: Column, first: float = 1.0, base: float = 2.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """The delay; jitter (0 to 1, as rand(seed) gives it) adds up to half of it."""
    delay = F.least(F.lit(most), F.lit(first) * F.pow(F.lit(base), attempt))
    return delay if jitter is None else delay * (F.lit(1.0) + jitter / 2)
