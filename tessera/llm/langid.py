"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent character n-grams (1 to 3 letters; a run of anything but letters is one word
edge), in order of frequency. A text's own most frequent n-grams are held against each profile: an n-gram costs the
difference of its two ranks, or the profile's length where the profile lacks it. The least total names the language;
the score is the winner's share of exp(-BETA * mean cost), between 0 and 1. Equal costs go to the first language in
alphabetical order.

Profiles are learnt from a bounded sample (SAMPLE texts of least hash of their id for each language, one text an id); the
texts' n-gram counts are added up by Spark and the profiles written as a table. There may be any number of languages: they
are held against the texts in groups of about GROUP, a scan each, whose profiles alone a task and the driver hold; a text
carries its best language and the sum of shares so far from one to the next. Prediction reads whole texts, needs no
shuffle and keeps one text's counts at a time.

Defined cases: null texts, and texts without a letter, are `und` with score 0; so is every text when nothing can be
learnt; very long texts are read whole; null ids and repeated rows are predicted one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import dropped, one_text, written

SAMPLE = 1000
PROFILE = 400
#: Languages whose profiles are held at once, and of one table of ranks.
GROUP, TABLE = 1000, 64
SALTS = 16
BETA = 40.0
EDGE = 1

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a letter), and their counts."""
    none = np.empty(0, np.int64)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[c] if len(c) else none.astype(bool)
    if not letter.any():
        return none, none
    c = np.concatenate([[EDGE], np.where(letter, c, EDGE), [EDGE]])
    c = c[np.append(True, (c[1:] != EDGE) | (c[:-1] != EDGE))]
    one = c[c != EDGE]
    two = c[:-1] << 21 | c[1:]
    three = c[:-2] << 42 | two[1:]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by number."""
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """A group of languages: rank tables of TABLE languages each (the last row stands for any n-gram that none of them has)."""

    def __init__(self, by_lang: dict[str, list[int]], most: int):
        self.langs, self.most, self.tables = sorted(by_lang), most, []
        for i in range(0, len(self.langs), TABLE):
            some = self.langs[i : i + TABLE]
            keys = np.unique(np.array([k for x in some for k in by_lang[x]], np.int64))
            ranks = np.full((len(keys) + 1, len(some)), -1, np.int64)
            for j, lang in enumerate(some):
                ranks[np.searchsorted(keys, by_lang[lang]), j] = np.arange(len(by_lang[lang]))
            self.tables.append((keys, ranks))

    def costs(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean cost of a text's n-grams in each language, as a share of the profile's length."""
        top, out = ranked(keys, counts, self.most), []
        for known, table in self.tables:
            at = np.searchsorted(known, top)
            at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
            ranks = table[at]
            out.append(np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(top))[:, None])).mean(0) / self.most)
        return np.concatenate(out)

    def add(self, text: str | None, lang: str | None, cost: float, total: float) -> tuple[str | None, float, float]:
        """The best language, its cost and the sum of shares (the best one's is 1) of those before and these."""
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return lang, cost, total
        costs = self.costs(keys, counts)
        i = int(costs.argmin())
        best = min((cost, lang), (float(costs[i]), self.langs[i])) if lang is not None else (float(costs[i]), self.langs[i])
        return best[1], best[0], total * float(np.exp(-BETA * (cost - best[0]))) + float(np.exp(-BETA * (costs - best[0])).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, _, total = self.add(text, None, 0.0, 0.0)
        return ("und", 0.0) if lang is None else (lang, 1 / total)


class Learnt:
    """The profiles of all languages: a written table (lang, gram, r) of so many languages."""

    def __init__(self, rows: DataFrame, languages: int, most: int):
        self.rows, self.most, self.parts = rows, most, max(1, -(-languages // GROUP))

    def groups(self):
        for i in range(self.parts):
            by_lang: dict[str, list] = {}
            own = self.rows.where(F.pmod(F.xxhash64("lang"), F.lit(self.parts)) == i)
            for r in sorted(own.collect(), key=lambda r: (r["lang"], r["r"])):  # about GROUP languages, `most` rows each
                by_lang.setdefault(r["lang"], []).append(r["gram"])
            yield Profiles(by_lang, self.most)


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", sample: int = SAMPLE, most: int = PROFILE) -> Learnt:
    """docs: doc_id, text and the language. learn: whether a doc_id's row may be learnt from."""
    own = docs.where(learn & F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col(lang_col).alias("lang"))
    # a language's texts of small hash, somewhat more than the sample: no task meets all rows of one
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    shares, _ = written(sizes.select("lang", F.least(F.lit(1.0), F.lit(2.0 * sample) / F.greatest("n", F.lit(1))).alias("share")), "languages")
    languages = shares.count()
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    if languages <= GROUP:
        shared = own.join(F.broadcast(shares), "lang")
    else:  # a language's rows meet its share in SALTS parts
        salted = shares.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        shared = own.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["lang", "salt"])
    some = shared.where(hashed.cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    order = W.partitionBy("lang").orderBy("h", "doc_id")
    texts = one_text(some, "lang", "doc_id").withColumn("h", hashed).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "text")

    def count(batches):
        import collections

        total: dict = collections.defaultdict(collections.Counter)
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns)):
                keys, counts = grams(text)
                total[lang].update(dict(zip(keys.tolist(), counts.tolist())))
        rows = [(lang, k, n) for lang, c in total.items() for k, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "gram", "n"])

    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows, _ = written(counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("lang", "gram", "r"), "profiles")
    return Learnt(rows, languages, most)


def identify(docs: DataFrame, learnt: Learnt) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = f"doc_id {kind}, text string, lang string, cost double, total double"
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("total"))
    before = None
    for i, profiles in enumerate(learnt.groups()):
        if i:  # one group's profiles at a time
            rows, path = written(rows, "languages")
            if before:
                dropped(docs.sparkSession, before)
            before = path

        def run(batches, held=docs.sparkSession.sparkContext.broadcast(profiles), more=i + 1 < learnt.parts):
            for b in batches:
                found = [held.value.add(*row) for row in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
                columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))] if found else [b.column(i) for i in (2, 3, 4)]
                texts = b.column(1) if more else pa.nulls(len(b), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), texts, *columns], ["doc_id", "text", "lang", "cost", "total"])

        rows = rows.mapInArrow(run, state)
    return rows.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(F.col("lang").isNull(), 0.0).otherwise(1 / F.col("total")).alias("score"))
