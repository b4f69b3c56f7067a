"""Benchmark decontamination: rare n-gram seeds join training passages to test items; Smith-Waterman alignment scores them,
so edited or paraphrased copies are found too.

An alignment (match 2, mismatch -1, gap -1) of `least` or more with M matches has at most E = 2M - least edits. Between
two matches that follow each other stand E / (M - 1) edits on average, so at least M - 1 - E / 2, which is least / 2 - 1,
of these pairs have one edit or none between them. Seeds are therefore pairs of words one or two places apart, on both
sides: each such alignment shares least / 2 - 1 of them, within 3n - least words of text (n: the item's words).

1. Test items are taken in blocks of about BLOCK_CHARS characters (measured first), so the word list that a task holds
   is bounded whatever the size of the benchmark; each block is held against all rows.
2. An item's seeds are put in order of rarity: how many items of the block hold them. A text that shares `need` of them
   must share one of all but the need - 1 most frequent, so rare seeds alone join texts to items. Nothing is lost by
   this, and how many rows hold a seed is never asked, so a passage that half of the corpus, or all of it, repeats is
   found whole, edited or short as a rare one is. Nothing is shuffled but the leaks found.
3. For the items met so, all shared seeds are counted in stretches of the text; a stretch that holds enough of them is a
   window. Only windows whose bound reaches the least score are aligned: a word of the text adds 2 to a score if the item
   has it and takes 1 if not, so no stretch of it scores above its sum of these.

A pair is a leak when its best score is at least `share` of the item's perfect score, and at least that of LEAST_WORDS
matches (or of the item, if shorter); every pair that is, is found. Words are runs between white space and ASCII
punctuation, lower-cased. Defined cases: null or empty texts on either side match nothing; an item of one word is its own
seed; texts are taken whole, however long; repeated rows of an item are taken once, of a document the best score stands
for the pair (the first place of equal scores); leaks() leaves null ids out, decontaminate() judges each row by its own
text, whatever its id; ids must be whole numbers in leaks() (else TypeError); empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import whole_numbers

REACH = 2
BLOCK_CHARS = 4_000_000
SHARE = 0.4
LEAST_WORDS = 8
SLICE = 1 << 20
_BREAKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split() if text else []


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """62-bit hashes of pairs of word ids (FNV-1a by word, then a finalizer)."""
    h = np.full(len(a), 1469598103934665603, np.uint64)
    for x in (a, b):
        h = (h ^ x.astype(np.uint64)) * np.uint64(1099511628211)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(27))) >> np.uint64(2)).astype(np.int64)


def least_score(n: int, share: float) -> float:
    """What an alignment with an item of n words must score."""
    return max(share * 2 * n, 2 * min(n, LEAST_WORDS))


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the pairs of known words (0: a word of no item) one to REACH places apart, and of words alone."""
    keys, places = [-1 - ids[ids > 0]], [np.flatnonzero(ids)]
    for d in range(1, REACH + 1):
        at = np.flatnonzero((ids[:-d] > 0) & (ids[d:] > 0)) if len(ids) > d else np.empty(0, np.int64)
        keys.append(_keys(ids[at], ids[at + d]))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


class Seeds:
    """The seeds of a block of test items: word ids, items as arrays of them, and the items of each seed; `rare` marks the
    seeds and items that join texts to items, the others are only counted."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        rows: list[tuple[int, int, int]] = []  # seed, index of the item, how often
        for item, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)], np.int64)
            keys, times = np.unique(_pairs(w)[0], return_counts=True)
            pairs = keys >= 0 if len(w) > 1 else keys < 0  # an item of one word is its own seed
            rows += [(k, len(self.ids), t) for k, t in zip(keys[pairs].tolist(), times[pairs].tolist())]
            self.ids.append(item)
            self.texts.append(w)
        seeds, self.items, times = np.array(sorted(rows), np.int64).reshape(-1, 3).T
        self.lengths = np.array([len(w) for w in self.texts], np.int64)
        self.least = np.array([least_score(int(n), share) for n in self.lengths])
        self.need = np.maximum(1, np.ceil(self.least / 2 - 1)).astype(np.int64)
        self.span = np.floor(3 * self.lengths - self.least).astype(np.int64)
        self.seeds, self.first, held = np.unique(seeds, return_index=True, return_counts=True)
        self.first = np.append(self.first, len(seeds))
        # a text that shares `need` seeds of an item shares one beyond its need - 1 most frequent
        order = np.lexsort((seeds, -np.repeat(held, held), self.items))
        before = np.cumsum(times[order]) - times[order]
        own = np.searchsorted(self.items[order], np.arange(len(self.ids)))
        self.rare = np.empty(len(seeds), bool)
        self.rare[order] = before + times[order] - before[own[self.items[order]]] >= self.need[self.items[order]] if len(seeds) else False

    def _places(self, at: np.ndarray, places: np.ndarray):
        """(rows of the items of seeds `at`, places), SLICE at a time, and those of one seed at least."""
        counts = self.first[at + 1] - self.first[at]
        total, i = np.concatenate([[0], np.cumsum(counts)]), 0
        while i < len(at):
            to = max(i + 1, int(np.searchsorted(total, total[i] + SLICE, "right")) - 1)
            c = counts[i:to]
            yield np.repeat(self.first[at[i:to]] - (total[i:to] - total[i]), c) + np.arange(total[to] - total[i]), np.repeat(places[i:to], c)
            i = to

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(index of an item, start, end) of the stretches of a text that hold every alignment of an item's least score."""
        keys, places = _pairs(ids)
        none = np.empty((0, 3), np.int64)
        if not len(keys) or not len(self.seeds):
            return none
        at = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        ok = self.seeds[at] == keys
        at, places = at[ok], places[ok]
        met = np.zeros(len(self.ids), bool)
        for row, _ in self._places(np.unique(at), np.unique(at)):
            met[self.items[row[self.rare[row]]]] = True
        if not met.any():
            return none
        order = np.argsort(places, kind="stable")
        found, place = [], []
        for row, p in self._places(at[order], places[order]):
            own = met[self.items[row]]
            found.append(self.items[row[own]])
            place.append(p[own])
        item, place = np.concatenate(found), np.concatenate(place)
        order = np.argsort(item, kind="stable")  # places stay in order
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.need[item] - 1
        full = last < len(item)
        full[full] = (item[last[full]] == item[full]) & (place[last[full]] - place[full] <= self.span[item[full]])
        i, start = item[full], place[full]
        return _merged(np.stack([i, np.maximum(0, start - self.span[i]), np.minimum(len(ids), start + self.span[i] + REACH)], 1)) if len(i) else none


def _merged(windows: np.ndarray) -> np.ndarray:
    """Windows of an item that touch become one."""
    w = windows[np.lexsort((windows[:, 1], windows[:, 0]))]
    if len(w) < 2:
        return w
    wide = int(w[:, 2].max()) + 1
    reach = np.maximum.accumulate(w[:, 0] * wide + w[:, 2])  # the furthest end so far, within the item
    heads = np.flatnonzero(np.concatenate([[True], w[1:, 0] * wide + w[1:, 1] > reach[:-1]]))
    ends = reach[np.append(heads[1:], len(w)) - 1] - w[heads, 0] * wide
    return np.stack([w[heads, 0], w[heads, 1], ends], 1)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and where it ends in text. Gaps cost as much a word as mismatches, so a row's
    horizontal gaps are a running maximum."""
    ramp = np.arange(len(text))
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for x in item:
        step = np.maximum(np.maximum(row[:-1] + np.where(text == x, 2, -1), row[1:] - 1), 0)
        row[1:] = np.maximum.accumulate(step + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _best(b: np.ndarray, a: np.ndarray, windows: list[tuple[int, int]], least: float, known: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) in words of text b of the best window that scores `least` or more; 0s if none does. known: a
    mask over the vocabulary, all false."""
    best = (0, 0, 0)
    known[a] = True
    for lo, hi in windows:
        sums = np.cumsum(np.where(known[b[lo:hi]], 2, -1))
        bound = int((sums - np.minimum(0, np.minimum.accumulate(sums))).max(initial=0))
        if bound < least or bound <= best[0]:
            continue
        score, end = align(a, b[lo:hi])
        if score >= least and score > best[0]:
            best = (score, lo, lo + end)
    known[a] = False
    if best[0]:
        score, lo, end = best
        best = (score, end - align(a[::-1], b[lo:end][::-1])[1], end)
    return best


def _leaks(s: Seeds, text: str | None, known: np.ndarray):
    """(index of the item, score, start, end) of each item of a block that a text leaks. known: as in _best()."""
    w = words(text)
    ids = np.fromiter((s.vocabulary.get(x, 0) for x in w), np.int64, len(w))
    windows = s.windows(ids)
    heads = np.flatnonzero(np.diff(windows[:, 0], prepend=-1))
    for group in np.split(windows, heads[1:]) if len(heads) else ():
        i = int(group[0, 0])
        n = len(s.texts[i])
        score, start, end = _best(ids, s.texts[i], group[:, 1:].tolist(), s.least[i], known)
        if score:
            yield i, score / (2 * n), start, end


def _found(docs: DataFrame, seeds) -> DataFrame:
    names = ["doc_id", "item_id", "score", "start_word", "end_word"]

    def run(batches):
        s = seeds.value
        known = np.zeros(len(s.vocabulary) + 1, bool)
        for batch in batches:
            out = [(doc.as_py(), s.ids[i], *rest) for doc, t in zip(*batch.columns) for i, *rest in _leaks(s, t.as_py(), known)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long")


def _blocks(spark: SparkSession, items: DataFrame, share: float):
    """The seeds of each block of test items, as broadcasts of bounded size. items: item_id, item_text."""
    items = items.where("item_text is not null").distinct()
    chars = items.agg(F.sum(F.char_length("item_text"))).first()[0] or 0
    blocks = math.ceil(chars / BLOCK_CHARS)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block)
        seeds = Seeds([(r["item_id"], r["item_text"]) for r in own.collect()], share)
        if len(seeds.seeds):
            yield spark.sparkContext.broadcast(seeds)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """One row per document and test item that it leaks: doc_id, item_id, score (0 to 1), start_word, end_word."""
    spark = docs.sparkSession
    docs = whole_numbers(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = whole_numbers(benchmark, item_col).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    for seeds in _blocks(spark, items.where("item_id is not null"), share):
        out = out.unionByName(_found(docs, seeds))
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows whose text leaks no test item, with their columns: a filter for each block of items, nothing is joined or
    shuffled."""

    def clean(seeds):
        @F.pandas_udf("boolean")
        def ok(texts):
            s = seeds.value
            known = np.zeros(len(s.vocabulary) + 1, bool)
            return texts.map(lambda t: next(_leaks(s, t, known), None) is None)

        return ok(F.col(text_col))

    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("item_text"))
    for seeds in _blocks(docs.sparkSession, items, share):
        docs = docs.where(clean(seeds))
    return docs
