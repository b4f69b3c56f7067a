"""Prefixes of word sets, taken with numpy where the sets lie: words are put in order without being shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose frequency every task knows; the others are rarer, and equal in the order but for their hash.
MOST_WORDS = 200_000
#: Bits of the map of words that can make a pair, by their hash.
BITS = 1 << 26
#: Sets that a task remembers, to give those that repeat only once.
SEEN = 1_000_000

SCHEMA = "c long, role int, above double, n int, k int, at int, w long, bits long"


def ranked(rank: DataFrame) -> tuple:
    """rank: w, f (each w once) -> the words of most pairs, their f, and a bitmap that holds all words of rank: what tasks
    need to know of the order, of bounded size however many words there are."""
    step = F.floor(F.log2("f") * 8)
    counts = sorted(((r["s"], r["n"]) for r in rank.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    fit = int(np.searchsorted(np.cumsum([n for _, n in counts]), MOST_WORDS, side="right"))  # steps of which all words fit
    top = rank.where(step >= counts[fit - 1][0] if fit else F.lit(False)).toArrow()
    words, f = top["w"].to_numpy(), top["f"].to_numpy()
    order = np.argsort(words)
    place = F.col("w").bitwiseAND(F.lit(BITS - 1))
    held = rank.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(BITS >> 6, dtype=np.int64)
    bitmap[held["i"].to_numpy()] = held["b"].to_numpy()
    return words[order], f[order], bitmap


def taken(known):
    """A function for mapInArrow, of rows of c, role, above, salt and words (a set of hashes, not empty): the words of each
    set's prefix with their places in it. n: the set's words; k: those that can make a pair; bits: a map of all of them.
    known: a broadcast of ranked()."""

    def of(batches):
        words, frequency, bitmap = known.value
        seen: set = set()
        for batch in batches:
            key = list(zip(batch["c"].to_pylist(), batch["role"].to_pylist()))
            new = np.zeros(len(key), dtype=bool)
            for i, x in enumerate(key):
                if x not in seen:
                    new[i] = True
                    if len(seen) < SEEN:
                        seen.add(x)
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            lists = batch["words"]
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64)), np.cumsum(n) - n).view(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            w = flat ^ batch["salt"].to_numpy(zero_copy_only=False)[row]
            place = w & (BITS - 1)
            held = (bitmap[place >> 6] >> (place & 63)) & 1 == 1
            row, w = row[held], w[held]
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            f = np.where(words[at] == w, frequency[at], 0) if len(words) else np.zeros(len(w), dtype=np.int64)
            order = np.lexsort((w, f, row))
            row, w = row[order], w[order]
            above = batch["above"].to_numpy(zero_copy_only=False)
            k = np.bincount(row, minlength=len(n))
            at = np.arange(len(row)) - (np.cumsum(k) - k)[row]
            first = at < (k - np.ceil(above * n - 1e-9) + 1)[row]
            row, w, at = row[first], w[first], at[first]
            c, role = batch["c"].to_numpy(zero_copy_only=False), batch["role"].to_numpy(zero_copy_only=False)
            i32 = lambda x: pa.array(x.astype(np.int32))
            columns = [pa.array(c[row]), i32(role[row]), pa.array(above[row]), i32(n[row]), i32(k[row]), i32(at), pa.array(w), pa.array(bits[row])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return of
