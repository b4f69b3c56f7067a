"""N-gram Jaccard self-join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

A document's set is its distinct shingles of `width` words. Two sets link when |A & B| * den >= num * |A | B|.

1. Classes. Documents with equal sets are one class; copies never reach a pair.
2. Signatures. Sets are dealt into size bands. A pair is handled in the band of its larger set, where its Hamming
   distance is at most k = floor(2 * (1 - J) / (1 + J) * largest size). The feature domain is cut into n1 partitions by
   hash, of which at least 1 + spare hold at most k2 differences each, and each into n2 parts; subsets of n2 - k2 parts
   are enumerated, so that one subset is free of differences. A signature hashes the features in a subset; a subset
   without features has none. A set that fills more than k2 parts of a partition meets its partner in a filled part
   there; so only sets that fill at most k2 parts in more than `spare` partitions need signatures of empty subsets.
   A set whose partner may be in the next band has signatures there too.
   Signatures that very many sets share are salted before the shuffle: of a chunk's sets with one signature, SMALL + 1
   stand under it, and all stand under a signature of the chunk's own.
3. Candidates. Signatures that up to SMALL sets share give pairs, at most SMALL - 1 a set. Of larger groups each set is
   joined to the least one, and components of those joins are clusters. Each linked pair is a pair or lies in a cluster.
4. Bounds. A bitmap of hashed features bounds an intersection from above: |A & B| <= |A| - |bits of A alone|. Pairs whose
   bound misses the threshold are dropped. Boilerplate can chain unlike sets into one cluster, so clusters of over REFINE
   sets are split: the bitmaps of sets of like sizes are compared block by block (WIDE sets each), and what the bound
   allows is kept as a forest, never as pairs.
5. Verification is exact. Components of what is left are the final clusters, so each text is fetched once. Sets of a
   cluster are dealt into blocks of about BLOCK; tasks compare block with block and emit a forest of links and each set's
   number of links, never the pairs.
6. Components of the forest are the groups.

Defined cases: null text, empty text and text without words give an empty set, which links with nothing; with fewer
words than `width`, the whole sequence is one shingle; null ids stand alone; rows that repeat an id are rows of their own,
with the links of their own texts; ids must be whole numbers (else TypeError); very long texts are taken whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import dropped, whole_numbers, written
from tessera.llm.components import components

BLOCK = 256
SMALL = 8
REFINE, WIDE, WIDE_BYTES = 512, 4096, 1 << 23
#: Bits of a bitmap for each feature, and the least and most bytes of a bitmap.
BITS, NARROWEST, WIDEST = 4, 64, 8192
#: From so many bytes on, a quarter of two bitmaps is compared first.
PARTLY = 512
#: So many signatures of a task are held together.
CHUNK = 300_000
#: Ratio of a size band's ends.
BAND = 1.5
_TOPS = [1]
while _TOPS[-1] < 2**40:
    _TOPS.append(max(_TOPS[-1] + 1, int(_TOPS[-1] * BAND)))
_M1 = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted. bytes.lower() and bytes.split() act on A-Z and \\x20 \\x09-\\x0D only."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out ^ h[j : j + n], j + 1)
    return np.unique(out)


@dataclass(frozen=True)
class PartEnum:
    """num / den: the least Jaccard similarity. n2 and k2: parts of a partition, and how many may differ. Small sets, with
    k of at most 3, have one partition of k + 3 parts, so that a signature never rests on a few features."""

    num: int = 90
    den: int = 100
    n2: int = 3
    k2: int = 1

    def band(self, n: int) -> int:
        """Bands are [_TOPS[b - 1] + 1, _TOPS[b]]."""
        return bisect_left(_TOPS, n)

    def distance(self, band: int) -> int:
        j = Fraction(self.num, self.den)
        return int(2 * (1 - j) / (1 + j) * _TOPS[band])

    def bands(self, n: int) -> list[int]:
        """The set's own band, and those of larger sets that it may link with."""
        first, last = self.band(n), self.band(max(n, n * self.den // self.num))
        return list(range(first, last + 1))

    def signatures(self, f: np.ndarray) -> np.ndarray:
        out = []
        for band in self.bands(len(f)):
            k = self.distance(band)
            if k == 0:
                out.append(mix(np.array([f.sum() + np.uint64(len(f))], np.uint64), 7000 + band))
                continue
            n1, n2, k2, spare = 1, k + 3, k, 0
            if k > 3:
                n1, n2, k2 = k // (self.k2 + 1) + 1, self.n2, self.k2
                spare = 3
                n1 += spare
            cell = (mix(f, 77) % np.uint64(n1 * n2)).astype(np.int64)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, cell, mix(f, 78))
            sums = sums.reshape(n1, n2)
            filled = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) > 0
            few = filled.sum(1) <= k2
            few &= few.sum() > spare
            for no, parts in enumerate(combinations(range(n2), n2 - k2)):
                own = list(parts)
                key = np.arange(n1, dtype=np.uint64) * np.uint64(1009) + np.uint64(no + 1)
                sig = mix(mix(key, 9000 + band) ^ mix(sums[:, own] + np.arange(len(own), dtype=np.uint64) * _M1, 5).sum(1), 6)
                out.append(sig[few | filled[:, own].any(1)])
        return np.concatenate(out)


def set_hash(f: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit hash."""
    return tuple(int(mix(f, salt).sum().view(np.int64)) for salt in (1, 2))


def _hashed(docs: DataFrame, width: int) -> DataFrame:
    """docs: doc_id, text_hash, text -> doc_id, text_hash, n_shingles, the set's hash (h1, h2; null for an empty set), and the
    bitmap of its features."""

    def run(batches):
        for b in batches:
            sets = [features(t.as_py(), width) for t in b.column(2)]
            h1, h2 = zip(*(set_hash(f) if len(f) else (None, None) for f in sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(map(bitmap, sets), pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bits binary")


def bitmap(f: np.ndarray) -> bytes:
    """One bit for each hashed feature, of about BITS bits a feature: a power of two of bytes."""
    size = min(WIDEST, max(NARROWEST, 1 << (BITS * len(f) - 1).bit_length() >> 3)) if len(f) else NARROWEST
    held = np.zeros(8 * size, bool)
    held[(mix(f, 31) % np.uint64(8 * size)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def bitmaps(some: list[bytes], size: int) -> np.ndarray:
    """Rows of `size` bytes, as 64-bit words, of bitmaps that are as large or larger: a larger one is folded."""
    out, lengths = np.empty((len(some), size // 8), np.uint64), np.fromiter(map(len, some), np.int64, len(some))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        whole = np.frombuffer(b"".join(some[i] for i in at), np.uint64).reshape(len(at), n // size, size // 8)
        out[at] = np.bitwise_or.reduce(whole, 1)
    return out


def _forest(pairs, names: list) -> list[tuple]:
    """The edges that join new parts, of pairs of numbers of names."""
    root, out = list(range(len(names))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((names[i], names[j]))
    return out


def _allowed(n_a, n_b, weight_a, weight_b, both, num: int, den: int):
    """Whether bitmaps allow a link, by sizes of sets, bits set in each and bits in common."""
    most = np.minimum(n_a - (weight_a - both), n_b - (weight_b - both))
    return most * (num + den) >= num * (n_a + n_b)


def _weights(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(1, dtype=np.int64)


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs: a, b and each side's n and bits -> those (a, b) that the bitmaps allow to link."""

    def run(batches):
        for t in batches:
            n_a, n_b = (t.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (t.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            size = np.minimum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
            ok = np.zeros(len(x), bool)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                p, q = (bitmaps([side[i] for i in at], s) for side in (x, y))
                ok[at] = _allowed(n_a[at], n_b[at], _weights(p), _weights(q), _weights(p & q), num, den)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _likely(rows: list, num: int, den: int) -> list[tuple]:
    """A forest of the pairs of two blocks whose bitmaps allow a link, of which the smaller set is of the own band. rows:
    (h1, n, own, bits, block, lo, hi)."""
    lo, hi = rows[0][5], rows[0][6]
    sides = [sorted((r for r in rows if r[4] == side), key=lambda r: (r[1], r[0])) for side in ([lo] if lo == hi else [lo, hi])]
    names = [r[0] for side in sides for r in side]

    def pairs():
        for s, side in enumerate(sides):
            other, shift, other_shift = sides[-1 - s], s * len(sides[0]), (len(sides) - 1 - s) * len(sides[0])
            n, m = np.array([r[1] for r in side]), np.array([r[1] for r in other])
            sizes, other_sizes = (np.array([len(r[3]) for r in x]) for x in (side, other))
            # each pair once: within a block what comes later, between blocks equal sizes from the first block only
            begins = np.arange(1, len(n) + 1) if lo == hi else np.searchsorted(m, n, "right" if s else "left")
            ends = np.searchsorted(m, n * den // num, "right")
            for size in np.unique(sizes):
                base = int(np.searchsorted(other_sizes, size))  # larger sets have bitmaps as large or larger
                top = int(ends[np.flatnonzero(sizes == size)].max())
                if top <= base:
                    continue
                bits = bitmaps([r[3] for r in other[base:top]], size)
                mine = np.flatnonzero((sizes == size) & np.array([r[2] for r in side]))
                x = bitmaps([side[i][3] for i in mine], size)
                wx, wb = _weights(x), _weights(bits)
                part = np.ascontiguousarray(bits[:, : size // 32]) if size >= PARTLY else None  # a quarter's bits give a weaker bound
                px, pb = (_weights(x[:, : size // 32]), _weights(part)) if part is not None else (None, None)
                for k, i in enumerate(mine.tolist()):
                    b, e = max(int(begins[i]), base) - base, int(ends[i]) - base
                    if e <= b:
                        continue
                    if part is None:
                        j = b + np.flatnonzero(_allowed(n[i], m[b + base : e + base], wx[k], wb[b:e], _weights(bits[b:e] & x[k]), num, den))
                    else:
                        j = b + np.flatnonzero(_allowed(n[i], m[b + base : e + base], px[k], pb[b:e], _weights(part[b:e] & x[k, : size // 32]), num, den))
                        j = j[_allowed(n[i], m[j + base], wx[k], wb[j], _weights(bits[j] & x[k]), num, den)]
                    for y in j.tolist():
                        yield i + shift, y + base + other_shift

    return _forest(pairs(), names)


def _blocks(df: DataFrame, blocks: Column, by: str) -> DataFrame:
    """df with block, lo and hi: a row for each pair of blocks that its own block is in. blocks: a column of counts."""
    out = df.withColumn("block", F.pmod(F.xxhash64(by), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")


def _grouped(df: DataFrame, keys: list[str], columns: list[str], compare, schema: str) -> DataFrame:
    """compare(rows) for the rows of each key: they stand together in a partition, and a task holds one key's rows. Of rows
    with one first column only one is held."""
    dealt = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, columns[0])
    names, k = [x.split(" ")[0] for x in schema.split(", ")], len(keys)

    def run(batches):
        key, rows, out = None, [], []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    if row[:k] != key:
                        out += compare(rows) if len(rows) > 1 else []
                        key, rows = row[:k], []
                    if not rows or rows[-1][0] != row[k]:
                        rows.append(row[k:])
            if out:
                yield batch(out)
                out = []
        if len(rows) > 1 and (out := compare(rows)):
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return dealt.mapInArrow(run, schema)


def salted(h: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (set, signature) of a chunk. Of a signature that over SMALL rows have, SMALL + 1 stay, enough to tell that its
    group is large; all of them also stand under a signature made of it and of the chunk's first set with it."""
    order = np.argsort(sig)
    ordered = sig[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.diff(np.append(heads, len(sig)))
    large = np.flatnonzero(n > SMALL)
    if not len(large):
        return h, sig
    n, heads = n[large], heads[large]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows = order[np.repeat(heads, n) + place]
    first = np.repeat(h[order[heads]], n)
    own = mix(sig[rows].view(np.uint64) ^ mix(first.view(np.uint64), 11), 12).view(np.int64)
    kept = np.ones(len(h), bool)  # the rows keep their order: one set's stand together, which compresses well
    kept[rows[place > SMALL]] = False
    return np.concatenate([h[kept], h[rows]]), np.concatenate([sig[kept], own])


def _signed(docs: DataFrame, width: int, how: PartEnum) -> DataFrame:
    """h1, sig: a row for each signature. Of equal sets in one task only the first has signatures, so a group of copies
    costs a row for each task and signature, not for each copy."""

    def run(batches):
        seen, keys, sigs, held = set(), [], [], 0
        for b in batches:
            for t in b.column(0):
                f = features(t.as_py(), width)
                key = set_hash(f)
                if len(f) and key not in seen:
                    seen.add(key)
                    sigs.append(how.signatures(f).view(np.int64))
                    keys.append(key[0])
                    held += len(sigs[-1])
                if held > CHUNK:
                    yield from rows(keys, sigs)
                    keys, sigs, held = [], [], 0
        if keys:
            yield from rows(keys, sigs)

    def rows(keys, sigs):
        h, sig = salted(np.repeat(np.array(keys, np.int64), [len(s) for s in sigs]), np.concatenate(sigs))
        for at in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 200_000]), pa.array(sig[at : at + 200_000])], ["h1", "sig"])

    return docs.select("text").mapInArrow(run, "h1 long, sig long")


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of chunks of the shared features' incidence."""
    out = np.zeros((len(a), len(b)), np.float32)
    fa, fb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(fa, fb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def held(f, r):
        at = np.searchsorted(shared, f)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == f[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], r[ok][order]

    (ca, ra), (cb, rb) = held(fa, ra), held(fb, rb)
    step = 8192
    for lo in range(0, len(shared), step):
        hi = min(len(shared), lo + step)
        ma, mb = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        for m, c, r in ((ma, ca, ra), (mb, cb, rb)):
            s = slice(*np.searchsorted(c, [lo, hi]))
            m[r[s], c[s] - lo] = 1
        out += ma @ mb.T
    return out


def _compare(rows: list, width: int, num: int, den: int) -> list[tuple]:
    """(node, partner, links) of the sets of one pair of blocks. rows: (node, copies, block, lo, hi, text)."""
    lo, hi = rows[0][3], rows[0][4]
    sides = [[r for r in rows if r[2] == side] for side in (lo, hi)]
    a, b = ([features(r[5], width) for r in side] for side in sides) if lo != hi else [[features(r[5], width) for r in sides[0]]] * 2
    if not a or not b:
        return []
    both = _intersections(a, b).astype(np.int64)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    linked = both * den >= num * (na[:, None] + nb[None, :] - both)
    if lo == hi:
        np.fill_diagonal(linked, False)
    ids_a, ids_b = ([r[0] for r in side] for side in sides)
    copies_a, copies_b = (np.array([r[1] for r in side]) for side in sides)
    out = []
    for links, ids, copies in [(linked, ids_a, copies_b)] + ([] if lo == hi else [(linked.T, ids_b, copies_a)]):
        out += [(ids[i], None, int(copies[links[i]].sum())) for i in np.flatnonzero(links.any(1))]
    shift, names = (0, ids_a) if lo == hi else (len(ids_a), ids_a + ids_b)
    found = ((int(i), int(j) + shift) for i, j in zip(*np.nonzero(linked)))
    return out + [(x, y, 0) for x, y in _forest(found, names)]


def _candidates(docs: DataFrame, maps: DataFrame, width: int, how: PartEnum) -> tuple[DataFrame, str]:
    """node, component: the final clusters of sets, by h1; and where they are written."""
    w = W.partitionBy("sig").orderBy("h1")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, before = F.count("*").over(every), F.array_compact(F.array(*[F.lag("h1", i).over(w) for i in range(1, SMALL)]))
    # the least set stands in each row of its group
    shared = _signed(docs, width, how).select(F.col("h1").alias("b"), n.alias("n"), before.alias("before"), F.first("h1").over(every).alias("least"))
    many = F.col("n") > SMALL
    met = shared.where("n > 1").select("b", many.alias("many"), F.explode(F.when(many, F.array("least")).otherwise(F.col("before"))).alias("a"))
    met, met_path = written(met.where("a != b").distinct(), "met")

    chained, chained_path = written(components(met.where("many").select(F.col("a").alias("u"), F.col("b").alias("v"))), "chained")
    counts = chained.groupBy("component").agg(F.count("*").alias("n"))
    sized = chained.join(counts, "component")
    # a set meets those of its own band of sizes and of the next one
    wide = sized.where(F.col("n") > REFINE).select(F.col("node").alias("h1"), F.col("component").alias("g")).join(maps, "h1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(how.den / how.num * 1.000001)))  # a little wider than a link
    wide = wide.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", F.when(F.col("own"), band).otherwise(band - 1))
    bands = wide.groupBy("g", "band").agg(F.greatest(F.ceil(F.count("*") / WIDE), F.ceil(F.sum(F.octet_length("bits")) / WIDE_BYTES)).cast("int").alias("blocks"))
    wide = _blocks(wide.join(bands, ["g", "band"]), F.col("blocks"), "h1")
    likely = _grouped(wide, ["g", "band", "lo", "hi"], ["h1", "n", "own", "bits", "block", "lo", "hi"], lambda rows: _likely(rows, how.num, how.den), "u long, v long")

    side = lambda s: maps.select(F.col("h1").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    pairs = _bounded(met.where("not many").select("a", "b").join(side("a"), "a").join(side("b"), "b"), how.num, how.den)
    small = sized.where(F.col("n") <= REFINE).select(F.col("node").alias("u"), F.col("component").alias("v"))
    clusters, clusters_path = written(components(pairs.unionByName(likely).unionByName(small)), "clusters")
    dropped(docs.sparkSession, met_path, chained_path)
    return clusters, clusters_path


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, how: PartEnum = PartEnum()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (documents it
    links with, copies included), group_id (a number that the documents of one component share; null for an empty set or
    a null id) and text_hash (xxhash64 of the text, which tells rows that repeat an id apart)."""
    spark = docs.sparkSession
    docs = whole_numbers(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    slim, slim_path = written(_hashed(docs, width), "ids")
    real = F.col("h1").isNotNull() & F.col("doc_id").isNotNull()
    counted = slim.where(real).groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"))
    counted = counted.select("h1", "h2", "n_shingles", "rep.*", "copies").withColumnRenamed("doc_id", "rep")
    # a class is named by its h1; should two have one, all but the first get a name of all that is known of them
    once = F.row_number().over(W.partitionBy("h1").orderBy("h2", "n_shingles"))
    classes, classes_path = written(counted.withColumn("node", F.when(once == 1, F.col("h1")).otherwise(F.xxhash64("h1", "h2", "n_shingles"))), "classes")
    maps = slim.where(real).groupBy("h1").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    clusters, clusters_path = _candidates(docs, maps, width, how)

    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    grouped = clusters.join(sizes, "component").select(F.col("node").alias("h1"), F.col("component").alias("g"), "blocks")
    placed = _blocks(grouped.join(classes.select("node", "rep", "text_hash", "copies", "h1"), "h1"), F.col("blocks"), "node")
    members = placed.hint("merge").join(docs.withColumnRenamed("doc_id", "rep"), ["rep", "text_hash"])
    compare = lambda rows: _compare(rows, width, how.num, how.den)
    checked, checked_path = written(_grouped(members, ["g", "lo", "hi"], ["node", "copies", "block", "lo", "hi", "text"], compare, "node long, partner long, links long"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked, linked_path = written(components(checked.where("partner is not null").select(F.col("node").alias("u"), F.col("partner").alias("v"))), "linked")
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    by_class = (
        classes.join(linked.join(least, "component"), "node", "left")
        .join(links, "node", "left")
        .select("h1", "h2", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group_id"))
    )
    found = slim.where(real).join(by_class, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "n_links", "group_id", "text_hash")
    alone = slim.where(~real).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group_id"), "text_hash")
    out, _ = written(found.unionByName(alone), "joined")
    dropped(spark, slim_path, classes_path, clusters_path, checked_path, linked_path)
    return out
