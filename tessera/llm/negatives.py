"""Hard-negative mining by distributed radix selection.

Of the rows with another label whose score is within `low` to 100 per cent of an anchor's positive's score, the best `k`
are wanted for each (anchor, positive): a window of scores. A row's score is its integer inner product with the anchor;
equal scores go by the smaller id.

1. Anchors are taken in blocks of at most about BLOCK (a broadcast of bounded size); each block is held against all rows,
   in as many scans as the selection has rounds. Nothing is paired before it is known to qualify.
2. Positives: each task keeps its best `positives` rows of an anchor; the tasks' rows are ranked together.
3. Rounds: a task counts the rows of each window in RADIX intervals of its scores; the counts of all tasks, added up, tell
   the interval that holds the kth score. It is divided again in the next round, digit by digit, until it holds GATHER
   rows at most. Where one score alone has more (a vector that very many rows repeat), digits of the ids go on from there.
4. A last scan gathers the rows above that bound, k - 1 + GATHER a window at most, which are ranked. Each block's rows are
   written to the shared folder.

Vectors become floor(256 * x) of each component; a label is read as it is, or as the caller's column. Defined cases: rows
with a null id, label or vector, or with a null or non-finite component, take no part; vectors of unlike lengths are not
held against each other; an id that repeats is one anchor (its least label and vector), and as a candidate each of its
rows counts; an anchor's own id is never its positive; empty vectors score 0; scores that no long holds stand at the
long's end; an empty table, or one without anchors, gives an empty result; other columns are ignored; ids and labels must
be whole numbers (else TypeError).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, whole_numbers

K, POSITIVES, LOW = 5, 5, 80
BLOCK, RADIX, GATHER = 1024, 64, 64
#: Scores that a task holds at once.
CELLS = 1 << 21
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the whole-numbered rows of a and b."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    ints = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(ints(a) @ ints(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), width)


class Block:
    """Anchors of one vector length, and the windows that are looked for: `of` the anchor, positive id and score, the
    interval [low, high] that holds the kth score, the ids [first, last] looked at in it, and how many are wanted of it."""

    def __init__(self, anchors: list, width: int):
        self.ids = np.array([r["vec_id"] for r in anchors], np.int64)
        self.labels = np.array([r["label"] for r in anchors], np.int64)
        self.width = width
        self.vectors = np.floor(256 * np.array([r["vector"] for r in anchors], np.float64)).reshape(len(anchors), width)

    def open(self, rows: list, low: int, k: int, ids: tuple[int, int]) -> None:
        """rows: of, positive_id, positive_score. low: per cent."""
        rows = [r for r in rows if r["score"] >= 0]  # below zero the window is empty
        self.of = np.array([r["of"] for r in rows], np.int64)
        self.positive = np.array([r["vec_id"] for r in rows], np.int64)
        self.top = np.array([r["score"] for r in rows], np.int64)
        self.low = np.array([-(-low * r["score"] // 100) for r in rows], np.int64)
        self.high, self.wanted = self.top.copy(), np.full(len(rows), k, np.int64)
        self.first, self.last = (np.full(len(rows), x, np.int64) for x in ids)
        self.live = np.arange(len(rows))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Width of a bucket of the live windows, and whether its digits are the ids'."""
        low, high = self.low[self.live], self.high[self.live]
        by_id = low == high
        span = np.where(by_id, self.last[self.live].view(np.uint64) - self.first[self.live].view(np.uint64), (high - low).view(np.uint64))
        return span // np.uint64(RADIX) + np.uint64(1), by_id

    def narrow(self, counts: dict[int, dict[int, int]]) -> None:
        """counts: of each live window, the rows in each bucket."""
        steps, by_id = self.steps()
        left = []
        for w, step, ids in zip(self.live.tolist(), steps.tolist(), by_id.tolist()):
            found, seen = counts.get(w, {}), 0
            for d in sorted(found):
                if seen + found[d] >= self.wanted[w]:
                    self.wanted[w] -= seen
                    if ids:
                        self.first[w], self.last[w] = int(self.first[w]) + d * step, min(int(self.last[w]), int(self.first[w]) + (d + 1) * step - 1)
                    else:
                        self.low[w], self.high[w] = max(int(self.low[w]), int(self.high[w]) - (d + 1) * step + 1), int(self.high[w]) - d * step
                    one = self.low[w] == self.high[w] and self.first[w] == self.last[w]
                    if found[d] > GATHER and not one:
                        left.append(w)
                    break
                seen += found[d]
        self.live = np.array(left, np.int64)


def _chunks(batches, width: int, cells: int):
    """(ids, labels, vectors) of some rows at a time, so that `cells` of them make no more than CELLS scores."""
    most = max(1, CELLS // max(1, cells))
    for b in batches:
        for at in range(0, len(b), most):
            x = b.slice(at, most)
            yield x.column(0).to_numpy(), x.column(1).to_numpy(), _vectors(x.column(2), width)


def _arrow(names: list[str], columns: list[np.ndarray]):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _positives(rows: DataFrame, block, most: int) -> DataFrame:
    """of, score, vec_id: the best `most` other rows of each anchor's label."""

    def run(batches):
        b = block.value
        of, score, ids = (np.empty(0, np.int64) for _ in range(3))
        floor = np.full(len(b.ids), np.iinfo(np.int64).min)
        for v, labels, vectors in _chunks(batches, b.width, len(b.ids)):
            s = scores(b.vectors, vectors)
            at, row = np.nonzero((s >= floor[:, None]) & (labels == b.labels[:, None]) & (v != b.ids[:, None]))
            of, score, ids = np.concatenate([of, at]), np.concatenate([score, s[at, row]]), np.concatenate([ids, v[row]])
            order = np.lexsort((ids, -score, of))
            of, score, ids = of[order], score[order], ids[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            kth = place == most - 1
            floor[of[kth]] = score[kth]
            of, score, ids = of[place < most], score[place < most], ids[place < most]
        yield _arrow(["of", "score", "vec_id"], [of, score, ids])

    found = rows.mapInArrow(run, "of long, score long, vec_id long")
    best = W.partitionBy("of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def _histogram(rows: DataFrame, block) -> DataFrame:
    """w, bucket, n of the live windows."""

    def run(batches):
        b = block.value
        w, (steps, by_id) = b.live, b.steps()
        of, low, high = b.of[w], b.low[w], b.high[w]
        total = np.zeros(len(w) * RADIX, np.int64)
        anchors, own = np.unique(of, return_inverse=True)
        for v, labels, vectors in _chunks(batches, b.width, len(w)):
            s = scores(b.vectors[anchors], vectors)[own]
            inside = (s >= low[:, None]) & (s <= high[:, None]) & (labels != b.labels[of][:, None])
            if by_id.any():
                inside &= (v >= b.first[w][:, None]) & (v <= b.last[w][:, None]) | ~by_id[:, None]
            at, row = np.nonzero(inside)
            offset = np.where(by_id[at], v[row].view(np.uint64) - b.first[w][at].view(np.uint64), (high[at] - s[at, row]).view(np.uint64))
            total += np.bincount(at * RADIX + (offset // steps[at]).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield _arrow(["w", "bucket", "n"], [w[some // RADIX], some % RADIX, total[some]])

    return rows.mapInArrow(run, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))


def _gathered(rows: DataFrame, block, k: int) -> DataFrame:
    """The rows above each window's bound, ranked."""

    def run(batches):
        b = block.value
        anchors, own = np.unique(b.of, return_inverse=True)
        for v, labels, vectors in _chunks(batches, b.width, len(b.of)):
            s = scores(b.vectors[anchors], vectors)[own]
            ok = (s >= b.low[:, None]) & (s <= b.top[:, None]) & (labels != b.labels[b.of][:, None])
            ok &= (s > b.low[:, None]) | (v <= b.last[:, None])
            w, row = np.nonzero(ok)
            yield _arrow(
                ["w", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
                [w, b.ids[b.of[w]], b.positive[w], v[row], b.top[w], s[w, row]],
            )

    best = W.partitionBy("w").orderBy(F.desc("negative_score"), "negative_id")
    found = rows.mapInArrow(run, "w long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    positives: int = POSITIVES,
    low: int = LOW,
    block: int = BLOCK,
) -> DataFrame:
    """One row per anchor, positive and negative. anchor: which rows are anchors; label: a column over those of the table."""
    spark = embeddings.sparkSession
    embeddings = whole_numbers(embeddings, id_col).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = whole_numbers(rows, "label").withColumn("label", F.col("label").cast("long")).where("label is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.forall("vector", finite))
    anchors = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.*")
    sizes = anchors.groupBy(F.size("vector").alias("width")).count().collect()  # a row a vector length
    ends = rows.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    out = f"{shared_dir(spark)}/tessera/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(f"{out}/part=none")
    for size in sizes:
        width, blocks = size["width"], -(-size["count"] // block)
        alike = rows.where(F.size("vector") == width).select("vec_id", "label", "vector")
        for i in range(blocks):
            own = anchors.where((F.size("vector") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).collect()
            if own:
                b = Block(own, width)
                _mine(alike, b, (ends["a"], ends["b"]), k, positives, low, f"{out}/part={width}-{i}")
    return spark.read.schema(RESULT).option("basePath", out).parquet(f"{out}/part=*").select(*[c.split()[0] for c in RESULT.split(", ")])


def _mine(rows: DataFrame, b: Block, ids: tuple[int, int], k: int, positives: int, low: int, path: str) -> None:
    """Write the negatives of a block's windows."""

    def scanned(action):
        held = rows.sparkSession.sparkContext.broadcast(b)
        try:
            return action(held)
        finally:
            held.destroy()

    b.open(scanned(lambda x: _positives(rows, x, positives).collect()), low, k, ids)  # `positives` rows an anchor
    while len(b.live):
        counts: dict[int, dict[int, int]] = {}
        for r in scanned(lambda x: _histogram(rows, x).collect()):  # RADIX rows a window at most
            counts.setdefault(r["w"], {})[r["bucket"]] = r["n"]
        b.narrow(counts)
    scanned(lambda x: _gathered(rows, x, k).write.parquet(path))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
