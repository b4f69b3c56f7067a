"""Conversation prefix trie by preorder intervals.

Conversations are rebuilt (the first h turns of a base conversation, then their own turns after the first h); each distinct
sequence of first turns is a node. Nodes are ranked in preorder, so a subtree is the interval from a node's rank to its
`end`, and what is summed over a subtree is the difference of two prefix sums. No conversation, node or subtree is ever
gathered: everything below is keyed by a conversation and a block of BLOCK turns, by a node, or by a stretch of ranks.

1. Turns are sorted in ranges by conversation and turn; a turn's place is its rank less that of its conversation's first.
2. A turn's key is the digests of its block's turns up to it, which are at most BLOCK. All rows are sorted in ranges by
   key (and conversation, so the rows of a frequent key lie in many ranges); the dense rank of a key is lexicographic, and
   a prefix comes before what goes on from it. Where conversations are longer than a block, the ranks of full blocks are
   the digests of the next round, whose blocks are BLOCK times longer, until one holds the longest conversation.
3. A node's end is the greatest rank that its members' last turns have. Prefix sums over ranks (running sums of stretches
   and a sum over the stretches) of leaves and savings, taken at a node and at its end, give its leaves and savings.
4. The digest of a node's ends is made of chunks of IDS consecutive ids, which reach it in order as a stream.

Defined cases: turns go by number (null first), then role, then text; null roles and texts are empty; rows without a
conversation are left out; repeated rows are repeated turns; very long texts count whole (a turn is known by 96 bits of
its SHA-256); conversations may be turnless when rebuilt and are then members of the root alone; an empty table has no
nodes; ids must be whole numbers (else TypeError); other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import before, dropped, places, whole_numbers, written

#: Turns of a block; rows of a join key (a power of BLOCK); ids of a chunk.
BLOCK, FINE, IDS = 32, 32 * 32, 4096
#: Least ranks of a stretch, and the most stretches.
STRETCH, STRETCHES = 500, 10_000
#: Children of a node that one join key holds.
CHILDREN = 1 << 16
BASE, HEADS = 5, 9

def _dense(rows: DataFrame, *ties: str) -> tuple[DataFrame, str]:
    """rows (with a string column `key`) without it, with `rank`: the key's dense rank from 0. Rows of one key are spread
    by `ties`. A partition numbers its own keys as they pass; the partitions' counts, less the keys that go on in the next
    partition, are their offsets."""
    names = [c for c in rows.columns if c != "key"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", key string, part int, local long"

    def number(batches):
        last, seen = None, 0
        for b in batches:
            keys = b.column("key")
            if not len(keys):
                continue
            plain = keys.to_numpy(zero_copy_only=False)
            new = np.append(plain[0] != last, plain[1:] != plain[:-1])
            local = seen + np.cumsum(new)
            key = np.full(len(plain), None, object)  # the key itself is needed at the ends of a partition alone
            key[-1] = plain[-1]
            if not seen:
                key[0] = plain[0]
            last, seen, key = plain[-1], int(local[-1]), pa.array(key, pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], key, b.column("part"), pa.array(local, pa.int64())], [*names, "key", "part", "local"])

    dealt = rows.repartitionByRange("key", *ties).sortWithinPartitions("key", *ties).withColumn("part", F.spark_partition_id())
    held, path = written(dealt.mapInArrow(number, schema), "ranks")
    ends = held.where("key is not null").groupBy("part").agg(F.max("local").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    goes_on = F.coalesce((F.lag("last").over(W.orderBy("part")) == F.col("first")).cast("long"), F.lit(0))
    sizes = ends.select("part", "n", goes_on.alias("on"))
    so_far = F.sum("on").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    offsets = sizes.select("part", (before("n") - so_far - 1).alias("offset"))  # a row a partition
    return held.join(F.broadcast(offsets), "part").select(*names, (F.col("local") + F.col("offset")).alias("rank")), path


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(conv_id, d, token, bytes, length): the turns of each rebuilt conversation, d from 1; and (conv_id, length) of all;
    and the path of the table that both read. turns: conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    token = F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 24)
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "text"]
    held, path = places(rows, order[:4], order, ["conv_id", token.alias("token"), F.octet_length("text").cast("long").alias("bytes")])

    parts = held.groupBy("conv_id", "part").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    sizes = parts.groupBy("conv_id").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % BASE
    convs = (
        sizes.select("conv_id", "start", "n", base.alias("base"), head_length(F.col("conv_id")).alias("h"))
        .join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    known = parts.select("conv_id", "part").join(convs.select("conv_id", "start", "h", "head", "length"), "conv_id")
    placed = held.join(known, ["conv_id", "part"]).withColumn("pos", F.col("place") - F.col("start") + 1)
    own = placed.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "token", "bytes", "length")
    firsts = placed.where((F.col("pos") < HEADS) & (F.col("conv_id") % BASE == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "token", "bytes")
    heads = convs.select("conv_id", "base", "head", "length").join(firsts, "base").where("d <= head").select("conv_id", "d", "token", "bytes", "length")
    return heads.unionByName(own), convs.select("conv_id", "length"), path


def _ranked(turns: DataFrame, block: int) -> tuple[DataFrame, str]:
    """conv_id, d, bytes, length, rank: preorder ranks from 1 of the node that each turn ends."""
    index = lambda unit: F.floor((F.col("d") - 1) / unit).cast("long")
    upto = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    keyed = turns.withColumn("block", index(block)).withColumn("key", F.array_join(F.collect_list("token").over(upto), ""))  # `block` turns at most
    ranks, path = _dense(keyed.select("conv_id", "d", "bytes", "length", "key"), "conv_id")
    longest, unit = ranks.agg(F.max("d")).first()[0] or 0, block
    while unit < longest:
        token = F.lpad(F.hex("rank"), 16, "0")
        units = ranks.groupBy("conv_id", index(unit).alias("unit")).agg(F.max(F.when(F.col("d") % unit == 0, token)).alias("token"))
        above = W.partitionBy("conv_id", F.floor(F.col("unit") / block)).orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
        heads = units.select("conv_id", "unit", F.array_join(F.collect_list("token").over(above), "").alias("head"))
        fine = min(unit, FINE)  # a join key has so many rows at most
        heads = heads.select("conv_id", "head", F.explode(F.sequence(F.col("unit") * (unit // fine), F.col("unit") * (unit // fine) + (unit // fine - 1))).alias("fine"))
        keyed = ranks.withColumn("fine", index(fine)).join(heads, ["conv_id", "fine"]).withColumn("key", F.concat("head", token))
        last = path
        ranks, path = _dense(keyed.select("conv_id", "d", "bytes", "length", "key"), "conv_id")
        dropped(turns.sparkSession, last)
        unit *= block
    return ranks.withColumn("rank", F.col("rank") + 1), path


def _nodes(ranks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """rank, conv_id, depth, n_convs, bytes, end of each node, the root included."""
    index = F.floor((F.col("d") - 1) / block).cast("long")
    last = ranks.where("d = length").select("conv_id", F.col("rank").alias("last"), F.explode(F.sequence(F.lit(0), index)).alias("block"))
    nodes = (
        ranks.withColumn("block", index)
        .join(last, ["conv_id", "block"])
        .groupBy("rank")
        .agg(F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.max("last").alias("end"))
    )
    most = ranks.agg(F.max("rank")).first()[0] or 0
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("rank"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), F.lit(most).cast("long").alias("end"))
    return nodes.unionByName(root)


def _summed(nodes: DataFrame) -> DataFrame:
    """nodes with leaves and saved: prefix sums up to and with each node; own_leaf and own_saved are its own."""
    own = nodes.withColumn("own_leaf", (F.col("end") == F.col("rank")).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes"))
    most = nodes.agg(F.max("rank")).first()[0] or 0
    own = own.withColumn("stretch", F.floor(F.col("rank") / max(STRETCH, -(-most // STRETCHES))))
    along, earlier = W.partitionBy("stretch").orderBy("rank"), W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = own.groupBy("stretch").agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    offsets = sums.select("stretch", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ls"])  # STRETCHES rows and one at most
    return own.join(F.broadcast(offsets), "stretch").select(
        *nodes.columns, "own_leaf", "own_saved", (F.sum("own_leaf").over(along) + F.col("l0")).alias("leaves"), (F.sum("own_saved").over(along) + F.col("s0")).alias("saved")
    )


def _ends(members: DataFrame) -> DataFrame:
    """rank, ends_sha256 of (rank, conv_id): a digest of the ids in order. A digest reads its ids one after another, so a
    node's chunks meet in one task; it keeps none of them."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = members.groupBy("rank", F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(ids.alias("ids"))

    def digest(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for rank, ids in zip(b.column("rank").to_pylist(), b.column("ids").to_pylist()):
                if rank != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = rank, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["rank", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["rank", "ends_sha256"])

    return chunks.repartition("rank").sortWithinPartitions("rank", "chunk").mapInArrow(digest, "rank long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = whole_numbers(conversations, conv_col).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    built, convs, turns_path = rebuilt(turns)
    convs, _ = written(convs, "convs")
    ranks, _ = _ranked(built, block)
    dropped(turns.sparkSession, turns_path)
    nodes, _ = written(_nodes(ranks, convs, block), "nodes")
    members = ranks.where("d = length").select("rank", "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("rank"), "conv_id"))

    summed = _summed(nodes)
    # the sums at a node's end, which is a leaf: a path has BLOCK nodes of one band at most
    band = F.floor(F.col("depth") / block)
    at_end = summed.where("own_leaf = 1").select(F.col("rank").alias("end"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"), F.explode(F.sequence(F.lit(0).cast("long"), band)).alias("band"))
    parents = nodes.where("depth > 1").select("rank", "conv_id", (F.col("depth") - 1).alias("d")).join(ranks.select("conv_id", "d", F.col("rank").alias("parent")), ["conv_id", "d"]).select("rank", "parent")
    parents = parents.unionByName(nodes.where("depth = 1").select("rank", F.lit(0).cast("long").alias("parent")))
    children = parents.groupBy(F.col("parent").alias("rank")).agg(F.count("*").alias("n_children"))
    far = F.floor((F.col("rank") - F.col("parent")) / CHILDREN)
    tops = nodes.select(F.col("rank").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("rank")) / CHILDREN))).alias("far"))
    above = parents.withColumn("far", far).join(tops, ["parent", "far"]).select("rank", "parent_conv_id")
    return (
        summed.withColumn("band", band)
        .join(at_end, ["end", "band"])
        .join(above, "rank", "left")
        .join(children, "rank", "left")
        .join(_ends(members), "rank", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            (F.col("end_leaves") - F.col("leaves") + F.col("own_leaf")).alias("n_leaves"),
            (F.col("end_saved") - F.col("saved") + F.col("own_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM sizes),
s AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN sizes b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, d, strlen(text) AS bytes,
         sha256(CAST(to_json(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d)) AS VARCHAR)) AS k
  FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY d, k),
up AS (SELECT DISTINCT b.k, a.k AS parent FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d + 1 = b.d),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
below AS (SELECT DISTINCT a.k AS top, b.k FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
tree AS (
  SELECT below.top AS k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM below JOIN n ON n.k = below.k LEFT JOIN kids ON kids.k = below.k GROUP BY below.top),
last AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
ends AS (SELECT p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN last ON p.conv_id = last.conv_id AND p.d = last.d GROUP BY p.k)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       CAST(tree.n_leaves AS BIGINT) AS n_leaves, CAST(tree.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM n JOIN tree ON tree.k = n.k LEFT JOIN up ON up.k = n.k LEFT JOIN n m ON m.k = up.parent
     LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k
"""
