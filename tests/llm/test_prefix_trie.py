"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, rank int, part string, key string"


def plain(rows):
    own = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c > 0 else -1))
        full = own.get(base, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            n = nodes.setdefault(tuple(full[:d]), {"members": [], "ends": []})
            n["members"].append(c)
        nodes[tuple(full)]["ends"].append(c)
    out = {k: [min(n["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]), 0, 0, 0, hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()] for k, n in nodes.items()}
    for k in nodes:
        if k:
            out[k[:-1]][4] += 1
    for k, row in list(out.items()):
        leaf, saved = row[4] == 0, (row[3] - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            out[k[:d]][5] += leaf
            out[k[:d]][6] += saved
    return sorted(map(tuple, out.values()), key=repr)


def found(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table, **how).collect()), key=repr)


def odd_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 1003, 1007, 2**62, -(2**62)]:
        for t in range(r.choice([1, 2, 5, 9, 12, 20])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "bot", None, ""]), r.choice(["a", "b", "", None, "é𝒳", "user"])))
    rows += [(None, 1, "user", "x"), (100, 0, "user", "z" * 50_000), (105, 0, "user", "z" * 50_000), (110, 0, "us", "erz"), (115, 0, "user", "z"), (120, 1, "a", "b"), (120, 1, "a", "b"), (125, 1, "a", "b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2, 32])
def test_equals_plain_python(spark, block):
    rows = odd_rows()
    assert found(spark, rows, block=block) == plain(rows)


def test_long_conversations_that_share_their_start(spark):
    """Four rounds of ranks, and no join key with more than a bounded number of rows."""
    rows = [(c, t, "user", f"{t * t % 7}") for c in (0, 5, 10) for t in range(300 if c < 10 else 200)]
    rows += [(c, t, "user", "same") for c in range(1000, 1300, 5) for t in range(2)]
    assert found(spark, rows, block=5) == plain(rows)


def test_keys_of_many_rows_lie_in_many_ranges(spark):
    rows = [(c * 5, 0, "user", "first") for c in range(3000)] + [(c * 5, 1, "user", str(c)) for c in range(0, 3000, 3)]
    built, _, _ = prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    keyed = built.select("conv_id", F.col("token").alias("key"))
    ranks, _ = prefix_trie._dense(keyed, "conv_id")
    assert ranks.where(F.col("rank") >= 0).groupBy("rank").count().agg(F.max("count")).first()[0] >= 1500
    assert ranks.count() == keyed.count() and ranks.agg(F.max("rank")).first()[0] == keyed.select("key").distinct().count() - 1
    assert found(spark, rows) == plain(rows)


def test_empty_and_wrong_tables(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
    with pytest.raises(TypeError):
        prefix_trie.prefix_trie(spark.createDataFrame([("a", 1, "b", "c")], "conv_id string, turn int, role string, text string"))
