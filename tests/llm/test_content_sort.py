"""Exact dedup against plain Python: odd rows, groups that span many ranges, and the splitters."""

import hashlib
import random
import re

import pytest

from tessera.llm import content_sort

SCHEMA = "doc_id long, text string, norm string, bucket string, sha string"


def plain(rows):
    groups = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[2], members[0][2], len(members), n == 0, sha) for n, m in enumerate(members)]
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in content_sort.exact_dedup(docs, **how).collect()), key=repr)


def odd_rows():
    r = random.Random(3)
    texts = ["", None, " \t\r\n\x0b\x0c", "a b", "ab", "a b", "é", "é", "𝒳 x", "\x00", "\x00\x00", "a" * 50_000, "a" * 50_000 + " ", "a" * 49_999 + "b"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "a b"), (None, "a b"), (5, "ab"), (5, "ab"), (-7, "a b"), (-(2**63), "tie"), (2**63 - 1, "tie")]
    rows += [(1000 + i, "common start " * 5 + r.choice("xyz") * r.randint(0, 3)) for i in range(300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_bytes", [1000, 1 << 25])
def test_equals_plain_python(spark, range_bytes):
    rows = odd_rows()
    assert found(spark, rows, range_bytes=range_bytes) == plain(rows)


def test_one_group_is_cut_into_many_ranges(spark):
    rows = [(i, "same " + "text" + " " * (i % 3)) for i in range(2000)] + [(10_000 + i, f"own {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ends = content_sort._runs(docs, 10_000)
    assert ends.where("n > 1").select("bucket").distinct().count() > 20  # no range holds the group
    assert ends.groupBy("bucket").count().agg({"count": "max"}).first()[0] < 300
    assert found(spark, rows, range_bytes=10_000) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(None, "x")] * 400 + [(1, None)] * 400
    assert found(spark, rows, range_bytes=1000) == plain(rows)
    assert found(spark, []) == []


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        content_sort.exact_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = content_sort._runs(docs, 1000)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
