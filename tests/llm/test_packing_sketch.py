"""Packing, fingerprints and chat formatting."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "it's the<|endoftext|> end, ok.", "a\n\nb", "Ärger,über. naïve 3.5 'll x", "tab\tx", "é b", "a ,b. .c", "don't, can't.", " x y z", "日本 語", "word " * 3000]


def test_encoder_equals_the_tokenizer(spark, data):
    t, e = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for x in texts:
        assert e(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:80]


def test_packing(spark):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(3, ODD[3], 5), (None, None, None), (50, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    out = packing.pack(docs, PATH).collect()
    t = Tokenizer.from_file(PATH)
    whole = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        whole[r["doc_id"]].append(r)
    for i, x in enumerate(ODD):
        if i == 3:
            continue
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
        got = whole[i]
        assert b"".join(bytes(r["ids"]) for r in got) == ids.tobytes()
        assert [r["start"] for r in got] == np.cumsum([0] + [r["length"] for r in got])[:-1].tolist()
        assert all(r["length"] == 1024 for r in got[1:]) and (len(got) == 1 or len(ids) > 1024)
    assert len(whole[3]) == 2 and whole[None][0]["length"] == 1
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    d = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.digest(packing.pack(docs, PATH)).collect()}
    assert d[(0, 0)] == zlib.crc32(b"\x02\x00\x00\x00")
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_few_sequences_at_any_partition_count(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    for parts in (1, 211):
        out = packing.pack(docs.repartition(parts), PATH).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
        assert out[1] <= 1.02 * -(-out[0] // packing.CAPACITY)


def test_bins_are_best_fit():
    """Against a list of open bins searched in full."""
    rng = np.random.default_rng(0)
    b, open_bins, made = packing.Bins(100, 5), {}, 0
    for n in rng.integers(1, 101, 3000).tolist():
        no, offset = b.place(n)
        fit = [(free, k) for k, free in open_bins.items() if free >= n]
        if fit:
            assert open_bins[no] == min(fit)[0] and offset == 100 - open_bins[no]
        else:
            assert no == made and offset == 0
            made += 1
            if n < 100 and len(open_bins) == 5:
                closed = [k for k in open_bins if open_bins[k] == min(open_bins.values())]
                gone = [k for k in closed if not any(k in s for s in b.by_free)]
                assert len(gone) == 1
                del open_bins[gone[0]]
            open_bins[no] = 100
        open_bins[no] -= n
        if open_bins[no] == 0:
            del open_bins[no]


def words(t):
    return [w for w in __import__("re").split(r"[ \t-\r]+", t.lower()) if w]


def sets(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_fingerprints(spark, data):
    real = [(r["doc_id"] * 3 - 50, r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = real + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "one two"), (10**7 + 3, "one two"), (10**7 + 4, "é𝒳 " * 40)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, sketch string, n_chars long")
    got = {r["doc_id"]: r for r in fingerprint.digest(docs).collect()}
    order = sorted((i, t or "") for i, t in rows)
    errors = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((t, edited, "near_edited"), (t, after, "near_next")):
            x, y = sets(a), sets(b)
            true = len(x & y) / len(x | y) if x | y else 1.0
            errors.append(abs(true - r[near]))
            if len(x | y) <= fingerprint.K:
                assert abs(true - r[near]) < 1e-12
    assert np.mean(errors) < 0.02 and max(errors) < 0.2
    assert got[10**7 + 2]["fingerprint"] == got[10**7 + 3]["fingerprint"] and got[10**7]["fingerprint"] == ""
    assert len(got) == len(rows) and fingerprint.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_next_documents(spark, monkeypatch, rows):
    """The chain of next texts over many ranges, with ids and null ids that many rows repeat, and of a table of one row."""
    monkeypatch.setattr(fingerprint, "ROWS", rows)
    monkeypatch.setattr(fingerprint.range_of, "__defaults__", (rows, fingerprint.RANGES))
    data = [(i * 3, f"t{i} a b c d e f") for i in range(60)] + [(30, f"r{i} x y z v w") for i in range(80)] + [(None, f"n{i} p q r s t") for i in range(70)] + [(90, "same text")] * 9
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    h = {r["text"]: r["h"] for r in docs.distinct().selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]], r[1]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    got = fingerprint.digest(docs).collect()
    assert sorted(r["edited_sha256"] for r in got) == want
    texts = dict(zip(want, want))
    assert len(texts) > 150 and all(r["near_edited"] <= 1 for r in got)
    one = fingerprint.digest(spark.createDataFrame([(5, "a b c d e f")], "doc_id int, text string")).first()
    assert one["near_next"] == 1.0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{j}" for j in range(s, s + 400)) for s in (0, 300, 5000)]
    parts = fingerprint.with_sketch(spark.createDataFrame([(t, i, "g") for i, t in enumerate(texts)], "text string, i int, g string"), "text", "sketch")
    whole = fingerprint.merged(parts, "g", "sketch")
    n = whole.select(fingerprint.distinct_count(F.col("sketch")).alias("n")).first()["n"]
    true = len(set().union(*map(sets, texts)))
    assert abs(n - true) / true < 0.25
    a = parts.where("i = 0").select(F.col("sketch").alias("a")).crossJoin(whole.select("sketch"))
    assert a.select(fingerprint.containment(F.col("a"), F.col("sketch")).alias("c")).first()["c"] > 0.7


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "he<|end|>y"), (1, 2, None, None), (2, 0, "system", "be kind"), (3, 5, "ann", "a"), (3, 5, "ann", "a"), (3, None, "bob", "b"), (None, 0, "user", "x"), (4, 70, "ann", "late"), (4, 0, "bob", "early")]
    out = chat.rotate(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, mask string")).collect()
    by = {(r["conv_id"], r["speaker"], r["block"]): r for r in out}
    assert set(by) == {(1, s, 0) for s in ("user", "assistant", "unknown")} | {(c, s, 0) for c in (3, 4) for s in ("ann", "bob")}
    r = by[(1, "assistant", 0)]
    assert r["rendered"] == "<|start|>user name=user\nhi<|end|>\n<|start|>assistant\nhe< |end|>y<|end|>\n<|start|>user name=unknown\n<|end|>\n"
    a, b = map(int, r["mask"].split("-"))
    assert r["rendered"][a:b] == "he< |end|>y<|end|>\n" and by[(3, "ann", 0)]["n_turns"] == 3
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_chat_blocks_are_bounded(spark):
    """A long conversation, most of whose turns have no number or the same one, in blocks of 64 turns at most."""
    from pyspark.sql import functions as F

    turns = spark.range(100_000).select(F.lit(7).cast("long").alias("conv_id"), F.when(F.col("id") > 99_000, F.lit(3)).alias("turn"), F.when(F.col("id") % 2 == 0, "ann").otherwise("bob").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.rotate(turns).select("speaker", "block", "n_turns", F.length("rendered").alias("n")).collect()
    assert max(r["n_turns"] for r in out) == 64 and len(out) == 2 * -(-100_000 // 64)
    for s in ("ann", "bob"):
        assert sum(r["n_turns"] for r in out if r["speaker"] == s) == 100_000


def test_chat_equals_plain_python(spark):
    r = random.Random(4)
    rows = [(c, r.choice([None, t, t // 3]), r.choice(["ann", "bob", "system", None]), r.choice(["a", "", None, "<|x", "é𝒳"])) for c in range(12) for t in range(r.choice([1, 3, 20]))]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    want = {}
    for c in range(12):
        turns = sorted(((t is not None, t or 0, role or "unknown", (text or "").replace("<|", "< |")) for k, t, role, text in rows if k == c))
        for s in {t[2] for t in turns} - {"system"}:
            for block in range(-(-len(turns) // 8)):
                text, mask = "", []
                for *_, role, said in turns[8 * block : 8 * block + 8]:
                    text += "<|start|>" + ("assistant" if role == s else role if role == "system" else f"user name={role}") + "\n"
                    at = len(text)
                    text += said + "<|end|>\n"
                    mask += [f"{at}-{len(text)}"] if role == s else []
                want[c, s, block] = (text, ",".join(mask))
    got = {(x["conv_id"], x["speaker"], x["block"]): (x["rendered"], x["mask"]) for x in chat.rotate(table, per_block=8).collect()}
    assert got == want
