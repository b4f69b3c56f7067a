"""Joins, alignment and models against brute force, and their edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, ngram_join, quality, toxicity
from tessera.llm.components import components
from tessera.llm.queries import QUERIES


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n, num, den):
    s = {i: shingles(t, n) for i, t in rows}
    root, links = {i: i for i in s}, dict.fromkeys(s, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(s[a] & s[b])
            if both and den * both >= num * (len(s[a]) + len(s[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), links[i]) for i in ids}


def family(r, n_words, copies, edits):
    base = [f"w{r.randint(0, 10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,num,refine", [(3, 90, 10), (5, 80, 10), (5, 80, 512)])
def test_jaccard_join(spark, width, num, refine, monkeypatch):
    """Families of near copies about the threshold, large and small sets, copies, boilerplate; blocks of 16 sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "REFINE", refine)
    monkeypatch.setattr(ngram_join, "WIDE", 32)
    r = random.Random(width)
    texts = ["", " ", "one", "One", "one two", "a b c d e f", "A b c d e f"] + family(r, 120, 60, 4) + family(r, 30, 60, 1) + family(r, 12, 20, 1) + family(r, 600, 12, 20)
    texts += [f"shared head line of eight words here {x}" for x in family(r, 8, 30, 3)] + ["copy of one text again and again"] * 40
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(None, "one", "x", 0), (9999, None, "x", 0)], "doc_id long, text string, rep string, h1 int").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in ngram_join.jaccard_join(docs, width=width, how=ngram_join.PartEnum(num, 100)).collect()}
    assert got.pop(None) == (1, None, 0) and got.pop(9999) == (0, 9999, 0)
    assert got == brute(rows, width, num, 100)
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0


def test_signatures_meet():
    """Any two sets that link share a signature."""
    r = random.Random(1)
    for num in (80, 90):
        how, met = ngram_join.PartEnum(num, 100), 0
        for _ in range(400):
            n = r.choice([5, 9, 10, 14, 20, 40, 90, 300])
            a = {r.getrandbits(63) for _ in range(n)}
            b = set(a)
            for _ in range(r.randint(0, max(1, n * (100 - num) // 100))):
                b.discard(r.choice(sorted(b)))
                if r.random() < 0.5:
                    b.add(r.getrandbits(63))
            if b and 100 * len(a & b) >= num * len(a | b):
                met += 1
                s = [set(how.signatures(np.array(sorted(x), np.uint64)).tolist()) for x in (a, b)]
                assert s[0] & s[1]
        assert met > 100


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(r.randint(400, 600), r.randint(400, 600)) for _ in range(150)] + [(700, 700), (5, 4)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(10_000, 10_001 + i) for i in range(400)], "u long, v long")
    assert {r["component"] for r in components(chain).collect()} == {0, 10_000}
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)


def test_salted_signatures():
    """Sets that shared a signature still hang together, and a hot signature keeps a bounded number of rows."""
    r = np.random.default_rng(0)
    sig = np.concatenate([r.integers(-(2**62), 2**62, 500), np.full(400, 7), np.full(5, 8), np.full(ngram_join.SMALL, 9), np.full(ngram_join.SMALL + 1, 10)])
    h = np.arange(len(sig))
    order = r.permutation(len(sig))
    got_h, got_s = ngram_join.salted(h[order], sig[order])
    groups = {}
    for a, b in zip(got_h.tolist(), got_s.tolist()):
        groups.setdefault(b, set()).add(a)
    assert max(len(v) for k, v in groups.items() if k == 7) == ngram_join.SMALL + 1
    want = [set(h[sig == s].tolist()) for s in (7, 8, 9, 10)]
    assert all(any(w == g for g in groups.values()) for w in want)
    assert all(s not in sig or len(groups[s]) > ngram_join.SMALL for s in groups if len(groups[s]) > ngram_join.SMALL)


def test_bitmaps_bound_the_intersection():
    r = random.Random(3)
    sets = []
    for n in (1, 3, 20, 100, 130, 500, 1100, 3000, 20_000):
        base = [r.getrandbits(63) for _ in range(n)]
        for _ in range(6):
            some = base[: r.randint(max(1, int(n * 0.75)), n)]
            sets.append(np.unique(np.array([r.getrandbits(63) if r.random() < 0.03 else x for x in some], np.uint64)))
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert len(links) > 20
    for blocks in (1, 2):
        rows = [(i, len(f), True, ngram_join.bitmap(f), i % blocks, 0, blocks - 1) for i, f in enumerate(sets)]
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in ngram_join._likely(rows, 80, 100):
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in links if blocks == 1 or a % 2 != b % 2)
        assert len({find(i) for i in range(len(sets))}) > 8  # unlike sets stay apart


def test_join_of_repeated_ids(spark):
    """Rows of one id are rows of their own; a repeated id costs no text twice; other ids than whole numbers are refused."""
    a, b, c = ("a b c d e f g h", "x y z u v w r s", "p q")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), *[(1, a)] * 50, (None, a), (5, "")]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_links"], r["component_id"]) for r in got}
    assert by == {(1, 51, 1), (1, 1, 1), (2, 51, 1), (3, 1, 1), (4, 0, 4), (None, 0, None), (5, 0, 5)}
    assert len({r["group_id"] for r in got}) == 4
    with pytest.raises(TypeError):
        ngram_join.jaccard_join(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 40))
        assert decontamination.align(a, b)[0] == smith_waterman(a, b)


def test_leaks(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)] + [(20, None), (21, ""), (22, "two words"), (None, "x y z")]
    filler = lambda n: " ".join(word() for _ in range(n))

    def edited(t, share):
        return " ".join(word() if r.random() < share else w for w in t.split())

    docs, want = [], set()
    for i in range(20):
        docs.append((i, f"{filler(300)} {items[i][1].upper()}. {filler(200)}"))
        docs.append((100 + i, f"{filler(30)}\n{edited(items[i][1], 0.15)}, {filler(20)}"))
        want |= {(i, i), (100 + i, i)}
    docs += [(200 + i, filler(400)) for i in range(60)] + [(300 + i, f"{filler(5)} {items[0][1]} {filler(5)}") for i in range(120)] + [(500, None), (501, ""), (None, items[1][1]), (502, "has two, WORDS in it")]
    want |= {(300 + i, 0) for i in range(120)} | {(502, 22)}
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items + [items[3]], "item_id long, text string")
    got = decontamination.leaks(d, b).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert all(x["score"] == 1.0 for x in got if x["doc_id"] < 100)
    left = decontamination.decontaminate(d, b)
    assert left.columns == d.columns and {x["doc_id"] for x in left.collect()} == {x[0] for x in docs} - {x for x, _ in want} - {None}  # the row without an id leaks as well
    assert decontamination.leaks(d.limit(0), b).count() == 0 and decontamination.leaks(d, b.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(6)]
    docs = [(i, f"before {t} after") for i, t in items]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(i, i) for i in range(6)}


@pytest.mark.parametrize("every", [3, 1])
def test_leaks_of_frequent_items(spark, every):
    """Exact, edited and short copies held by a third and by all of the rows; a few rows share one frequent seed alone."""
    r = random.Random(11)
    item, short = [f"q{j}" for j in range(15)], "a b"
    edited = [w if j % 4 else f"e{j}" for j, w in enumerate(item)]
    filler = lambda n: " ".join(f"f{r.randint(0, 10**6)}" for _ in range(n))
    docs, want = [], set()
    for i in range(90):
        some = [" ".join(item), " ".join(edited), f"x {short} y"][i // 3 % 3] if i % every == 0 else filler(9)
        docs.append((i, f"{filler(20)} {some} {filler(20)}"))
        want |= {(i, i // 3 % 3 // 2)} if i % every == 0 else set()
    docs += [(100 + i, f"{filler(9)} q1 q2 q3 {filler(9)}") for i in range(every - 1)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item)), (1, short)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(d, b).collect()} == want


def test_windows_in_slices(monkeypatch):
    """Windows are the same whatever number of places is taken at a time, and hold every alignment of the least score."""
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(1, 14)))) for i in range(30)]
    s = decontamination.Seeds(items, 0.4)
    for n in [0, 1, 2, 30, 200] * 4:
        ids = np.array([s.vocabulary.get(r.choice("abcdefghijkl").encode(), 0) for _ in range(n)], np.int64)
        monkeypatch.setattr(decontamination, "SLICE", 1 << 20)
        want = s.windows(ids).tolist()
        for size in (1, 7):
            monkeypatch.setattr(decontamination, "SLICE", size)
            assert s.windows(ids).tolist() == want
        for i, a in enumerate(s.texts):
            score, end = decontamination.align(a, ids)
            if score >= s.least[i]:
                start = end - decontamination.align(a[::-1], ids[:end][::-1])[1]
                assert any(j == i and lo <= start and end <= hi for j, lo, hi in want)


@pytest.mark.parametrize("kind", ["replaced", "dropped", "added", "mixed"])
def test_no_pair_at_or_above_the_share_is_lost(spark, kind):
    """Against Smith-Waterman over all pairs, at 0 to 40 % of the words edited, regularly (every third word: no three in a
    row are left) and at random."""
    r = random.Random(kind)
    words = [f"v{j}" for j in range(300)]
    pick = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, pick(r.choice([9, 15, 40]))) for i in range(12)]

    def edited(w, hit):
        out = []
        for j, x in enumerate(w):
            how = r.choice(["replaced", "dropped", "added"]) if kind == "mixed" else kind
            out += [x] if not hit(j) else {"replaced": ["e"], "dropped": [], "added": [x, "e"]}[how]
        return out

    docs = []
    for i, w in items:
        for hit in [lambda j: False, lambda j: j % 3 == 2, lambda j: j % 2, *[lambda j, p=p: r.random() < p for p in (0.1, 0.2, 0.33, 0.4)]]:
            docs.append((len(docs), pick(30) + edited(w, hit) + pick(30)))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.leaks(d, b).collect()}
    number = {x: j for j, x in enumerate([*words, "e"])}
    best = {(i, k): decontamination.align(np.array([number[x] for x in w]), np.array([number[x] for x in t]))[0] for i, t in docs for k, w in items}
    want = {(i, k): v / (2 * len(items[k][1])) for (i, k), v in best.items() if v >= decontamination.least_score(len(items[k][1]), 0.4)}
    assert got == want and len(want) > 40


def test_gradients():
    net, r = toxicity.Network(), np.random.default_rng(0)
    x, w, t = r.normal(0, 1, (40, toxicity.INPUT)), r.integers(0, 40, (6, toxicity.WINDOW)), np.array([1.0, 0, 1, 0, 0, 1])

    def loss():
        s = 1 / (1 + np.exp(-net.logits(net.project(x), w)))
        return -(t * np.log(s) + (1 - t) * np.log(1 - s)).mean()

    g, dx = net.gradients(x, w, t, np.ones(6))
    for p, d in [*((net.p[k], g[k]) for k in g), (x, dx)]:
        for _ in range(3):
            i = tuple(r.integers(0, s) for s in p.shape)
            old, e = p[i], 1e-5
            p[i] = old + e
            up = loss()
            p[i] = old - e
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * e) - d[i]) < 1e-6


def corpus(spark, n, make, seed):
    r = random.Random(seed)
    rows = [(i, *make(r)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int"), rows


VOCAB = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "mo", "ta")]


def test_toxicity(spark):
    bad = ["vilify", "scumbag", "loathe", "filthy"]

    def make(r):
        w = [r.choice(VOCAB) for _ in range(r.randint(3, 160))]
        y = int(r.random() < 0.3)
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(bad)
        return " ".join(w), y

    docs, rows = corpus(spark, 500, make, 1)
    docs = docs.unionByName(spark.createDataFrame([(1000, None, 0), (1001, "", 0), (None, "x", 0)], docs.schema))
    learn = F.col("doc_id") % 4 != 2
    net = toxicity.fit(docs, docs.select("doc_id", F.col("y").alias("toxic")), learn)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, net).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert len(got) == 503 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.93 and got[1000] == got[1001] < 0.3
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", F.col("y").alias("toxic")).limit(0), learn) is None
    assert toxicity.scored(docs, None).agg(F.max("score")).first()[0] == 0.0 and toxicity.scored(docs.limit(0), net).count() == 0


def test_toxicity_of_very_long_and_repeated_rows(spark):
    """A toxic passage is found wherever it stands in a long text; rows that repeat an id are scored one by one."""
    r = random.Random(5)
    fill = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    bad = "vilify scumbag loathe filthy vilify loathe"
    rows = [(i, f"{fill(30)} {bad} {fill(30)}" if i % 2 else fill(70), i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 0), (1, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, F.lit(True))
    long = fill(20_000).split()
    odd = [(1, " ".join(long)), (1, " ".join(long[:15_003] + bad.split() + long[15_003:])), (1, " ".join(long)), (None, bad), (None, None)]
    got = [x["score"] for x in toxicity.scored(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), net).collect()]
    assert len(got) == 5 and got[0] == got[2] and got[1] > 0.3 > got[4] and got[1] > got[0]


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_risk_gradient(shift):
    """Against finite differences, with the negative part above 0 and below it."""
    r = np.random.default_rng(2)
    p, u = r.normal(0, 1, (30, 6)), r.normal(0, 1, (50, 6))
    net, prior = quality.Net(np.concatenate([p, u])), 0.9
    p = p + shift * net.w[0] @ net.w[2] / np.linalg.norm(net.w[0] @ net.w[2])

    def risk():
        sp, su = net.score(p), net.score(u)
        negative = -np.log(1 - su + 1e-9).mean() + prior * np.log(1 - sp + 1e-9).mean()
        return prior * -np.log(sp).mean() + negative if negative >= 0 else -negative

    sp, su = net.score(p), net.score(u)
    below = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean() < 0
    assert below == (shift > 0)
    for w, g in zip(net.w, net.gradients(p, u, prior)):
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in w.shape)
            old, e = w[i], 1e-5
            w[i] = old + e
            up = risk()
            w[i] = old - e
            down = risk()
            w[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-6


def test_prior_by_plain_thresholds():
    r = np.random.default_rng(4)
    for share in (0.3, 0.8):
        pos = r.beta(6, 2, 800)
        unl = np.where(r.random(1500) < share, r.beta(6, 2, 1500), r.beta(2, 6, 1500))
        slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(1500) + 1 / np.sqrt(800))
        best = min((((unl >= c).mean() + slack) / (pos >= c).mean(), (unl >= c).mean() / (pos >= c).mean()) for c in np.unique(pos))
        assert quality.prior(pos, unl) == pytest.approx(min(0.99, max(0.05, best[1]))) and abs(quality.prior(pos, unl) - share) < 0.12


def test_scorer_equals_a_loop_over_windows():
    r = random.Random(6)
    net = toxicity.Network()
    net.learn([[w.encode() for w in r.choices(VOCAB[:20], k=30)] for _ in range(6)], [[w.encode() for w in r.choices(VOCAB[20:], k=40)] for _ in range(12)], passes=1)
    texts = [None, "", "one", " ".join(r.choices(VOCAB, k=24)), " ".join(r.choices(VOCAB, k=25)), " ".join(r.choices(VOCAB, k=150))]
    got = toxicity.Scorer(net)(texts)
    for t, score in zip(texts, got):
        w = toxicity.words(t)
        best = -np.inf
        for s in toxicity.starts(len(w)):
            own = w[s : s + toxicity.WINDOW]
            rows = np.zeros((toxicity.WINDOW + 1, toxicity.INPUT), np.float32)
            for i, x in enumerate(own):
                rows[i + 1] = net.inputs([x])[0]
            at = [i + 1 if i < len(own) else 0 for i in range(toxicity.WINDOW)]
            best = max(best, float(net.logits(net.project(rows), np.array([at]))[0]))
        assert score == pytest.approx(1 / (1 + np.exp(-(net.slope * best + net.shift))), abs=1e-5)


def test_quality(spark):
    def make(r):
        y = int(r.random() < 0.8)
        w = [r.choice(VOCAB) for _ in range(r.randint(20, 200))]
        return (" ".join(w) if y else " ".join(x.upper() + "!!" for x in w)), y

    docs, rows = corpus(spark, 600, make, 2)
    labels = docs.where("y = 1 and doc_id % 2 = 0").select("doc_id", F.col("y").alias("quality"))
    net, prior = quality.fit(docs, labels, F.lit(True))
    assert abs(prior - 0.8) < 0.12
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, (net, prior)).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows]) > 0.97
    odd = spark.createDataFrame([(1, None), (None, ""), (1, "x" * 100_000)], "doc_id long, text string")
    assert quality.scored(odd, (net, prior)).count() == 3 and quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {0.5}


def test_language(spark):
    import collections

    r = random.Random(3)
    speech = {"aa": ["kova", "lanu", "mira"], "bb": ["schtz", "grumpf", "wort"], "cc": ["été", "ñandú", "où"]}
    rows = [(i, " ".join(r.choice(speech[x]) for _ in range(30)) + ".", x) for i in range(90) for x in [r.choice(sorted(speech))]]
    docs = spark.createDataFrame(rows + [(200, None, "aa"), (201, " 12 !", "bb"), (202, "", None), (None, "kova", None)], "doc_id long, text string, lang string")
    learnt = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = {x["doc_id"]: x for x in langid.identify(docs, learnt).collect()}
    (profiles,) = learnt.groups()
    assert all(got[i]["lang_pred"] == x for i, _, x in rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    (nothing,) = langid.fit(docs.limit(0), F.lit(True)).groups()
    assert nothing.predict("kova") == ("und", 0.0)
    # counts and distances against plain Python
    text = "Kova, ñ kova!"
    padded = "_kova_ñ_kova_"
    plain = collections.Counter(c for c in padded if c != "_") + collections.Counter(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    keys, counts = langid.grams(text)
    code = lambda g: int(sum((1 if c == "_" else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)))
    assert dict(zip(keys.tolist(), counts.tolist())) == {code(g): n for g, n in plain.items()}
    top = langid.ranked(keys, counts, profiles.most).tolist()
    costs = []
    for j in range(len(profiles.langs)):
        rank = {int(k): int(v) for k, v in zip(profiles.tables[0][0], profiles.tables[0][1][:-1, j]) if v >= 0}
        costs.append(sum(abs(rank[k] - p) if k in rank else profiles.most for p, k in enumerate(top)))
    assert profiles.predict(text)[0] == profiles.langs[int(np.argmin(costs))]


def test_any_number_of_languages(spark, monkeypatch):
    """Groups and tables of languages, held against the texts one after another, predict what one group does."""
    letters = [chr(0x4E00 + i) for i in range(1001)]
    rows = [(i, f"{c}{c} common {c} word {c}{c}{c}", f"l{i:04}") for i, c in enumerate(letters)]
    rows += [(5000, "a" * 200_000, None), (5001, None, None), (5001, "12", None), (None, letters[3], None), (None, letters[3], None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, total string, cost int")
    one = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    monkeypatch.setattr(langid, "GROUP", 300)
    learnt = langid.fit(docs, F.lit(True))
    assert learnt.parts == 4
    many = langid.identify(docs, learnt).collect()
    key = lambda x: (x["doc_id"] or -1, x["lang_pred"], round(x["score"], 9))
    assert sorted(map(key, one)) == sorted(map(key, many))
    got = {x["doc_id"]: x["lang_pred"] for x in many if x["doc_id"] is not None}
    assert all(got[i] == lang for i, _, lang in rows[:1001]) and got[5001] == "und" and len(many) == len(rows)
    assert [x["lang_pred"] for x in many if x["doc_id"] is None] == ["l0003"] * 2


def test_fits_are_bounded(spark, monkeypatch):
    """One id repeated very often is learnt once."""
    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words number "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"other text {i}", "bb") for i in range(2, 40)], docs.schema))
    labels = spark.createDataFrame([(i, 1, int(i < 5)) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda p, u: seen.append((len(p), len(u))))
    quality.fit(docs, labels, F.lit(True), positives=10, unlabelled=20)
    assert seen == [(10, 20)]
    learnt = []
    monkeypatch.setattr(toxicity.Network, "learn", lambda self, t, c: learnt.append((len(t), len(c))) or self)
    toxicity.fit(docs, labels, F.lit(True), toxic=3, clean=10)
    assert learnt == [(3, 10)]
    (profiles,) = langid.fit(docs, F.lit(True), sample=5).groups()
    assert set(profiles.langs) == {"aa", "bb"}


def test_stages_on_odd_rows(spark, data):
    """Null and repeated ids, null, empty and very long texts, an extra column and an empty table pass every stage."""
    import corpus_pipeline as P

    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "a b c d e f g"), (3, None), (4, ""), (5, long), (6, long), (None, "a b c d e f g"), (None, None), (7, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rep string")
    kept = P.near_duplicate_stage(spark, docs, data)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or -1, (r["text"] or "")[:9]) for r in kept.collect()))
    assert got == sorted([(1, "a b c d e"), (1, "one two t"), (3, ""), (4, ""), (5, "word0 wor"), (-1, "a b c d e"), (-1, ""), (7, "  ")])
    clash = docs.withColumns({"__kept_id": F.lit(1), "__kept_rows": F.lit("x"), "group_id": F.lit(2), "text_hash": F.lit(3)})
    again = P.near_duplicate_stage(spark, clash, data)
    assert again.columns == clash.columns and again.count() == len(got)
    for name, stage in P.STAGES:
        out = stage(spark, docs, data)
        n = out.count()
        assert stage(spark, docs.limit(0), data).count() == 0
        assert n == len(rows) or name in ("quality_classifier", "ngram_jaccard_join", "bestfit_packing")
        assert name == "bestfit_packing" or out.columns == docs.columns


def test_pipeline(spark, data):
    """Each stage by plain means on what the one before kept."""
    import corpus_pipeline as P
    from tessera.llm import packing, pii
    from tessera.llm.common import table

    docs = table(spark, data, "documents")
    by_id = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, table(spark, data, "labels"), F.lit(True))
    keep = [i for i, r in by_id.items() if model[0].score(quality.features(r["text"])[None])[0] >= quality.THRESHOLD]
    got = P.quality_stage(spark, docs, data)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(keep)
    groups = brute([(i, by_id[i]["text"]) for i in keep], 5, 80, 100)
    keep = [i for i in keep if groups[i][1] == i]
    kept = P.near_duplicate_stage(spark, got, data)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(keep)
    leaks = {r["doc_id"] for r in decontamination.leaks(kept, table(spark, data, "benchmark")).collect()}
    keep = [i for i in keep if i not in leaks]
    masked = P.pii_stage(spark, P.decontamination_stage(spark, kept, data), data)
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts == {i: pii.redacted(by_id[i]["text"]) for i in keep}
    enc = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts.items():
        ids = enc(t) + b"\2\0\0\0"
        want |= {(i, k): zlib.crc32(ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(packing.cuts(len(ids) // 4, 1024))}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in P.run(spark, data).collect()} == want


def test_registered():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
