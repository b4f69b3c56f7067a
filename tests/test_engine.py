"""Operators against the small examples of their definitions, and registered queries against DuckDB."""

import glob
import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as T
from tessera.operators import export, extraction, fulltext, governance, graph, links, matching, metadata, promotion, records
from tessera.plans import registry
from tessera.sources import pagefiles, versions
from tessera.streaming import inbox

PAGE = "page_id string, kind string, title string, domain string, tags array<string>, summary string, source string, confidence double, created timestamp_ntz, updated timestamp_ntz, body string"


def page(i, title="T", body="", kind="page", domain="tech", tags=("a",), summary="s", source="x", created=datetime(2024, 1, 1), updated=datetime(2024, 2, 1)):
    return (i, kind, title, domain, list(tags) if tags is not None else None, summary, source, 0.8, created, updated, body)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [("Python Programming and API Design", ["python", "programming", "and", "api", "design"]), ("a b rust123 Éab foo_bar x1", ["rust123", "x1"]), ("", [])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.slugify, "Café Über-Test!", "cafe-uber-test"), (T.slug_ascii, "Café 1", "caf-1"), (T.title_case, "a1b-x don't", "A1B-X Don'T"), (T.normal_name, " The  Quick a Fox ", "quick fox"),
        (T.masked_numbers, "in 1991 or 12.5", "in NUM or NUM.NUM"), (T.negated, "it is now", True), (T.negated, "notable", False), (T.without_negation, "are not light", "are  light"), (T.failure_reason, "Connection TIMEOUT", "llm_timeout"),
        (T.failure_reason, "who knows", "unknown"), (T.truncated, "x" * 201, "x" * 200 + "..."), (graph.normal_type, "Uses", "uses"), (graph.normal_type, "used by", "uses"), (graph.normal_type, "zzz", "zzz"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_links_and_numbers(spark):
    assert one(spark, T.links, "[[a]] [[b|B]] ![[c]]") == ["a", "b", "c"]
    assert one(spark, lambda c: T.links(c, T.RAW_LINK), "[[b|B]]") == ["b|B"]
    assert one(spark, lambda c: T.links(c, T.PLAIN_LINK), "[[a]] ![[c]]") == ["a"]
    assert one(spark, T.numbers, "1 and 2.5") == [1.0, 2.5]
    assert [one(spark, T.retry_seconds, n, "int") for n in (0, 1, 2, 9)] == [300, 300, 1800, 86400]
    assert [one(spark, T.age_factor, n, "int") for n in (0, 365, 400)] == [1.0, 0.0, 0.0]


def test_fulltext(spark):
    p = spark.createDataFrame([page("p", "Python Programming", "Learn Python programming with examples"), page("q", "Other", "some more about python in ten easy steps"), page("r", None, None)], PAGE)
    tf = {(r["page_id"], r["term"]): r["tf"] for r in fulltext.postings(p).collect()}
    assert tf[("p", "python")] == 4
    hits = fulltext.search(p, "Python").collect()
    assert [h["page_id"] for h in hits] == ["p", "q"]
    same = fulltext.search_index(fulltext.postings(p), fulltext.documents(p), "python python").collect()
    assert [(r["page_id"], round(r["score"], 9)) for r in same] == [(r["page_id"], round(r["score"], 9)) for r in fulltext.search(p, "python python").collect()]
    assert fulltext.search(p, "").count() == 0 and fulltext.search(p, "python", domain="none").count() == 0 and fulltext.search(p, "python", limit=1).count() == 1
    assert metadata.search(p, "python", tags=["A"], limit=1).count() == 1 and metadata.search(p, tags=["missing"]).count() == 0


CHAIN = [("a", "b"), ("b", "c")]
DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "t")]


def edges(spark, pairs):
    return spark.createDataFrame([(s, t, "links", 1.0) for s, t in pairs], "source string, target string, type string, weight double")


def test_traversal(spark):
    e = edges(spark, CHAIN)
    reach = lambda *a: {r["node"] for r in graph.neighbors(e, *a).collect()}
    assert reach("a", 1) == {"b"} and reach("a", 2) == {"b", "c"} and reach("c", 1) == {"b"} and reach("a", 0) == set() and reach("zz", 2) == set()
    routes = lambda pairs, *a: sorted(r["path"] for r in graph.paths(edges(spark, pairs), *a).collect())
    assert routes(CHAIN, "a", "c") == [["a", "b", "c"]] and routes(CHAIN, "c", "a") == [] and routes(CHAIN, "a", "a") == [["a"]]
    assert routes(DIAMOND, "a", "t", 4) == [["a", "b", "d", "t"], ["a", "c", "d", "t"]] and routes(DIAMOND, "a", "t", 2) == []
    assert graph.subgraph(e, spark.createDataFrame([("a",), ("b",)], "node string")).count() == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traversals_equal_plain_python(spark, seed):
    """Random graphs with a hub, loops and parallel edges."""
    import random

    r = random.Random(seed)
    pairs = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(22)] + [("n0", f"n{i}") for i in range(6)]
    pairs += pairs[:4]
    e = edges(spark, pairs)

    def bfs(start, depth, step, until=None):
        level, now = {start: 0}, [start]
        for d in range(1, depth + 1):
            now = sorted({b for a, b in step if a in now and b not in level and until not in (a, b)})
            level |= dict.fromkeys(now, d)
        return level

    both = pairs + [(b, a) for a, b in pairs]
    for start in ("n0", "n5"):
        want = {k: v for k, v in bfs(start, 3, both).items() if v}
        assert {x["node"]: x["level"] for x in graph.neighbors(e, start, 3).collect()} == want
    for depth in (1, 2, 4):
        level = bfs("n0", depth - 1, pairs, "n7")
        want, walks = [], [["n0"]]
        for _ in range(depth):
            want += [[*w, "n7"] for w in walks for a, b in pairs if a == w[-1] and b == "n7"]
            walks = [[*w, b] for w in walks for a, b in pairs if a == w[-1] and b in level and level[b] == level[a] + 1]
        assert sorted(x["path"] for x in graph.paths(e, "n0", "n7", depth).collect()) == sorted(want)


def test_edges(spark):
    rows = [("a", "b", "uses", 1.5, True, 1), ("a", "b", "uses", 0.4, False, 2), ("c", "d", "uses", -1.0, True, 1)]
    got = {(r["source"], r["target"]): r["weight"] for r in graph.upserted(spark.createDataFrame(rows, "source string, target string, type string, weight double, bidirectional boolean, seq int")).collect()}
    assert got == {("a", "b"): 0.4, ("c", "d"): 0.0, ("d", "c"): 0.0}


def test_page_links(spark):
    p = spark.createDataFrame([page("a", body="[[b]] [[x|X]]"), page("b", body="")], PAGE)
    found = links.extract(p)
    assert {tuple(r) for r in found.collect()} == {("a", "b"), ("a", "x")}
    assert [r["dst"] for r in links.broken(found, p).collect()] == ["x"] and [r[0] for r in links.orphans(found, p).collect()] == ["a"]
    assert links.stats(found, p).first().asDict() == {"total_pages": 3, "total_links": 2, "pages_with_links": 1, "pages_with_backlinks": 2, "n_broken": 1}
    assert {tuple(r) for r in links.rename(found, "b", "z").collect()} == {("a", "z"), ("a", "x")}
    got = links.detect_renames(spark.createDataFrame([("python-lang",), ("zzz",)], "old string"), spark.createDataFrame([("python-language",), ("pyt",)], "new string")).collect()
    assert [(r["old"], r["new"]) for r in got] == [("python-lang", "python-language")]


def test_governance(spark):
    rows = [page("full", body="# h\n- x\n" + "y" * 600), page("bare", tags=(), summary=None, source=None, kind="qa", updated=None, body="short"), page("same", created=datetime(2024, 1, 1), updated=datetime(2024, 1, 1), body="now v1.2")]
    p = spark.createDataFrame(rows, PAGE)
    q = {r["page_id"]: r for r in governance.quality(p).collect()}
    assert q["full"]["score"] == pytest.approx(1.0) and q["full"]["issues"] == []
    assert q["bare"]["score"] == pytest.approx(0.3 * 0.6 + 0.4 * 0.2) and "Missing summary" in q["bare"]["issues"]
    s = {r["page_id"]: r["score"] for r in governance.staleness(p, "2024-02-02 00:00:00").collect()}
    assert s["full"] == 0.0 and s["same"] == pytest.approx(0.2 + 0.3 + 0.3)
    assert {(r["page_id"], r["rule"]) for r in governance.lint(p).collect()} == {("bare", "invalid_kind"), ("bare", "missing_summary")}


def test_duplicates_equal_all_pairs(spark, data):
    rows = [
        ("a", "page", "The Python", ["x", "y", "z"], "same words here", ["py"], "u1", None), ("b", "page", "python", ["x", "y", "z"], "same words here", None, "u1", None), ("c", "page", "Py", [], "", [], None, "g"),
        ("d", "page", "other", [], "different", ["python"], "", "g"), ("e", "page", "AWS", None, "cloud", None, None, None), ("f", "source", "python", [], "same words here", None, "u1", None), ("b", "page", "zzz", [], "", None, None, None),
    ]
    p = spark.createDataFrame(rows, "page_id string, kind string, title string, tags array<string>, body string, aliases array<string>, source_url string, github_url string")
    got = {(r["id_1"], r["id_2"]): r["score"] for r in matching.duplicates(p).collect()}
    assert got[("a", "b")] == pytest.approx(0.4 + 0.2 + 0.1 + 0.1) and got[("a", "c")] == pytest.approx(0.3) and got[("a", "d")] == pytest.approx(0.3)
    assert got[("c", "d")] == pytest.approx(0.2) if ("c", "d") in got else True
    assert all(got[tuple(sorted(("e", x)))] >= 0.3 for x in "abcd") and not any("f" in k for k in got)


def test_duplicates_of_abbreviations_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(("API", "aws", f"t{i}", "t")), rng.choice(("d", "e")), rng.sample("pqrstu", rng.randint(0, 5)), " ".join(rng.sample("one two three four five six seven".split(), rng.randint(0, 4)))) for i in range(60)]
    p = spark.createDataFrame([(i, "page", n, d, t, b) for i, n, d, t, b in rows], "page_id long, kind string, title string, domain string, tags array<string>, body string")
    every = {(r["id_1"], r["id_2"]): r["score"] for r in matching.duplicates(p).collect()}
    for least in (0.32, 0.35, 0.4, 0.45, 0.5):
        got = {(r["id_1"], r["id_2"]): r["score"] for r in matching.duplicates(p, least).collect()}
        assert got == {k: v for k, v in every.items() if v >= least} and got
    of = {r[0]: r[2] for r in rows}
    got = {(r["id_1"], r["id_2"]) for r in matching.duplicates(p, domains=("d",)).collect()}
    assert got == {k for k in every if of[k[0]] == of[k[1]] == "d"}


def test_duplicate_scores_equal_plain_python(spark):
    """Words are read only for pairs that can still qualify: no pair at a threshold is lost, at ratios around 0.3 too."""
    import random

    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(20)]
    rows = [(i, "page", rng.choice(("one", "two")), rng.sample("abcd", 3), " ".join(rng.sample(vocabulary, rng.choice((0, 1, 3, 10, 20))) + ["of", "of"]), rng.choice((None, "u", "v"))) for i in range(24)]
    rows += [(24, "page", "one", None, None, None), (25, "page", "two", [], "", "u")]
    p = spark.createDataFrame(rows, "page_id long, kind string, title string, tags array<string>, body string, source_url string")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                x, y = ({w for w in (r[4] or "").split() if len(w) > 2} for r in (a, b))
                alike = len(x & y) / len(x | y) if x and y else 0.0
                tags = len(set(a[3] or ()) & set(b[3] or ())) >= 3
                want[a[0], b[0]] = 0.4 * (a[2] == b[2]) + 0.2 * (a[5] is not None and a[5] == b[5]) + 0.1 * tags + (0.1 * alike if alike >= 0.3 else 0)
    for least in (0.4, 0.43, 0.5, 0.63):
        got = {(r["id_1"], r["id_2"]): r["score"] for r in matching.duplicates(p, least - 1e-9).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-9}) and got


@pytest.mark.parametrize("text,want", [("it is NOT so", True), ("they didnt'go", True), ("they didnt' go", False), ("we don't", True), ("can't", True), ("now", True), ("a note on snow", False), ("isn't", False), ("", False), (None, None)])
def test_negated(spark, text, want):
    assert one(spark, T.negated, text) is want


def test_contradictions(spark):
    rows = [("p1", 0, "Python was released in 1991"), ("p2", 0, "Python was released in 1990"), ("p1", 1, "containers are very lightweight"), ("p3", 0, "containers are not very lightweight"), ("p1", 2, "it ran well before the big update"), ("p4", 0, "it ran well after the big update"), ("p5", 0, "Python was released in 1990")]
    c = spark.createDataFrame(rows, "page_id string, claim_no long, text string")
    got = {(r["page_1"], r["claim_1"], r["page_2"]): (r["kind"], r["severity"]) for r in matching.contradictions(c).collect()}
    assert got == {("p1", 0, "p2"): ("numerical", "medium"), ("p1", 0, "p5"): ("numerical", "medium"), ("p1", 1, "p3"): ("negation", "high"), ("p1", 2, "p4"): ("temporal", "high")}


@pytest.mark.parametrize("cell", [3, 1000])
def test_contradictions_equal_all_pairs(spark, monkeypatch, cell):
    """Every pair of random claims, judged by the definitions alone."""
    import random

    monkeypatch.setattr(matching, "CELL", cell)
    r = random.Random(12)
    words = ["red", "blue", "green", "fast", "slow", "big", "cat", "dog", "5", "7"]
    extra = ["not", "no", "before", "after", "earlier", "later", "formerly", "now", "cannot", "afterwards", ""]
    rows = [(f"p{i % 40:02}", i, " ".join(filter(None, [*r.choices(words, k=r.choice([1, 4, 5, 6])), r.choice(extra), r.choice(extra)]))) for i in range(160)]
    rows += [(f"q{i}", i, f"the red cat is {w}fast") for i in range(6) for w in ("", "not ")] + [("z", 0, ""), ("z", 1, None)] + [(f"s{i}", 0, f"size {i % 3} and {i % 2} feet") for i in range(6)]
    c = spark.createDataFrame([x for x in rows if x[2] is not None], "page_id string, claim_no long, text string")
    side = lambda n: c.select(*[F.col(x).alias(f"{x}_{n}") for x in c.columns])
    t, u = F.col("text_1"), F.col("text_2")
    both = side(1).join(side(2), F.struct("page_id_1", "claim_no_1") < F.struct("page_id_2", "claim_no_2")).where("page_id_1 != page_id_2")
    alike = lambda f: T.jaccard(F.array_distinct(T.words(f(t))), F.array_distinct(T.words(f(u))))
    neg, tmp = alike(T.without_negation), alike(T.without_temporal)
    gap = F.array_min(F.flatten(F.transform(T.numbers(t), lambda x: F.transform(T.numbers(u), lambda y: F.abs(x - y)))))
    kind = (
        F.when((T.negated(t) != T.negated(u)) & (neg > 0.75), "negation")
        .when(T.temporal(t) & T.temporal(u) & T.opposite(F.lower(t), F.lower(u)) & (tmp > 0.7), "temporal")
        .when((T.masked_numbers(t) == T.masked_numbers(u)) & (gap > 0), "numerical")
    )
    want = {tuple(x) for x in both.select("page_id_1", "claim_no_1", "page_id_2", "claim_no_2", kind.alias("kind")).where("kind is not null").collect()}
    got = matching.contradictions(c).collect()
    assert {(x["page_1"], x["claim_1"], x["page_2"], x["claim_2"], x["kind"]) for x in got} == want and len(got) == len(want)
    assert {x[-1] for x in want} == {"negation", "temporal", "numerical"}


def test_repeated_numbers_meet_once(spark):
    texts = ["licence 2 of 2004"] * 60 + ["licence 3 of 2005", "licence 3 of 2004", "licence 2 of 2005"]
    c = spark.createDataFrame([(f"p{i:02}", 0, t) for i, t in enumerate(texts)], "page_id string, claim_no long, text string")
    lists = c.select(T.masked_numbers(F.col("text")).alias("masked"), T.numbers(F.col("text")).alias("numbers"))
    assert matching.number_gaps(lists).count() == 2
    got = {(r["page_1"], r["page_2"]) for r in matching.numeric_contradictions(c).collect()}
    assert got == {(f"p{i:02}", "p60") for i in range(60)} | {("p61", "p62")}


def test_similar_pairs_equal_all_pairs(spark):
    import random

    r = random.Random(4)
    sets = [(i, sorted({r.randint(0, 12) for _ in range(r.randint(1, 8))})) for i in range(80)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets], "id long, words array<string>")
    for above in (0.5, 0.7, 0.75):
        want = {(a, b) for a, x in sets for b, y in sets if len({*x} & {*y}) / len({*x} | {*y}) > above}
        assert {(x["a"], x["b"]) for x in matching.similar_pairs(df, df, above).collect()} == want


def test_promotion_moves_pages(spark):
    rows = [page("a", body="see [[b]] and [[b.c|C]]"), page("b", body="to [[a]], self [[b]]", domain="tech"), page("b.c", body="x [[b]] [[bXc]]", domain="ops")]
    p = spark.createDataFrame(rows, PAGE)
    chosen = spark.createDataFrame([("b",), ("b.c",)], "page_id string")
    got = {(r["page_id"], r["domain"], r["kind"]): r["body"] for r in matching.promoted(p, chosen).collect()}
    assert got == {
        ("a", "tech", "page"): "see [[shared/b]] and [[shared/b.c]]", ("b", "shared", "page"): "to [[shared/a]], self [[b]]", ("b", "tech", "tombstone"): "Moved to [[shared/b]]\n",
        ("b.c", "shared", "page"): "x [[shared/b]] [[shared/bXc]]", ("b.c", "ops", "tombstone"): "Moved to [[shared/b.c]]\n",
    }
    back = {(r["page_id"], r["domain"], r["kind"]): r["body"] for r in matching.unpromoted(matching.promoted(p, chosen), chosen).collect()}
    assert back == {("a", "tech", "page"): "see [[b]] and [[b.c]]", ("b", "tech", "page"): "to [[a]], self [[b]]", ("b.c", "ops", "page"): "x [[b]] [[bXc]]"}


def test_promotion_is_a_commit(spark, tmp_path):
    """Promote, go back, and a half that fails; a page that goes back keeps its links to what stays shared."""
    root = f"file://{tmp_path}/wiki"
    rows = [page("a", body="see [[b]]"), page("b", body="to [[a]] and [[c|C]]"), page("c", body="[[b]] [[shared/b]]", domain="ops")]
    assert promotion.create(spark.createDataFrame(rows, PAGE), root) == 1
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "page_id string")
    read = lambda v=None: {(r["page_id"], r["domain"], r["kind"]): r["body"] for r in versions.read(spark, root, "pages", v).collect()}
    log = lambda: sorted(r["page_id"] for r in versions.read(spark, root, "promotions").collect())
    first = read()
    assert promotion.promote(spark, root, ids("b", "c", "none"), "2024-01-01") == 2 and log() == ["b", "c"]
    assert read() == {
        ("a", "tech", "page"): "see [[shared/b]]", ("b", "shared", "page"): "to [[shared/a]] and [[shared/c]]", ("b", "tech", "tombstone"): "Moved to [[shared/b]]\n",
        ("c", "shared", "page"): "[[shared/b]] [[shared/b]]", ("c", "ops", "tombstone"): "Moved to [[shared/c]]\n",
    }
    promotion.promote(spark, root, ids("b"), "2024-01-02")  # it is shared already
    assert log() == ["b", "c"] and read() == read(2)
    promotion.unpromote(spark, root, ids("b", "a"))
    assert log() == ["c"] and read()[("b", "tech", "page")] == "to [[a]] and [[shared/c]]" and read()[("a", "tech", "page")] == "see [[b]]"
    before, now = versions.current(spark, root), read()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):  # the log fails after the pages are staged
        promotion.promote(spark, root, ids("a"), "no time")
    assert versions.current(spark, root) == before and read() == now and log() == ["c"]
    versions.rollback(spark, root, 1)
    assert read() == first and log() == []


def test_duplicates_of_classes_equal_all_pairs(spark):
    """At 0.3: pairs and what the classes of abbreviations stand for are the pairs of the product."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [page(f"p{i:02}", t, " ".join(words[: i % 5]), tags=("a", "b", "c")[: 3 if i % 3 else 1]) for i, t in enumerate(["AWS", "the api", "SDK", "Other", "AWS", "Python", "Else", "API", *[f"T{k}" for k in range(8)]])]
    pages = spark.createDataFrame(rows + [page("s", "AWS", kind="source")], PAGE)
    every = {(r["id_1"], r["id_2"]): round(r["score"], 9) for r in matching.duplicates(pages, 0.3).collect()}
    some = matching.duplicates(pages, 0.3, products=False)
    pairs = {(r["id_1"], r["id_2"]): round(r["score"], 9) for r in some.collect()}
    classes = matching.duplicate_classes(pages, some)
    rest = {(r["id_1"], r["id_2"]): 0.3 for r in matching.abbreviation_pairs(pages, classes, some, [r["id"] for r in classes.collect()]).collect()}
    assert not rest.keys() & pairs.keys() and rest | pairs == every and len(rest) >= 20
    assert classes.agg(F.sum("n_pairs")).first()[0] == len(rest)


def test_full_page(spark):
    files = spark.createDataFrame([("index/p_extraction.json", """{"entities": [{"name": "Spark", "entity_type": "tool", "aliases": ["S"], "confidence": 0.5}], "concepts": [{"name": "RDD", "definition": "d", "examples": ["1", "2", "3", "4"]}],
"claims": [{"claim": "c", "confidence": 0.9, "subject": "s", "temporal_context": "2024"}], "relationships": [{"source_entity": "a", "relationship_type": "uses", "target_entity": "b", "confidence": 1.0, "bidirectional": true, "description": "r"}]}"""), ("index/q_extraction.json", "{"), ("x.json", "{}")], "path string, content string")
    p = spark.createDataFrame([page("p", "Title", " body ", summary="sum"), page("q", None, None, summary=None, tags=None)], PAGE).select("page_id", "kind", "title", "domain", "tags", "summary", "body")
    li = spark.createDataFrame([("p", "q"), ("p", "gone"), ("q", "p")], "src string, dst string")
    got = {r["page_id"]: r["content"] for r in export.full_page(p, export.side_files(files), li).collect()}
    assert got["p"] == """# Title

<!-- Metadata -->
- id: p
- domain: tech
- kind: page
- tags: a

<!-- Summary -->
> sum

<!-- Content -->

body

<!-- Entities -->

#### Spark
- Type: tool
- Aliases: S
- Confidence: 0.50


<!-- Concepts -->

#### RDD
- Definition: d
- Examples: 1; 2; 3


<!-- Claims -->

- c (90%)
  - subject=s
  - temporal: 2024


<!-- Relationships -->

- a <--[uses]--> b (100%)
  - r


<!-- Links -->

**Forward links:**
- [[gone]]
- [[q]]

**Backlinks:**
- [[q]]

**Broken links (targets not found):**
- [[gone]]

"""
    assert got["q"].startswith("# q\n\n<!-- Metadata -->\n- id: q\n") and "Entities" not in got["q"] and "**Forward links:**\n- [[p]]\n\n**Backlinks:**\n- [[p]]\n" in got["q"]


def test_reports_and_pages(spark):
    c = spark.createDataFrame([("numerical", 0.85), ("numerical", 0.7), ("negation", 0.2)], "kind string, confidence double")
    assert {tuple(r) for r in matching.contradiction_report(c).collect()} == {("numerical", "high", 1), ("numerical", "medium", 1), ("negation", "low", 1)}
    pairs = spark.createDataFrame([(1, 2, 0.95, "high"), (1, 3, 0.85, "high")], "id_1 int, id_2 int, score double, band string")
    assert [r["id_2"] for r in matching.auto_merges(pairs).collect()] == [2]
    m = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "page_id string, score double")
    assert governance.routing_report(m, m).first().asDict() == {"n_pages": 2, "n_mistakes": 2, "high": 1, "medium": 1, "low": 0}
    qa = records.qa_pages(spark.createDataFrame([("p", "d", "q2", "y"), ("p", "d", "q1", "x")], "page_id string, domain string, question string, answer string")).collect()
    assert {(r["page_id"], r["title"]) for r in qa} == {("p-qa-1", "q1"), ("p-qa-2", "q2")} and all("[[p]]" in r["body"] for r in qa)
    made = export.page_file(spark.createDataFrame([page("a", "A: b", "x", tags=("t", "u"))], PAGE)).first()
    read = pagefiles.pages(pagefiles.parsed(spark.createDataFrame([("/w/" + made["path"], made["content"])], "path string, content string"))).first()
    assert (read["page_id"], read["title"], read["tags"], read["body"], read["confidence"]) == ("a", "A: b", ["t", "u"], "x", 0.8)


def test_stored_index_follows_changes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    fulltext.store(spark.createDataFrame([page("p", "Python", "python code"), page("q", "Other", "python here"), page("r", "Rust", "rust")], PAGE), path)
    best = lambda q, **k: [r["page_id"] for r in fulltext.search_stored(spark, path, q, **k).collect()]
    assert best("python") == ["p", "q"] and best("") == [] and best("python", domain="none") == [] and best("nothing") == []
    fulltext.store(spark.createDataFrame([page("q", "Python Python", "python"), page("r", "Go", "python")], PAGE), path)
    assert fulltext.store_removed(spark.createDataFrame([("p",)], "page_id string"), path) == 3
    now = spark.createDataFrame([page("q", "Python Python", "python"), page("r", "Go", "python")], PAGE)
    rows = lambda df: [(r["page_id"], r["title"], round(r["score"], 9)) for r in df.collect()]
    want = rows(fulltext.search(now, "python"))
    assert rows(fulltext.search_stored(spark, path, "python")) == want and best("rust") == []
    fulltext.compacted(spark, path)
    assert len(versions.manifest(spark, path)["blocks"]) == 1 and rows(fulltext.search_stored(spark, path, "python")) == want and best("rust") == []
    assert versions.vacuum(spark, path) == 5 and rows(fulltext.search_stored(spark, path, "python")) == want


def test_search_that_skips_blocks(spark, tmp_path, monkeypatch):
    """The best pages of any query and domain are those of a full scan, though most ranges are never opened."""
    import random

    monkeypatch.setattr(fulltext, "BLOCK_PAGES", 4)
    monkeypatch.setattr(fulltext, "FIRST", 2)
    monkeypatch.setattr(fulltext, "FEW", 5)
    r = random.Random(6)
    words = [f"w{min(int(r.expovariate(0.2)), 60)}" for _ in range(300)]
    rows = [page(f"p{i:04}", " ".join(r.choices(words, k=2)), " ".join(r.choices(words, k=r.choice([3, 10, 40, 400]))), domain=f"d{i % 3}") for i in range(600)]
    pages = spark.createDataFrame(rows + [page("none", None, None)], PAGE)
    path = f"file://{tmp_path}/index"
    fulltext.store(pages, path)
    got = lambda df: [(x["page_id"], round(x["score"], 9)) for x in df.collect()]
    for q in ("w1", "w0 w5 w5", "w40 w41 w2", "w60", "w7 absent"):
        for d in (None, "d1"):
            assert got(fulltext.search_stored(spark, path, q, 7, d)) == got(fulltext.search(pages, q, d, 7)), (q, d)
    posted, docs = fulltext.stored(spark, path)
    assert sorted(map(tuple, posted.select("page_id", "term", "tf").collect())) == sorted(map(tuple, fulltext.postings(pages).collect())) and docs.count() == 601


@pytest.mark.parametrize("cell", [5, 1000])
def test_renames_equal_all_pairs(spark, monkeypatch, cell):
    """Names of which very many share their first three characters, in cells, against every pair."""
    import difflib
    import random

    monkeypatch.setattr(links, "CELL", cell)
    r = random.Random(8)
    name = lambda: r.choice(["the", "the", "ab", "", "xyz"]) + "".join(r.choice("abcdeé-") for _ in range(r.randint(0, 12))) + r.choice(["", "", "ing"])
    old, new = sorted({name() for _ in range(120)}), sorted({name() for _ in range(150)})
    want, met = {}, set()
    for a in old:
        for b in new:
            if a[:3] == b[:3] or a[-3:] == b[-3:]:
                score = difflib.SequenceMatcher(None, a, b).ratio()
                if score > 0.6:
                    met.add((a, b))
                    want[a] = min(want.get(a, (1, "")), (-score, b))
    o, n = spark.createDataFrame([(x,) for x in old], "old string"), spark.createDataFrame([(x,) for x in new], "new string")
    got = {x["old"]: (-x["ratio"], x["new"]) for x in links.detect_renames(o, n).collect()}
    assert got == want and len(want) > 50
    found = links.rename_candidates(o, n, 0.6).collect()
    pairs = {(x["old"], x["new"]) for x in found}
    assert len(pairs) == len(found) and met <= pairs and links.detect_renames(o.limit(0), n).count() == 0


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    got = lambda v=None, t="a": sorted(x["i"] for x in versions.read(spark, root, t, v).collect())
    assert versions.current(spark, root) == 0 and versions.commit(spark, root, {"a": df(1), "b": df(5)}) == 1
    assert versions.commit(spark, root, {"a": df(1, 2)}) == 2 and got() == [1, 2] and got(1) == [1] and got(t="b") == [5]
    with pytest.raises(RuntimeError):  # another writer of the same version was first
        versions.switch(spark, root, {}, 1)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # one of two tables fails: neither is replaced
        versions.commit(spark, root, {"a": df(9), "b": spark.range(1).select((F.lit(1) / F.col("id")).alias("i"))})
    assert got() == [1, 2] and got(t="b") == [5]
    assert versions.rollback(spark, root, 1) == 3 and got() == [1] and got(2) == [1, 2]
    assert versions.vacuum(spark, root) >= 2 and got() == [1] and versions.current(spark, root) == 3


def test_records(spark):
    old = spark.createDataFrame([("a", "Old", "d", ["x"], "s", None, 0.8), ("b", "B", "d", None, None, None, None)], "page_id string, title string, domain string, tags array<string>, summary string, source string, confidence double")
    new = spark.createDataFrame([("a", "New", None, ["x", "y"], "t", "src", 0.95), ("c", "C", "d", ["z"], None, None, 0.5)], old.schema)
    got = {r["page_id"]: r for r in records.integrate(old, new).collect()}
    assert got["a"]["title"] == "Old" and got["a"]["tags"] == ["x", "y"] and got["a"]["summary"] == "t" and got["a"]["confidence"] == 0.95 and got["a"]["source"] == "src" and set(got) == {"a", "b", "c"}
    t = lambda m: datetime(2024, 1, 1, 0, m)
    a = spark.createDataFrame([("f", t(0), "timeout"), ("f", t(1), "network"), ("g", t(0), "corrupt")], "file_path string, at timestamp_ntz, error string")
    s = {r["file_path"]: r for r in records.failures(a).collect()}
    assert (s["f"]["failure_count"], s["f"]["reason"], s["f"]["next_retry"]) == (2, "network_error", t(31)) and s["g"]["permanent"] and s["g"]["next_retry"] is None
    runs = [r["run_at"] for r in records.cron_runs(spark, "*/30 9-10 * * mon", "2024-01-01 00:00:00", "2024-01-03 00:00:00").collect()]
    assert runs == [datetime(2024, 1, 1, h, m) for h in (9, 10) for m in (0, 30)]


def test_all_failures(spark, data):
    errors = spark.read.parquet(f"{data}/events.parquet").where("event_type = 'error'").count()
    state = registry.QUERIES["failure_state_all"](spark, data).collect()
    assert sum(r["failure_count"] for r in state) == errors and {r["permanent"] for r in state} == {True, False}
    assert sum(r["n"] for r in registry.QUERIES["failure_stats_all"](spark, data).collect()) == len(state)


def test_graph_nodes(spark, data):
    import json

    want = {str(r["page_id"]): {"id": r["page_id"], "label": r["title"], "domain": r["domain"], "kind": r["kind"]} for r in registry.S.pages(spark, data).collect()}
    nodes = [r for r in registry.QUERIES["graph_export_all"](spark, data).collect() if r["part"] == "node"]
    assert {r["key"]: json.loads(r["json"]) for r in nodes} == want and len(nodes) == len(want)


def test_integrate_cases(spark):
    item = "page_id string, claims array<struct<claim:string,id:string>>, relationships array<struct<a:string>>, tags array<string>"
    old = spark.createDataFrame([("p", [("x", None)], [("1",)], ["t", "t", None]), ("q", None, [], None)], item)
    new = spark.createDataFrame([("p", [("x", "7"), ("y", "7"), (None, None)], [("2",)], [None, "u", "u"]), ("q", [("z", None)], [("3",), ("4",)], []), ("r", None, None, ["n"])], item)
    got = {r["page_id"]: r for r in records.integrate(old, new).collect()}
    assert got["p"]["claims"] == [("x", None), ("y", "7")] and got["p"]["tags"] == ["t", "t", None, "u"]  # all-null items share no key
    assert got["p"]["relationships"] == [("1",)] and got["q"]["relationships"] == [("3",)]  # items without any key are equal
    assert got["q"]["claims"] == [("z", None)] and got["r"]["tags"] == ["n"] and got["r"]["n_changes"] == 0
    dated = spark.createDataFrame([("p", datetime(2024, 1, 1))], "page_id string, updated timestamp_ntz")
    with pytest.raises(ValueError):
        records.integrate(dated, dated)
    assert records.integrate(old.limit(0), new.limit(0)).count() == 0


def test_rolled_back_cases(spark):
    h = spark.createDataFrame([("p", i, "v") for i in (1, 2, 3)] + [("q", 1, "v")], "page_id string, seq int, steps string")
    for steps, back, kept in ((1, [2], [1, 2]), (3, [1], []), (4, [], [1, 2, 3]), (0, [], [1, 2, 3])):
        b, k = records.rolled_back(h, spark.createDataFrame([("p", steps)], "page_id string, steps int"))
        assert [r["seq"] for r in b.collect()] == back
        assert sorted(r["seq"] for r in k.where("page_id = 'p'").collect()) == kept and k.where("page_id = 'q'").count() == 1


def test_page_files(spark, tmp_path):
    d = tmp_path / "tech" / "pages"
    d.mkdir(parents=True)
    (d / "a.md").write_text("---\nid: page-a\ntitle: A\nkind: entity\ntags:\n- x\n- y\nconfidence: 0.5\n---\n# Body\n")
    (d / "b.md").write_text("no header")
    (d / "c.md").write_bytes(b"---\ntitle: [1\nx\n---\ncaf\xe9")
    p = pagefiles.pages(pagefiles.parsed(pagefiles.read_files(spark, f"{tmp_path}/*/pages/*.md")))
    got = {r["page_id"]: r for r in p.collect()}
    assert got["page-a"]["tags"] == ["x", "y"] and got["page-a"]["kind"] == "entity" and got["page-a"]["domain"] == "tech" and got["page-a"]["body"] == "# Body\n" and got["b"]["body"] == "no header"
    assert got["c"]["_parse_error"] is not None and got["c"]["body"].endswith("café")
    notes = spark.createDataFrame([("v/2024-01-02 x.md", "[[a]] ![[b|c]] #t")], "path string, content string")
    n = pagefiles.vault_note(notes).first()
    assert (n["links"], n["embeds"], n["tags"], n["daily"], n["markdown"]) == (["a"], ["b"], ["t"], True, "[[a]] [[b]] #t")
    lines = [(1, '{"role": "user", "content": "hi", "session_id": "s"}'), (2, "bad"), (3, '{"role": "assistant", "content": [{"type": "text", "text": " yo "}, {"type": "tool_use", "name": "ls"}]}')]
    m = pagefiles.transcript_messages(spark.createDataFrame([("p", *x) for x in lines], "path string, line_no long, value string")).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in m] == [("user", "hi"), ("assistant", "yo\n\n_[tool use: ls]_")]
    whole = [("a", '[{"role": "user", "content": "x", "sessionId": "s"}, 3, {"content": []}]'), ("b", '{"messages": [{"role": "user", "content": "y"}]}'), ("c", '{"messages": 1}'), ("d", "no JSON"), ("e", None)]
    m = pagefiles.transcript_file_messages(spark.createDataFrame(whole, "path string, content string"))
    assert [(r["path"], r["turn"], r["text"]) for r in m.orderBy("path", "turn").collect()] == [("a", 0, "x"), ("a", 2, ""), ("b", 0, "y")]
    assert [tuple(r) for r in pagefiles.transcript_meta(m).orderBy("path").collect()] == [("a", 2, "s", "unknown"), ("b", 1, None, "unknown")]


def ids_of(spark, rows, most):
    p = pagefiles.with_ids(spark.createDataFrame(rows, "path string, domain string, title string"), most)
    return {r["path"]: r["page_id"] for r in p.collect()}


def test_ids_keep_within_their_length(spark):
    rows = [("1", "d", "x" * 30), ("2", "d", "x" * 30), ("3", "long-domain-name", "Title"), ("4", None, "Title"), ("5", "d", "!"), ("6", "", "My  Page")]
    assert ids_of(spark, rows, 20) == {"1": "d-" + "x" * 18, "2": "d-" + "x" * 16 + "-2", "3": "title", "4": "title-2", "5": None, "6": "my-page"}


def test_ids_never_repeat(spark):
    """A numbered id that is another page's own, or that two bases come to, moves on."""
    assert ids_of(spark, [("1", "d", "A"), ("2", "d", "A"), ("3", "d", "A 2"), ("4", "d", "A"), ("5", "d", "A 3")], 100) == {"1": "d-a", "2": "d-a-4", "3": "d-a-2", "4": "d-a-5", "5": "d-a-3"}
    rows = [(f"{i:03}", None, t) for i, t in enumerate(["a"] * 30 + [f"a {k}" for k in range(2, 20, 3)] * 3 + ["a 2 2"] * 4 + ["abcdefghijkl"] * 15 + ["abcdefghijk"] * 15 + ["abcdefghij 2"] * 3)]
    got = ids_of(spark, rows, 12)
    assert len(set(got.values())) == len(rows) and all(len(v) <= 12 for v in got.values())
    first = {}
    for path, _, title in rows:  # the first page of a base keeps it
        first.setdefault(title.replace(" ", "-"), path)
    assert all(got[p] == base for base, p in first.items())


def test_backlinks_in_blocks_and_cleared_tables(spark):
    rows = [(f"s{i:04}", "hub") for i in range(2500)] + [("a", "b")]
    got = links.backlink_blocks(spark.createDataFrame(rows + rows[:5], "src string, dst string")).collect()
    assert sorted((r["dst"], r["block"], len(r["sources"])) for r in got) == [("b", 0, 1), ("hub", 0, 1000), ("hub", 1, 1000), ("hub", 2, 500)]
    assert [s for r in sorted((r for r in got if r["dst"] == "hub"), key=lambda r: r["block"]) for s in r["sources"]] == [x for x, _ in rows[:2500]]
    kept, path = scratch.written(spark.range(3), "kept")
    assert kept.count() == 3 and scratch.cleared(spark) >= 1 and not os.path.exists(path.removeprefix("file://")) and scratch.cleared(spark) == 0


def test_numbers_of_a_key_in_many_ranges(spark):
    rows = [("hot", i * 7 % 2000) for i in range(2000)] + [(f"k{i % 50}", i) for i in range(300)]
    found, _ = scratch.numbered(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    want = {}
    for k, v in sorted(rows):
        want.setdefault(k, []).append(v)
    assert sorted((r["k"], r["v"], r["n"]) for r in found.collect()) == sorted((k, v, n) for k, x in want.items() for n, v in enumerate(x, 1))


def test_exports(spark):
    p = spark.createDataFrame([page("a", "A", " body ")], PAGE)
    assert export.llms_txt(p).first()["content"] == "# A\n\n<!-- id: a -->\n<!-- domain: tech -->\n<!-- kind: page -->\n<!-- tags: a -->\n\n> s\n\nbody\n"
    assert export.sidecar(p).first()["word_count"] == 1 and export.sitemap(p, "https://w", "x").first()["loc"] == "https://w/tech/a"


@pytest.mark.parametrize("size", [10, 1000])
def test_domains_in_parts(spark, monkeypatch, size):
    """Pages of a hot domain, small ones and one without a name, numbered over many ranges and in one."""
    monkeypatch.setattr(export, "RANGE", size)
    ids = {"hot": [f"p{i * 7919 % 1000:03}" for i in range(250)], "tech": ["b", "a", "é"], "one": ["x"], None: ["n2", "n1"]}
    p = spark.createDataFrame([page(i, domain=d) for d, own in ids.items() for i in own], PAGE)
    got = {(r["domain"], r["part"]): [x.split(" -->")[0] for x in r["content"].split("<!-- id: ")[1:]] for r in export.llms_domains(p, 20).collect()}
    assert got == {(d, k // 20): sorted(own)[k : k + 20] for d, own in ids.items() for k in range(0, len(own), 20)}


def test_registered_domains_are_bounded(spark, data, monkeypatch):
    p = registry.S.pages(spark, data)
    many = p.withColumn("domain", F.lit("hot")).crossJoin(spark.range(6)).withColumn("page_id", F.col("page_id") * 6 + F.col("id")).drop("id")
    monkeypatch.setattr(registry.S, "pages", lambda *_: many)
    want = {k: min(1000, many.count() - 1000 * k) for k in range(-(-many.count() // 1000))}
    got = registry.QUERIES["llms_domains"](spark, data).collect()
    assert {r["part"]: r["content"].count("<!-- id: ") for r in got} == want and len(want) > 1


def test_inbox_stream(spark, tmp_path):
    new = tmp_path / "new"
    new.mkdir()
    (new / "note-one.txt").write_text("Title\nrest of it")
    (new / "x.bin").write_text("zz")
    run = lambda: inbox.run_inbox(spark, str(new), f"{tmp_path}/queue", f"{tmp_path}/failed", f"{tmp_path}/ck")
    run()
    (new / "two.md").write_text("# two")
    run()
    assert sorted(r["title"] for r in spark.read.parquet(f"{tmp_path}/queue").collect()) == ["Title", "Two"]
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == ["unsupported_type"]


def test_retry_stream(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("f", t(0), "timeout"), ("f", t(1), "network"), ("g", t(0), "corrupt"), ("h", t(0), "timeout"), ("h", t(1), None)]
    spark.createDataFrame(rows, "file_path string, at timestamp, error string").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("file_path string, at timestamp, error string").parquet(f"{tmp_path}/in")
    q = inbox.retry_state(s).writeStream.format("memory").queryName("retries").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination()
    got = {r["file_path"]: r for r in spark.sql("select * from retries").collect()}
    assert got["f"]["failure_count"] == 2 and got["f"]["next_retry"] == t(31) and got["g"]["permanent"] and got["h"]["reason"] == "cleared"


def test_retry_timers(spark, tmp_path):
    """Failures set timers, which fire in the stream; an attempt that succeeds clears the file and its timer."""
    import json
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    os.mkdir(f"{tmp_path}/in")

    def put(n, *rows):
        with open(f"{tmp_path}/{n}", "w") as f:
            f.writelines(json.dumps({"file_path": p, "at": f"2024-01-01 00:{n:02}:{i:02}", "error": e}) + "\n" for i, (p, e) in enumerate(rows))
        os.rename(f"{tmp_path}/{n}", f"{tmp_path}/in/{n}.json")

    put(1, ("f", "Connection timeout"), ("g", "unsupported type"), ("h", "network down"), ("h", None))
    attempts = spark.readStream.schema("file_path string, at timestamp, error string").json(f"file://{tmp_path}/in")
    events = inbox.retries(attempts, 2, (2, 600))
    q = events.writeStream.format("memory").queryName("retry_events").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(processingTime="300 milliseconds").start()
    try:
        seen = lambda: {(r["file_path"], r["event"], r["failure_count"]) for r in spark.sql("select * from retry_events").collect()}

        def until(*rows):
            for _ in range(240):
                if set(rows) <= seen():
                    return
                time.sleep(0.25)
            raise AssertionError(seen())

        until(("f", "failed", 1), ("g", "failed", 1), ("h", "cleared", 0), ("f", "due", 1))
        put(2, ("f", "try again later"))  # what the replay of the due file came to
        until(("f", "failed", 2))
        assert not {("g", "due", 1), ("h", "due", 1), ("f", "due", 2)} & seen()
        rows = {(r["file_path"], r["event"]): r for r in spark.sql("select * from retry_events where failure_count > 0").collect()}
        assert rows["g", "failed"]["permanent"] and rows["g", "failed"]["next_retry"] is None
    finally:
        q.stop()


def test_queue_source_and_sink(spark, tmp_path):
    """Files through plug-in adapters into the queue; a batch written again gives the same files, a failed one none."""
    from tessera.sources import queue

    os.makedirs(f"{tmp_path}/in/sub")
    for name, data in (("a.txt", b"Title one\n\nbody"), ("sub/b.md", b"# B\n"), ("c.bin", b"x"), ("d.txt", b"  "), ("e.bad", b"x"), ("f.txt", "caf\u00e9".encode("latin-1"))):
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(data)
    stem = lambda p: p.rsplit("/", 1)[1].split(".")[0]
    adapters = [
        queue.Adapter("text", lambda p, c: p.endswith(".txt"), lambda p, c: (c.split("\n")[0].strip() or stem(p), c)),
        queue.Adapter("markdown", lambda p, c: p.endswith(".md"), lambda p, c: (stem(p), c)),
        queue.Adapter("bad", lambda p, c: p.endswith(".bad"), lambda p, c: 1 / 0),
    ]
    spark.dataSource.register(queue.inbox(adapters))
    rows = spark.read.format("tessera_inbox").option("path", f"{tmp_path}/in").load()
    got = {r["path"].split("/in/")[1]: (r["adapter"], r["title"], r["error"]) for r in rows.collect()}
    assert got == {
        "a.txt": ("text", "Title one", None), "sub/b.md": ("markdown", "b", None), "c.bin": (None, None, "unsupported type"), "d.txt": ("text", "d", "invalid format: empty"),
        "e.bad": (None, None, "ZeroDivisionError: division by zero"), "f.txt": ("text", "caf\u00e9", None),
    }
    pages = queue.queued(rows.where("error is null"), ["ops"], [("/sub/", "deep")], "general").cache()

    def files():
        found = glob.glob(f"{tmp_path}/out/**/*.*", recursive=True)
        return {f.split("/out/")[1]: open(f).read() for f in found}

    queue.write_queue(spark, pages, f"{tmp_path}/out")
    first = files()
    assert set(first) == {"domains/general/queue/general-title-one.md", "domains/deep/queue/deep-b.md", "domains/general/queue/general-cafe.md"}
    assert first["domains/deep/queue/deep-b.md"].startswith('---\nid: "deep-b"\ntitle: "b"\nkind: "source"\ndomain: "deep"\nstatus: "queued"\nsource: "') and first["domains/deep/queue/deep-b.md"].endswith("\n---\n# B\n")
    queue.write_queue(spark, pages, f"{tmp_path}/out")
    assert files() == first and not glob.glob(f"{tmp_path}/out/_staging/*")
    bad = spark.createDataFrame([("domains/x/queue/x.md", "x"), ("domains/y/queue/y.md", None)], "path string, content string").repartition(2)
    with pytest.raises(Exception, match="NoneType"):
        queue.write_queue(spark, bad, f"{tmp_path}/out")
    assert files() == first and not glob.glob(f"{tmp_path}/out/_staging/*/*/*")


@pytest.mark.parametrize(
    "item,answer,want",
    [
        ("claims", '{"claims": [{"claim": " a ", "source_reference": "r"}, {"claim": "b"}, {"claim": "c", "source_reference": "r", "confidence": 2}, 3, {"claim": "d", "source_reference": "r", "confidence": "x"}]}', [("a", "r", 0.5, None, None, None, None, [])]),
        ("entities", '[{"name": "N", "type": " Tool "}, {"name": "M"}]', [("N", "tool", "")]),
        ("concepts", '{"concepts": ' + str([{"name": f"c{i}"} for i in range(12)]).replace("'", '"') + "}", [(f"c{i}", "") for i in range(8)]),
        ("relationships", '{"relationships": [{"source_entity": "a", "relationship_type": "USES", "target_entity": "b", "bidirectional": true}]}', [("a", "uses", "b", None, None, 0.9, True)]),
        ("qa", '{"pairs": [{"question": "q", "answer": "a", "tags": [" x ", ""]}, {"question": " ", "answer": "a"}]}', [("q", "a", ["x"])]),
        ("qa", "no JSON", []), ("claims", "null", []), ("claims", '{"other": 1}', []),
    ],
)
def test_checked_answers(item, answer, want):
    assert extraction.checked(item, answer) == want


def test_semantic_contradictions(spark):
    rows = [("p1", 0, "the cat sat on the red mat"), ("p2", 0, "the cat sat on the blue mat"), ("p3", 0, "something else"), ("p1", 1, "the cat sat on the blue mat"), ("p4", 0, "the cat sat on the green mat")]
    c = spark.createDataFrame(rows, "page_id string, claim_no long, text string")
    model = lambda a, b: '{"contradicts": true, "confidence": 0.9}' if "red" in a + b else "bad"
    got = {(r["page_1"], r["claim_1"], r["page_2"], r["claim_2"], r["kind"], r["severity"]) for r in matching.contradictions(c, extraction.semantic(model)).collect()}
    assert got == {("p1", 0, "p2", 0, "semantic", "high"), ("p1", 0, "p4", 0, "semantic", "high")}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else str(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    if name not in registry.ORACLE_SQL:
        assert got.count() >= 0
        return
    want = duck.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(zip(*[want[c].to_pylist() for c in columns]))


@pytest.mark.parametrize("block,small", [(3, 0), (4, 8), (1000, 1000)])
def test_duplicates_in_cells_equal_plain_python(spark, monkeypatch, block, small):
    """Groups cut into blocks and groups dealt out together give the pairs of all rows, each once; no pair is shuffled."""
    import random

    from tessera.operators import pairing

    monkeypatch.setattr(pairing, "BLOCK", block)
    monkeypatch.setattr(pairing, "SMALL", small)
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(12)]
    names = ("one", "two", "py", "aws", "")
    rows = [(i, "page", rng.choice(names), rng.sample("abcde", rng.randint(0, 4)), " ".join(rng.sample(vocabulary, rng.choice((0, 3, 8)))), rng.choice((None, [], ["py", "two"], ["one"], ["py", "py"])), rng.choice((None, "u")), rng.choice((None, "g", "h"))) for i in range(40)]
    p = spark.createDataFrame(rows, "page_id long, kind string, title string, tags array<string>, body string, aliases array<string>, source_url string, github_url string")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                x, y = (set(r[4].split()) for r in (a, b))
                alike = len(x & y) / len(x | y) if x and y else 0.0
                score = 0.4 if a[2] == b[2] != "" else 0.0
                score += 0.3 if a[2] in (b[5] or ()) or b[2] in (a[5] or ()) or "aws" in (a[2], b[2]) else 0.0
                score += 0.2 if a[6] == b[6] is not None or a[6] is not None and a[6] == b[6] or a[7] is not None and a[7] == b[7] else 0.0
                want[a[0], b[0]] = score + (0.1 if len(set(a[3]) & set(b[3])) >= 3 else 0.0) + (0.1 * alike if alike >= 0.3 else 0)
    for least in (0.25, 0.3, 0.43):
        found = matching.duplicates(p, least, marked=True)
        got = found.collect()
        assert {(r["id_1"], r["id_2"]): r["score"] for r in got} == pytest.approx({k: v for k, v in want.items() if v >= least}) and len({(r["id_1"], r["id_2"]) for r in got}) == len(got)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsIn" in plan and "Exchange" not in plan.split("FlatMapGroupsIn")[0].split("Initial Plan")[0]


@pytest.mark.parametrize("cell", [2, 1000])
def test_alike_texts_equal_all_pairs(spark, monkeypatch, cell):
    """Each pair of unlike texts once, texts of the same words too; words that make no pair are no rows of the join."""
    import random

    monkeypatch.setattr(matching, "CELL", cell)
    rng = random.Random(4)
    rows = [" ".join(rng.sample("a b c d e f g".split(), rng.randint(1, 7))) for _ in range(60)] + [f"own{i} only{i} a b c" for i in range(20)] + [" "]
    texts = spark.createDataFrame([(t,) for t in sorted(set(rows))], "text string")
    for above in (0.6, 0.8):
        want = {(x, y) for x in set(rows) for y in set(rows) if x < y and x.split() and len(set(x.split()) & set(y.split())) > above * len(set(x.split()) | set(y.split()))}
        got = [tuple(r) for r in matching.alike_texts(texts, above).collect()]
        assert set(got) == want and len(got) == len(want)


def test_words_without_a_pair_are_not_joined(spark, monkeypatch):
    seen = []
    write = scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    rows = [("p", 0, "the cats are not here today")] + [(f"q{i}", 0, f"own{i} other{i} third{i} the cats") for i in range(50)] + [("r", 0, "the cats are here today")]
    got = matching.negation_contradictions(spark.createDataFrame(rows, "page_id string, claim_no long, text string")).collect()
    assert [(r["page_1"], r["page_2"]) for r in got] == [("p", "r")]
    assert {r["c"] for r in dict(seen)["prefix"][0].select("c").collect()}.__len__() == 1  # of both, whose words are equal; none of fifty


def test_all_domains_have_a_row_each(spark, data, monkeypatch, duck):
    """llms_all is its SQL where a domain has more pages than a part holds."""
    p = registry.S.pages(spark, data)
    many = p.withColumn("domain", F.lit("hot")).crossJoin(spark.range(6)).withColumn("page_id", F.col("page_id") * 6 + F.col("id")).drop("id")
    monkeypatch.setattr(registry.S, "pages", lambda *_: many)
    got = registry.QUERIES["llms_all"](spark, data).collect()
    pages = [r["content"] for r in export.llms_txt(many).orderBy("page_id").collect()]
    assert len(pages) > 1000 and [(r["domain"], r["part"]) for r in got] == [("hot", 0)]
    assert got[0]["content"] == "# Domain: hot\n\n" + "".join(x + "\n---\n\n" for x in pages) + "\n\n"


def test_relationship_types_are_spelt_in_many_ways(spark, data):
    got = {(r["kind"], r["normal"]) for r in registry.QUERIES["relationship_types"](spark, data).collect()}
    assert {(" Uses ", "uses"), ("us", "uses"), ("", "uses"), ("depends on", "depends_on"), ("Used by", "uses"), ("zzz", "zzz"), ("PART_OF", "part_of"), ("partner", "part_of"), ("PLACED BY", "placed_by")} <= got


def test_rollback_numbers_rows_in_ranges(spark):
    """A page's history is not one window's: no plan holds a window by page alone, at any number of rows."""
    h = spark.range(3000).select(F.lit("p").alias("page_id"), F.col("id").alias("seq"), F.lit(7).alias("n"))
    back, kept = records.rolled_back(h, spark.createDataFrame([("p", 10)], "page_id string, steps int"))
    assert [tuple(r) for r in back.collect()] == [("p", 2990 - 1, 7)] and kept.agg(F.count("*"), F.max("seq")).first() == (2990, 2989)
    assert "row_number" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_stale_pages_are_scored_once(spark):
    """The sort reads a table; marks of time are found as by the single patterns."""
    from tessera.functions import text as T

    texts = ["in 2024 it", "a2024", "20245", "Current", "currently", "anew", "new", "version  3", "versions 3", "v1.2", "v1", "av1.2", "know", "it is now", "", "subversion 2", "x v10.20y"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    one = F.lower("t").rlike("|".join(f"(?:{p})" for p in T.TIME_SENSITIVE))
    assert t.where(T.time_sensitive(F.col("t")) != one).count() == 0
    p = spark.createDataFrame([page("a", created=datetime(2024, 1, 1)), page("b", "T", "new", updated=datetime(2024, 1, 1))], PAGE)
    found = governance.stale(p, "2024-07-01 00:00:00")
    assert [r["page_id"] for r in found.collect()] == ["b", "a"] and "unix_timestamp" not in found._jdf.queryExecution().optimizedPlan().toString() and "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_a_small_base_beside_a_large_one(spark):
    """Numbers that the large base took are passed over, not tried one a round."""
    rows = [(f"a{i:03}", "t", "abcdefghijka") for i in range(40)] + [(f"z{i}", "t", "abcdefghijkz") for i in range(2)]
    ids, rounds = pagefiles.unique_ids(spark.createDataFrame(rows, "path string, title string, base string"), 12)
    got = {r["path"]: r["page_id"] for r in ids.collect()}
    assert len(set(got.values())) == 42 and got["z0"] == "abcdefghijkz" and got["z1"] == "abcdefghi-41" and rounds <= 6


def test_a_frequent_term_lies_in_many_tasks(spark, tmp_path, monkeypatch):
    """A task of the index build holds one file of one bucket, and of a word that all pages have the postings of some pages."""
    monkeypatch.setattr(fulltext, "FILE_PAGES", 50, raising=False)
    monkeypatch.setattr(fulltext, "BLOCK_PAGES", 4)
    pages = spark.createDataFrame([page(i, None, "of the " + f"w{i % 90} " * (1 + i % 9)) for i in range(600)], PAGE)
    rows = fulltext._counted(pages).select("page_id", "domain", F.size("words").cast("long").alias("wc"), F.inline(fulltext._term_counts(F.col("words"))))
    blocks = fulltext._blocks(rows, fulltext._layout(pages)).withColumn("task", F.spark_partition_id())
    tasks = blocks.groupBy("task").agg(F.countDistinct("bucket").alias("buckets"), F.sum(F.when(F.col("term") == "the", F.col("n"))).alias("the")).collect()
    most = [r["the"] for r in tasks if r["the"]]
    assert {r["buckets"] for r in tasks} == {1} and sum(most) == 600 and max(most) <= 100
    path = f"file://{tmp_path}/index"
    fulltext.store(pages, path)
    fulltext.compacted(spark, path)
    posted, _ = fulltext.stored(spark, path)
    assert sorted(map(tuple, posted.select("page_id", "term", "tf").collect())) == sorted(map(tuple, rows.select("page_id", "term", "tf").collect()))


def test_texts_are_indexed_without_a_shuffle_of_texts(spark, data, tmp_path):
    """page_texts has the rows of pages; the labels are joined only where a document has two."""
    held = ("page_id", "title", "domain", "body")
    rows = lambda df: sorted(map(tuple, df.select(*held).collect()), key=repr)
    for name, labels in (("one", [(1, 1, 0), (2, 0, 0), (None, 1, 0), (None, 1, 0)]), ("two", [(1, 1, 0), (1, 0, 0), (2, 0, 0)])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, None, "en", None, 0), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        assert rows(registry.S.page_texts(spark, d)) == rows(registry.S.pages(spark, d)) and registry.S.page_texts(spark, d).count() == (4 if name == "two" else 3), name
    assert "Join" not in registry.S.page_texts(spark, data)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most,bits", [(0, 64), (4, 1 << 26)])
def test_prefixes_hold_no_sets(spark, monkeypatch, most, bits):
    """A row of the join is one word of a set, however long the set; words of unknown frequency and repeated texts lose no pair."""
    import random

    from tessera.operators import prefixes

    monkeypatch.setattr(prefixes, "MOST_WORDS", most)
    monkeypatch.setattr(prefixes, "BITS", bits)
    monkeypatch.setattr(prefixes, "SEEN", 3)
    monkeypatch.setattr(matching, "CELL", 2)
    seen = []
    write = scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    rng = random.Random(5)
    long = [f"w{i}" for i in range(400)]
    rows = [" ".join(long), " ".join(long[:-20]), " ".join(long[:300])] + [" ".join(rng.sample("a b c d e f".split(), rng.randint(1, 6))) for _ in range(80)]
    got = [tuple(r) for r in matching.alike_texts(spark.createDataFrame([(t,) for t in rows], "text string"), 0.7).collect()]
    want = {(x, y) for x in rows for y in rows if x < y and len({*x.split()} & {*y.split()}) > 0.7 * len({*x.split()} | {*y.split()})}
    assert set(got) == want and len(got) == len(want)
    assert not [c for c, kind in dict(seen)["prefix"][0].dtypes if kind.startswith("array")]


def test_members_of_pairs(spark, monkeypatch):
    """Pairs of groups become all pairs of their members, whichever group is the larger one and in however many cells it lies."""
    monkeypatch.setattr(matching, "MEMBERS", 4)
    size = {"a": 1, "b": 30, "c": 7, "d": 7}
    of = spark.createDataFrame([(k, i) for k, n in size.items() for i in range(n)], "key string, id long")
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "none")]
    out = matching.members(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "x string, y string, no long"), of)
    want = sorted((i, j, n) for n, (x, y) in enumerate(pairs[:3]) for i in range(size[x]) for j in range(size[y]))
    assert sorted(map(tuple, out.collect())) == want


def test_abbreviations_meet_all_pages_without_a_shuffle(spark, monkeypatch):
    """No row of a page is dealt out or repeated, however many blocks of abbreviations there are; the pairs are those of all pages."""
    from tessera.operators import pairing

    monkeypatch.setattr(pairing, "BLOCK", 3)
    rows = [(i, "page", ("aws", "API", "other", None, "x")[i % 5], ["a", "b", "c"][: 2 + i % 2], " ".join(f"word{k}" for k in range(i % 7)), (["aws"], ["x", "y"], None)[i % 3]) for i in range(60)]
    p = spark.createDataFrame(rows + [(None, "page", "aws", None, "word1", None), (7, "page", "aws", None, "word1 word2 again", None)], "page_id long, kind string, title string, tags array<string>, body string, aliases array<string>")
    columns = ("id_1", "id_2", "score", "primary_id", "short_1", "short_2")
    for products in (True, False):
        every = [tuple(r[c] for c in columns) for r in matching.duplicates(p, 0.3, products=products, marked=True).collect()]
        found = matching.duplicates(p, 0.3, products=products, marked=True, abbreviated=True)
        assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(r for r in every if r[4] or r[5]) and len(every) > 100
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInPandas") >= 4
    once = p.where("page_id is not null and page_id != 7")
    seen = []
    write = scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: seen.append((name, df)) or write(df, name))
    matching.duplicates(once, 0.3, abbreviated=True)
    assert [name for name, _ in seen] == ["described"] and "Window" not in seen[0][1]._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_cut_before_they_are_compared(monkeypatch):
    import pandas as pd

    from tessera.operators import pairing

    monkeypatch.setattr(pairing, "BLOCK", 4)
    monkeypatch.setattr(pairing, "ROUND_WORDS", 100)
    sizes = lambda n: [len(x) for x in pairing.cut(pd.DataFrame({"i": range(len(n)), "n_words": n}))]
    assert sizes([1] * 10) == [4, 3, 3] and sizes([50] * 8) == [2, 2, 2, 2] and sum(sizes([])) == 0
