"""Extraction by a caller's model, as a polymorphic table function, and the drain of the queue.

The model is a function (item, title, content) -> JSON text. `extract` hands it each page's content, cut at the item's
length, and yields at most so many checked rows; what it answers that is no JSON, or lacks a field, gives no row, and an
answer that raises gives none for its page. Pages are read where they lie: nothing is shuffled for the model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera import scratch
from tessera.functions import text as T
from tessera.operators import graph, matching, records

# Of each item its key in an answer, its fields with their types and defaults (`required`: the field must be
# there; `filled`: it must not be blank; `share`: 0 to 1), how many are kept, and how much of the content a model sees
ITEMS = {
    "claims": ("claims", (("claim", "string", "filled"), ("source_reference", "string", "filled"), ("confidence", "double", 0.5), ("subject", "string", None), ("predicate", "string", None), ("object", "string", None), ("temporal_context", "string", None), ("qualifiers", "array<string>", [])), 20, 3000),
    "entities": ("entities", (("name", "string", "required"), ("type", "string", "required"), ("description", "string", "")), 10, 2000),
    "concepts": ("concepts", (("name", "string", "required"), ("description", "string", "")), 8, 2000),
    "relationships": ("relationships", (("source_entity", "string", "required"), ("relationship_type", "string", "required"), ("target_entity", "string", "required"), ("source_reference", "string", None), ("description", "string", None), ("confidence", "double", 0.9), ("bidirectional", "boolean", False)), 15, 3000),
    "qa": ("pairs", (("question", "string", "filled"), ("answer", "string", "filled"), ("tags", "array<string>", [])), 20, 16000),
    "metadata": ("metadata", (("kind", "string", None), ("summary", "string", None), ("tags", "array<string>", [])), 1, 1500),
}
LOWERED = ("type", "relationship_type")
# End of fixed values


TYPES = {"string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def _value(name: str, kind: str, default, found: dict):
    """A field of an answer; raises ValueError if the item is to go."""
    rule, x = default if default in ("required", "filled") else None, found.get(name)
    if rule == "required" and name not in found:
        raise ValueError(name)
    if kind == "string":
        text = str("" if x is None else x).strip()
        if rule == "filled" and not text:
            raise ValueError(name)
        text = text.lower() if name in LOWERED else text
        return text or (None if rule or default is None else default) if not rule else text
    if kind == "double":
        share = float(default if x is None else x)
        if not (math.isfinite(share) and 0 <= share <= 1):
            raise ValueError(name)
        return share
    if kind == "boolean":
        return bool(x) if x is not None else default
    return [str(y).strip() for y in x if y and str(y).strip()] if isinstance(x, list) else default


def checked(item: str, answer: str) -> list[tuple]:
    """The items of an answer that hold what they must, at most as many as are kept."""
    key, wanted, most, _ = ITEMS[item]
    try:
        data = json.loads(answer)
    except (TypeError, ValueError):
        return []
    data = data.get(key, [data] if most == 1 and key not in data else []) if isinstance(data, dict) else data
    out = []
    for found in data if isinstance(data, list) else [data]:
        try:
            out.append(tuple(_value(*f, found) for f in wanted)) if isinstance(found, dict) else None
        except (TypeError, ValueError):
            continue
    return out[:most]


def extractor(model: Callable[[str, str, str], str]):
    """A table function of (pages with page_id, title and body; the item's name) that yields page_id, place and the item's
    fields, whichever they are."""

    @F.udtf
    class Extract:
        @staticmethod
        def analyze(pages: AnalyzeArgument, item: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or item.value not in ITEMS:
                raise ValueError(f"extract(TABLE pages, one of {', '.join(ITEMS)})")
            schema = StructType().add("page_id", pages.dataType["page_id"].dataType).add("place", IntegerType())
            for name, kind, _ in ITEMS[item.value][1]:
                schema = schema.add(name, TYPES[kind])
            return AnalyzeResult(schema)

        def eval(self, page, item):
            try:
                answer = model(item, page["title"] or "", (page["body"] or "")[: ITEMS[item][3]])
            except Exception:  # a model that fails on a page gives nothing for it
                return
            for n, x in enumerate(checked(item, answer), 1):
                yield (page["page_id"], n, *x)

    return Extract


def extract(pages: DataFrame, item: str, model: Callable) -> DataFrame:
    """page_id, place, and the fields of what the model finds in each page."""
    return extractor(model)(pages.select("page_id", "title", "body").asTable(), F.lit(item))


def listed(found: DataFrame, item: str) -> DataFrame:
    """page_id, and the items of a page as an array, in order."""
    names = [f[0] for f in ITEMS[item][1]]
    rows = F.sort_array(F.collect_list(F.struct("place", F.struct(*names).alias("x"))))  # ITEMS' most at most
    return found.groupBy("page_id").agg(F.transform(rows, lambda r: r["x"]).alias(item))


def _asked(pages: DataFrame, item: str, model: Callable) -> DataFrame:
    """extract() as a written table: the model is asked once however often the rows are read."""
    return scratch.written(extract(pages, item, model), item)[0]


def drain(queue: DataFrame, model: Callable) -> dict[str, DataFrame]:
    """queue: pages that wait, with page_id, title, domain, kind, summary, tags and body. In order: what kind a page is, its
    entities or concepts by kind, its claims, its relationships, and the page enriched with all of them. The tables that
    come of it: pages (status enriched), claims, edges, and questions (draft pages of kind qa, of pages and sources)."""
    found = _asked(queue, "metadata", model).select("page_id", "kind", "summary", "tags")
    kinds = queue.join(found.select("page_id", F.col("kind").alias("__kind")), "page_id", "left")
    kinds = kinds.withColumn("__kind", F.coalesce(F.nullif("kind", F.lit("")), "__kind", F.lit("page")))
    of = lambda *names: kinds.where(F.col("__kind").isin(*names)).drop("__kind")
    claims = _asked(queue, "claims", model)
    relationships = _asked(queue, "relationships", model)
    lists = {
        "entities": listed(_asked(of("entity"), "entities", model), "entities"),
        "concepts": listed(_asked(of("concept"), "concepts", model), "concepts"),
        "claims": listed(claims, "claims"),
        "relationships": listed(relationships, "relationships"),
    }
    whole = queue.select("page_id").join(found, "page_id", "left")
    for name in lists:
        whole = whole.join(lists[name], "page_id", "left")
    rels = relationships.select(F.col("page_id").cast("string").alias("page_id"), F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), F.col("relationship_type").alias("type"), F.col("confidence").alias("weight"))
    pairs = _asked(of("page", "source"), "qa", model).join(queue.select("page_id", "domain"), "page_id")
    return {"pages": records.enrich(queue, whole), "claims": claims, "edges": graph.relationship_edges(rels), "questions": records.qa_pages(pairs)}


#: How alike the words of two claims must be, and how sure a verdict, to count.
ALIKE, SURE = 0.7, 0.6


def semantic(model: Callable[[str, str], str], alike: float = ALIKE, sure: float = SURE) -> Callable[[DataFrame], DataFrame]:
    """A detector for matching.contradictions(semantic=...): the model, a function (claim, claim) -> JSON text with
    `contradicts` and `confidence`, judges pairs of claims of two pages whose words are alike; each pair of texts once."""

    @F.udtf(returnType="left string, right string, confidence double")
    class Judge:
        def eval(self, pair):
            try:
                verdict = json.loads(model(pair["left"], pair["right"]))
                share = float(verdict.get("confidence", 0))
            except Exception:  # a model that fails on a pair gives no verdict
                return
            if verdict.get("contradicts") and share >= sure:
                yield pair["left"], pair["right"], share

    def detect(claims: DataFrame) -> DataFrame:
        judged, _ = scratch.written(Judge(matching.alike_texts(claims, alike).asTable()), "judged")
        key = lambda text: F.unhex(F.sha1(text))
        texts = judged.select(F.explode(F.array(key("left"), key("right"))).alias("key")).distinct()
        rows = claims.select(key("text").alias("key"), F.struct("page_id", "claim_no").alias("id"))
        of, _ = scratch.written(rows.join(matching.few(texts), "key", "left_semi"), "judged")
        found = matching.members(judged.select(key("left").alias("x"), key("right").alias("y"), "confidence"), of)
        return matching._paired(found, "semantic", F.col("confidence"), T.severity(F.col("confidence")))

    return detect
