"""Personal data: patterns propose spans, checksum validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping per kind and are always kept.
The method adds `iban` (15 to 34 characters that pass mod-97) and `ssn` (grouped 3-2-4 digits with legal groups, which
only words nearby confirm); an added span is kept when its score reaches `keep`. Every span carries its score. Offsets are
code points, end exclusive.

Defined cases: null text counts as empty; a null doc_id is kept as it is; repeated rows are scanned one by one;
an empty table gives an empty result; other columns are ignored. Scanning is linear in the text: no pattern is
retried inside a run it has already consumed, but for account numbers, whose runs are of bounded length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import joined

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Score before context, and the words nearby that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
WINDOW = 40


def luhn(digits: str) -> bool:
    """The mod-10 checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 checksum of international account numbers."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _IP.finditer(text):
        # int() of a very long run of digits is refused; more than three significant digits exceed 255 anyway
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    m = _IBAN.search(text)
    while m:
        end = m.end()
        while end > 0:  # words after the number may look like groups of it: shorter ends are tested as well
            flat = text[m.start() : end].replace(" ", "")
            if 15 <= len(flat) <= 34 and mod97(flat):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
        m = _IBAN.search(text, end if end > 0 else m.start() + 1)


def _ssns(text: str):
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def scan(text: str | None, keep: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans of one text by kind as listed (base kinds, then added ones), then start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
        found += [("iban", *s) for s in _ibans(text)]
        if "-" in text:
            found += [("ssn", *s) for s in _ssns(text)]
    out = []
    for kind, a, b in found:
        near = f"{text[max(0, a - WINDOW) : a]} {text[b : b + WINDOW]}".lower()
        score = min(1.0, PRIOR[kind] + 0.2 * any(w in near for w in CONTEXT[kind]))
        if kind in PRIOR and (kind in BASE or score >= keep):
            out.append((kind, a, b, score))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """One row per document: its id and `spans`, ordered by kind as listed, then start. No shuffle."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        names = ("kind", "start", "end", "score")
        for b in batches:
            spans = [[dict(zip(names, s)) for s in scan(t, keep)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    return docs.mapInArrow(run, schema)


def redacted(text: str | None, keep: float = 0.5) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b, _ in sorted(scan(text, keep), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """The same rows and columns with personal data masked in the text; n_chars, where there is one, follows the text."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redacted(t, keep), na_action="ignore")

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn("n_chars", F.char_length(text_col).cast("long")) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """Counts, digests and scores of find_pii()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
