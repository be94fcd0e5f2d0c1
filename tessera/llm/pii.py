"""Personal data in text: patterns propose spans, checksums confirm them, context adjusts scores.

Four base kinds (email, ip, card, phone) follow fixed patterns and are always kept. Further kinds
are proposed by wider patterns and kept only when a checksum confirms them (IBAN: mod 97) or when
words near the span lift their score to the threshold (national ids, local phone numbers, birth
dates, device ids with a Luhn digit).

Each document is handled by itself in Arrow batches, so nothing is shuffled. Every pattern is
linear in the text: emails are found from their ``@`` and widened to the left, number patterns start
only where a run of digits starts. Spans count code points, end exclusive.

Defined results: null and empty texts have no spans; ties do not arise (spans of a kind do not
overlap, order is kind then start); repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

# Kinds in result order, their scores before context and their labels.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "imei", "national_id", "phone_local", "birth_date")
KINDS = BASE_KINDS + EXTRA_KINDS
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "imei": 0.3, "national_id": 0.3, "phone_local": 0.3, "birth_date": 0.2}
# Words that lift a span's score when they stand shortly before it.
CONTEXT = {
    "email": ("email", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "imei": ("imei", "device", "handset"),
    "national_id": ("ssn", "social", "security", "taxpayer", "passport"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "birth_date": ("born", "birth", "birthday", "dob", "geboren", "née", "nacido", "nacida"),
}
#: How much a context word adds, how far before a span it may stand, and what an extra span must reach.
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.4, 48, 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IMEI = re.compile(r"(?<![0-9])[0-9]{15}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            floor = m.end()


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """The longest run of whole groups that mod 97 confirms; words behind an IBAN are groups too at first."""
    at = 0
    while m := _IBAN.search(text, at):
        ends = [k for k in range(m.end(), m.start() + 14, -1) if k == m.end() or text[k] == " "]
        end = next((k for k in ends if len(own := text[m.start() : k].replace(" ", "")) >= 15 and mod97(own)), None)
        if end:
            yield m.start(), end
        at = end or m.start() + 4


def _imeis(text: str):
    return (m.span() for m in _IMEI.finditer(text) if luhn(m[0]))


def _score(text: str, kind: str, start: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start])}
    return round(min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * (not near.isdisjoint(CONTEXT[kind]))), 3)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by kind and start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind, search in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            found += [(kind, a, b) for a, b in search(text)]
        base = sorted((a, b) for _, a, b in found)
        starts, ends = [a for a, _ in base], sorted(b for _, b in base)
        clear = lambda a, b: bisect_left(starts, b) == bisect_left(ends, a + 1)  # noqa: E731  no base span overlaps
        for kind, search in (("iban", _ibans), ("imei", _imeis)):  # what a checksum confirms may overlap base spans
            found += [(kind, a, b) for a, b in search(text) if _score(text, kind, a) >= THRESHOLD]
        for kind, pattern in (("national_id", _NATIONAL), ("phone_local", _LOCAL_PHONE), ("birth_date", _DATE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if clear(*m.span()) and _score(text, kind, m.start()) >= THRESHOLD]
    return [(kind, a, b, _score(text, kind, a)) for kind, a, b in found]


def redact(text: str | None) -> str | None:
    """The text with every span, or union of overlapping spans, replaced by its kind in brackets."""
    spans = sorted((a, b, kind) for kind, a, b, _ in find_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)])


def _redact_batch(texts: pd.Series) -> pd.Series:
    return texts.map(redact)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a ``pii_spans`` column."""
    return docs.withColumn("pii_spans", F.pandas_udf(_spans_batch, SPANS)(F.col(text)))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; null texts stay null, n_chars follows the text."""
    clean = F.pandas_udf(_redact_batch, "string")
    return docs.withColumn("text", clean("text")).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_joined(F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        F.transform("pii_spans", lambda s: s["score"]).alias("scores"),
    )


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
