"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

`find_pii` adds an array of spans, `mask_pii` replaces them. The four base kinds (email, ip,
card, phone) are the leftmost non-overlapping matches of their pattern that pass their check
(parts at most 255; 12 to 19 digits passing Luhn; 9 to 15 digits) and are always kept; context
only moves their score. The further kinds need more: an iban must pass mod-97, a ssn needs
a context word nearby. Offsets are code points, ends exclusive; a null text is an empty one.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Kinds in the order that breaks ties of equal starts; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never begins inside a run of digits: what fails at its start fails within it, too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Score of a confirmed span before context, words that raise it, words that lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("call", "phone", "tel", "fax", "mobile"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security", "sozial"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "build", "ticket")
CONTEXT, LEAST = 48, 0.6


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in odd[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(found: str) -> int:
    """Where the longest part of a proposed IBAN that ends at a space or at its end and passes mod-97 ends; 0 if none does."""
    return next((n for n in range(len(found), 14, -1) if (n == len(found) or found[n] == " ") and found[n - 1] != " " and mod97(found[:n])), 0)


def _emails(text: str):
    """Leftmost non-overlapping matches found from each @ outwards: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every confirmed span, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.start() + n) for m in IBAN.finditer(text) if (n := iban_end(m[0]))]
    out += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    return sorted(out)


def score_span(text: str, start: int, end: int, kind: str) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
    words = set(re.findall(r"[a-z]+", near))
    up = any(w.startswith(c) for w in words for c in FOR[kind])
    down = any(w.startswith(c) for w in words for c in AGAINST)
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * up - 0.3 * down))


def scored_spans(text: str) -> list[dict]:
    out = []
    for start, k, end in find_spans(text):
        score = score_span(text, start, end, KINDS[k])
        if k < len(BASE) or score >= LEAST:
            out.append({"kind": KINDS[k], "start": start, "end": end, "score": score})
    return out


def find_pii(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """`df` with array `into` of (kind, start, end, score), sorted by start and kind.

    All columns and rows stay, repeated rows too; a column already named `into` is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([scored_spans(t) for t in texts.to_pylist()], kind)

    return df.withColumn(into, F.arrow_udf(spans, SPANS)(text_or_empty(F.col(text))))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with every span of `text` replaced by its kind in brackets; overlapping spans become one mark."""

    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None:
                parts, at = [], 0
                for s in scored_spans(t):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return df.withColumn(text, F.arrow_udf(masked, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame) -> DataFrame:
    """The columns that the registered query returns, from doc_id and spans."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
