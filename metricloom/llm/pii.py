"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Positions are code points, ends exclusive. Spans of the kinds email, ip, card and phone follow fixed rules and are always
returned (``base``); ``iban`` (mod 97), ``ssn`` and ``secret`` (a long random string, confirmed by its shape and entropy) are added
when their score reaches the threshold. For the last two this takes a word nearby that speaks of them. Inputs: null and empty texts have no spans; repeated rows keep a row each; only the id and the text
are read, so other columns may have any names; very long texts are searched whole. An empty table gives no rows. The search is linear in the length of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Characters before a span whose words count as nearby.
NEAR = 48

# Scores: a match of the pattern alone, what a passed checksum adds, what a fitting or unfitting word nearby adds.
PATTERN = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "secret": 0.0}
CHECKSUM, FITTING, UNFITTING = 0.4, 0.3, -0.3
FITTING_WORDS = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "address", "server", "client", "login"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer", "konto"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "credential", "credentials", "auth", "bearer"},
}
UNFITTING_WORDS = {
    "ip": {"version", "release", "build"},
    "card": {"order", "invoice", "tracking", "isbn"},
    "phone": {"order", "invoice"},
    "ssn": {"part", "order", "serial"},
    "secret": {"commit", "checksum", "digest", "sha", "md", "revision"},
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
# A match can only begin where a run of digits does, as the one before it ends where a run ends.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")
WORDS = re.compile(r"[a-z]+")
#: Bits per character from which a string counts as random; 32 hex digits have about 3.6, words about 3.
ENTROPY = 3.2

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = [2 * v - 9 * (v > 4) for v in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def mod_97(code: str) -> bool:
    """Whether an account number's check digits hold: moved to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def random_looking(text: str) -> bool:
    """Whether a string has the shape of a key: 32 or more hex digits of one case, or digits and letters of both cases; and entropy."""
    code = text.rstrip("=")
    lower, upper = any("a" <= c <= "z" for c in code), any("A" <= c <= "Z" for c in code)
    hexadecimal = len(code) >= 32 and not (lower and upper) and all(c in "0123456789abcdefABCDEF" for c in code)
    if not DIGIT.search(code) or not (hexadecimal or lower and upper):
        return False
    return -sum(n / len(code) * math.log2(n / len(code)) for n in Counter(code).values()) >= ENTROPY


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ can end one local part, which begins where its characters do or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows an account number may look like a part of it, so shorter ends at blanks are tried, the longest first."""
    at = 0
    while m := IBAN.search(text, at):
        start, end = m.span()
        while end > start and not mod_97(text[start:end].replace(" ", "")):
            end = text.rfind(" ", start, end)
            if len(text[start : max(start, end)].replace(" ", "")) < 15:
                end = start
        if end > start:
            yield start, end
        at = max(start + 1, end)


def proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans that pass the rules of their kind, and whether a checksum has confirmed them."""
    if "@" in text:
        yield from (("email", a, b, False) for a, b in emails(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        # leading zeros go first: a part may have more digits than int() takes
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        if 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span(), False
    yield from (("iban", a, b, True) for a, b in ibans(text))
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span(), False
    for m in SECRET.finditer(text):
        if random_looking(m[0]):
            yield "secret", *m.span(), True


def spans(text: str | None) -> list[Span]:
    """(start, end, kind, score) by start, then by kind as listed."""
    found = []
    for kind, start, end, confirmed in proposed(text or ""):
        near = set(WORDS.findall(text[max(0, start - NEAR) : start].lower()))
        score = PATTERN[kind] + CHECKSUM * confirmed
        score += FITTING * bool(near & FITTING_WORDS[kind]) + UNFITTING * bool(near & UNFITTING_WORDS.get(kind, set()))
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= THRESHOLD:
            found.append((start, end, kind, score))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_spans(docs: DataFrame) -> DataFrame:
    """Per row doc_id and spans, an array of (start, end, kind, score)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(span.names, s)) for s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    schema = f"doc_id {kind}, spans array<struct<start bigint, end bigint, kind string, score double>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become the first one's."""

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for start, end, kind, _ in spans(text):
            if start >= done:
                out += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return text and "".join([*out, text[done:]])

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], cleaned, *batch.columns[place + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
