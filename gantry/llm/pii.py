"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are confirmed by their own rule and stay whatever the score.
The method adds iban (country length and the mod-97 checksum), card13 (13 digits that pass Luhn
and have a word such as "card" nearby) and tel (a ten-digit number in groups that starts no base
phone, scored by its shape and by words such as "call" nearby). An added span must reach
THRESHOLD and must not lie inside a base span or an earlier added one.

Every pattern takes time linear in the text: a run of characters is entered at its first one
only, and possessive quantifiers never give a run back. Offsets are code points.

Cases: null and empty texts have no spans; ids, nulls and repeats pass through row by row; other
columns are kept by `redact` and ignored by `spans`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "card13", "tel")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Code points on either side of a span in which words count as nearby.
NEARBY = 48

AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Takes every run of digits whole, so that a run is tried once; the group tells an address.
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
TEL = re.compile(r"[0-9][0-9][0-9][ .-][0-9]{4}(?![0-9])")
TEL_AREA = re.compile(r"(?:(?<![0-9+])\+?1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])$")
WORDS = re.compile(r"[a-z]+")

CARD_WORDS = frozenset("card credit debit visa mastercard amex payment karte kreditkarte carte tarjeta".split())
TEL_WORDS = frozenset("phone tel telephone call mobile cell fax contact telefon anruf portable appel llamar movil".split())
IBAN_WORDS = frozenset("iban account bank transfer konto compte cuenta banque banco".split())
#: Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _nearby(text: str, start: int, end: int, words: frozenset[str]) -> bool:
    around = f"{text[max(0, start - NEARBY):start]} {text[end:end + NEARBY]}".lower()
    return not words.isdisjoint(WORDS.findall(around))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part goes back from an @ as far as its characters and the last match allow."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = AT.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed spans of the four base kinds."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    proposed = []
    at = 0
    while m := IBAN.search(text, at):
        # A match may reach over the next code, so the search goes on within it; each is of bounded length.
        at = m.start() + 1
        if m.start() and text[m.start() - 1].isalnum():
            continue
        code = m.group().replace(" ", "")
        # Words in capitals may follow: the country says how long the code is.
        length = IBAN_LENGTH.get(code[:2], 0)
        if length and len(code) >= length and mod97(code[:length]):
            end, left = m.start(), length
            while left:
                left -= text[end] != " "
                end += 1
            score = 0.8 + 0.2 * _nearby(text, m.start(), end, IBAN_WORDS)
            proposed.append((m.start(), end, "iban", score))
            at = end
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 25:
            digits = digits_of(m.group())
            if len(digits) == 13 and luhn(digits):
                proposed.append((m.start(), m.end(), "card13", 0.3 + 0.4 * _nearby(text, m.start(), m.end(), CARD_WORDS)))
    for m in TEL.finditer(text):
        area = TEL_AREA.search(text, max(0, m.start() - 9), m.start())
        if area:
            shape = 0.3 + 0.2 * area.group().startswith(("+", "(")) + 0.1 * ("(" in area.group())
            proposed.append((area.start(), m.end(), "tel", shape + 0.3 * _nearby(text, area.start(), m.end(), TEL_WORDS)))
    if not proposed:
        return []
    taken = bytearray(len(text))  # a mark for each character, so that a test costs the span's length only
    for a, b, _ in base:
        taken[a:b] = b"\1" * (b - a)
    kept: list[tuple[int, int, str]] = []
    for a, b, kind, score in sorted(proposed, key=lambda p: (-p[3], p[0], KINDS.index(p[2]))):
        if score >= THRESHOLD and taken.find(1, a, b) < 0:
            kept.append((a, b, kind))
            taken[a:b] = b"\1" * (b - a)
    return kept


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each by start and then kind."""
    if not any(c in text for c in "0123456789@"):
        return [], []
    base = base_spans(text)
    return sorted(base, key=_order), sorted(base + added_spans(text, base), key=_order)


def redact_text(text: str, found: list[tuple[int, int, str]]) -> str:
    """Spans become the name of their kind; overlapping ones become one, named after the first."""
    parts, at, until = [], 0, -1
    for a, b, kind in found:
        if a < until:
            until = max(until, b)
            continue
        if until >= 0:
            at = until
        parts += [text[at:a], f"<{kind.upper()}>"]
        until = b
    return "".join(parts) + text[until:] if parts else text


SPAN = "array<struct<start:int,end:int,kind:string>>"


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row: the spans as arrays of (start, end, kind)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def rows(found: list[list[tuple[int, int, str]]]) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "kind"), s)) for s in one] for one in found], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [find(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rows([f[0] for f in found]), rows([f[1] for f in found])], ["doc_id", "base", "spans"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, base {SPAN}, spans {SPAN}")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with all spans of `text` replaced by their kind; null stays null."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [t.as_py() for t in batch.column(at)]
            clean = pa.array([t and redact_text(t, find(t)[1]) for t in texts], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(run, docs.schema)


def digest(found: str) -> Column:
    """kind:start:end of the spans in column `found`, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
