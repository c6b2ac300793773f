"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, each leftmost and without overlaps of its own: email; ip (parts up to 255); card (16 to 19
digits that pass Luhn); phone (a plus, 8 to 15 digits). They are always reported if their check passes.
Further kinds are reported from a score of ACCEPT on: iban (mod 97), short_card (13 to 15 digits, Luhn),
ssn, local_phone. A proposal starts with its kind's prior, a passed checksum raises it, and so does a
context word of the kind within NEAR characters before or after. Further spans never
overlap a base span.

Every search is linear in the text: the patterns are anchored where a run begins. Offsets
count code points, ends are exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "short_card", "ssn", "local_phone")
ACCEPT = 0.75
NEAR = 40

# Patterns of the base kinds (email in two parts) and of the further kinds.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9(+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "amex", "diners", "credit", "karte", "carte", "tarjeta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.4, "short_card": 0.15, "ssn": 0.4, "local_phone": 0.4}
CHECKSUM, NEARBY = 0.4, 0.35

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def _iban_end(text: str, m: re.Match) -> int | None:
    """The end of the longest reading at a blank that passes mod 97."""
    end = m.end()
    while end > m.start():
        compact = text[m.start() : end].replace(" ", "")
        if len(compact) < 15:
            return None
        if len(compact) <= 34 and mod97(compact):
            return end
        end = text.rfind(" ", m.start(), end)
    return None


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for m in IBAN.finditer(text):
        end = _iban_end(text, m)
        if end is not None:
            yield "iban", m.start(), end, True
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 29:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits):
                yield "short_card", m.start(), m.end(), True
    for m in SSN.finditer(text):
        area = m.group()[:3]
        if area not in ("000", "666") and area[0] != "9":
            yield "ssn", m.start(), m.end(), False
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


def _score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = re.findall(r"[^\W\d_]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower())
    hint = any(w.startswith(c) if len(c) > 3 else w == c for w in near for c in CONTEXT[kind])
    return round(min(1.0, PRIOR[kind] + CHECKSUM * checked + NEARBY * hint), 2)


def find(text: str) -> list[Span]:
    """All spans: base kinds in their order, then further kinds, each by start."""
    base = base_spans(text)
    spans = [(k, a, b, _score(text, k, a, b, k == "card")) for k, a, b in base]
    more = []
    if any(c in text for c in "0123456789"):
        for kind, a, b, checked in _proposals(text):
            score = _score(text, kind, a, b, checked)
            if score >= ACCEPT and not any(a < y and x < b for _, x, y in base):
                more.append((kind, a, b, score))
    return spans + sorted(more, key=lambda s: (FURTHER.index(s[0]), s[1]))


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [dict(zip(("kind", "start", "end", "score"), s)) for s in find(t or "")]
            for t in batch.column(batch.num_columns - 1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, _ARROW)], [*batch.schema.names[:-1], "spans"])


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and its spans with scores."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).cast("string").alias("text"))
    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(_search, f"row {kind}, spans {SPAN}")


def of_kinds(kinds: tuple[str, ...], spans: str = "spans") -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def masked(text: str, found: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = b
    return "".join(out) + text[done:]
