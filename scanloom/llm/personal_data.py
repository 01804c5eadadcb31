"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Every kind has a pattern, a check and a base score (``KINDS``). Mail and network addresses, card and phone numbers that
pass their checks are always reported. Bank account numbers (mod 97), national insurance numbers and phone numbers in
national form are proposed more loosely; words nearby raise or lower their scores, and those that reach
``MIN_SCORE`` and overlap no span reported before are added. Offsets count code points, ends are exclusive.

Texts are scanned in Arrow batches within their partitions; nothing is shuffled. Defined results: a null or empty text
has no spans; very long texts are scanned whole, in time that grows with their length; of added spans that overlap, the
first by kind and start stays; rows that repeat are scanned each by itself; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A mail address is found by its @, so that a long run of letters before one is read once and not from each letter; a
# network address begins where a run of digits does, which changes no match: they end where runs end, and from inside a
# run nothing matches that does not match from its start.
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3,5}\)?[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z-])")

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "social", "local_phone")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
#: Score before context, words nearby that raise it and words that lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.8, "social": 0.3, "local_phone": 0.2}
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment", "karte", "tarjeta", "carte"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "social": {"ssn", "social", "security", "insurance"},
    "local_phone": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone"},
}
AGAINST = {"example", "version", "isbn", "order", "invoice", "part", "serial", "test", "sample"}
RAISE, LOWER, MIN_SCORE = 0.4, 0.3, 0.5
#: Code points around a span in which words count as near.
NEAR = 40

SCHEMA = (
    "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: long, end: long, score: double>>"
)


def mails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping mail addresses."""
    end = 0
    at = text.find("@")
    while at >= 0:
        following = at + 1
        if host := MAIL_HOST.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in MAIL_NAME:
                start -= 1
            if start < at:
                end = following = host.end()
                yield "email", start, end
        at = text.find("@", following)


class Taken:
    """Spans reported so far, as disjoint stretches of the text in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Takes the span if it overlaps none."""
        at = bisect_right(self.starts, start)
        if (at and self.ends[at - 1] > start) or (at < len(self.starts) and self.starts[at] < end):
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip_ok(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))


def _card_ok(found: str) -> bool:
    return 16 <= len(d := _digits(found)) <= 19 and luhn(d)


def _phone_ok(found: str) -> bool:
    return 8 <= len(_digits(found)) <= 15


def _iban_end(found: str) -> int:
    """Length of the longest proposal that passes: whole, or without groups that follow after a space."""
    while 15 <= len(plain := found.replace(" ", "")):
        if len(plain) <= 34 and mod97(plain):
            return len(found)
        found = found.rpartition(" ")[0]
    return 0


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed account numbers; after one the search goes on at its end, or else at the next word of what was proposed."""
    at = 0
    while m := IBAN.search(text, at):
        if n := _iban_end(m[0]):
            yield "iban", m.start(), m.start() + n
        at = m.start() + (n or m[0].find(" ") + 1 or len(m[0]))


def _social_ok(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def score(kind: str, text: str, start: int, end: int) -> float:
    near = re.findall(r"[^\W\d_][\w-]*", f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower())
    near = {w.strip("-") for w in near}
    raised = RAISE * bool(near & FOR[kind]) - LOWER * bool(near & AGAINST)
    return round(min(1.0, max(0.0, SCORES[kind] + raised)), 3)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """All spans, base kinds in their order and then the others, each by start."""
    found: list[tuple[str, int, int]] = []
    found += mails(text)
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if _ip_ok(m[0])]
    found += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and _card_ok(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    spans = [(*s, score(s[0], text, s[1], s[2])) for s in found]

    taken = Taken([(s, e) for _, s, e in found])
    loose = list(_accounts(text))
    loose += [("social", *m.span()) for m in SOCIAL.finditer(text) if _social_ok(m[0])]
    loose += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 12]
    for kind, start, end in loose:
        points = score(kind, text, start, end)
        if points >= MIN_SCORE and taken.add(start, end):
            spans.append((kind, start, end, points))
    return sorted(spans, key=lambda s: (ORDER[s[0]], s[1]))


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")}
        for value in batch.column(1):
            spans = spans_of(value.as_py() or "")
            base = [s for s in spans if s[0] in BASE]
            for kind in BASE:
                columns[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            columns["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns["spans"].append(_joined(spans))
            columns["found"].append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans])
        found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [found]
        arrays = [pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans as text and with scores."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def redact(text: str) -> str:
    """The text with every span replaced by its kind."""
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: -s[1]):
        text = f"{text[:start]}<{kind}>{text[end:]}"
    return text
