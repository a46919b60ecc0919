"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the characters and cues every kind of personal data has to
contain: at-signs, plus signs, digits, schemes and account words. From each anchor a small local
parser expands to the left and right and validates the span. Text without anchors is never
looked at again, and every parser is linear in the length of its span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")  # the base, in report order
MORE = ("iban", "login")  # added here: account numbers after a cue, credentials inside URLs
CUES = ("iban", "IBAN", "Iban")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[^A-Za-z0-9\n]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/]+(?=@)")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, patterns in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("cue", CUES), ("scheme", SCHEMES)):
        for p in patterns:
            machine.add_word(p, (kind, len(p)))
    machine.make_automaton()
    return machine


def find_spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in report order; the base kinds are leftmost and non-overlapping."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + MORE}
    email_end = ip_done = card_done = 0
    for last, (kind, size) in machine.iter(text):
        if kind == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, last + 1) if start < last else None
            if domain:
                email_end = domain.end()
                found["email"].append((start, email_end))
        elif kind == "digit":
            # A run of digits is taken once, by its first anchor.
            if last >= ip_done:
                m = _IP.match(text, last)
                if m:
                    ip_done = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:
                    # No quadruple starts at this run; the next run may start one.
                    ip_done = last + 1
                    while ip_done < len(text) and text[ip_done] in "0123456789":
                        ip_done += 1
            if last >= card_done:
                m = _CARD.match(text, last)
                card_done = m.end() if m else last + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "plus":
            m = _PHONE.match(text, last)
            if m and 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif kind == "cue":
            m = _IBAN.match(text, last + 1)
            if m and _iban_holds(m[1]):
                found["iban"].append(m.span(1))
        else:
            m = _LOGIN.match(text, last + 1)
            if m:
                found["login"].append(m.span())
    return [(kind, a, b) for kind in KINDS + MORE for a, b in sorted(set(found[kind]))]


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Personal data in each row of ``documents`` (doc_id, text), whole texts, code point offsets.

    A NULL or empty text has no spans (empty ``spans``, digest of the empty text). Rows of
    repeated or NULL doc_ids are all kept; an empty table gives an empty result. Other columns
    are not read.
    """
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = anchors()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find_spans(text, machine) if text else []
                base = [s for s in spans if s[0] in KINDS]
                row = {"doc_id": doc_id} | {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
                row["base_sha256"] = hashlib.sha256(_listed(base).encode()).hexdigest()
                row["spans"] = _listed(spans)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_ARROW = pa.schema(
    [("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())]
)
