"""Personal data: anchors found by an Aho-Corasick automaton, grown to spans by local parsers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from colonnade.llm.storage import text_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "address", "secret", "iban")

# Cues that announce an identifier, each with the shape of the value that follows: fixed values.
SECRET_CUES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "token", "secret", "api_key", "apikey", "password", "passwd")
IBAN_CUES = ("IBAN", "iban", "Iban")
STREET_CUES = (
    " Street", " St.", " Avenue", " Ave.", " Road", " Rd.", " Lane", " Boulevard", " Blvd.", " Drive", "straße", "strasse",
)
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
MAIL_REST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
ASSIGNED = re.compile(r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"',;]{8,})")
IBAN = re.compile(r"\s{0,3}:?\s{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
STREET_HEAD = re.compile(r"([0-9]{1,5})\x20(?:[A-Z][a-z]+\x20?){1,3}$")
HOUSE = re.compile(r"\x20[0-9]{1,4}[a-z]?(?![A-Za-z0-9])")


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def build_automaton():
    """Anchors: at-signs, digits, plus signs, schemes and identifier cues, each with the parser it wakes."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in [
        ("@", "email"), ("+", "phone"), *[(d, "digit") for d in "0123456789"], *[(s, "url") for s in SCHEMES],
        *[(c, "secret") for c in SECRET_CUES], *[(c, "iban") for c in IBAN_CUES], *[(c, "address") for c in STREET_CUES],
    ]:
        automaton.add_word(word, (kind, word))
    automaton.make_automaton()
    return automaton


class SpanFinder:
    """All spans of a text. Base kinds follow their patterns: leftmost, not overlapping, and a span that fails its
    test is dropped without another try. The further kinds are found apart from them and never displace them."""

    def __init__(self):
        self.anchors = build_automaton()

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {}
        free = dict.fromkeys(BASE_KINDS + MORE_KINDS, 0)
        run_end = 0

        def add(kind: str, start: int, end: int) -> None:
            found.setdefault(kind, []).append((start, end))

        for last, (kind, word) in self.anchors.iter(text):
            start, after = last + 1 - len(word), last + 1
            if kind == "digit":
                if start >= free["card"] and (m := NUMBER.match(text, start)):
                    free["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and passes_luhn(digits):
                        add("card", start, m.end())
                if start >= run_end and start >= free["ip"]:
                    # Inside a run of digits a later start cannot match where the first did not.
                    if m := DOTTED.match(text, start):
                        free["ip"] = m.end()
                        if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m.group().split(".")):
                            add("ip", start, m.end())
                    else:
                        run_end = DIGITS.match(text, start).end()
            elif kind == "phone":
                if start >= free["phone"] and (m := PHONE.match(text, start)):
                    free["phone"] = m.end()
                    if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                        add("phone", start, m.end())
            elif kind == "email":
                begin = start
                while begin > free["email"] and text[begin - 1] in LOCAL:
                    begin -= 1
                if begin < start and (m := DOMAIN.match(text, after)):
                    free["email"] = m.end()
                    add("email", begin, m.end())
            elif start >= free[kind]:
                span = self._grow(kind, word, text, start, after)
                if span and span[0] >= free[kind]:
                    free[kind] = span[1]
                    add(kind, *span)
        return found

    def _grow(self, kind: str, word: str, text: str, start: int, after: int) -> tuple[int, int] | None:
        if kind == "url":
            m = (MAIL_REST if word == "mailto:" else URL_REST).match(text, after)
            return (start, after + len(m.group().rstrip(".,;:!?)]}"))) if m else None
        if kind == "iban":
            m = IBAN.match(text, after)
            return m.span(1) if m and valid_iban(m.group(1)) else None
        if kind == "secret":
            if word in ("AKIA", "ASIA"):
                m = KEY.match(text, after)
                return (start, m.end()) if m and not text[max(0, start - 1) : start].isalnum() else None
            if word in ("ghp_", "gho_", "xoxb-", "xoxp-", "sk-"):
                m = TOKEN.match(text, after)
                return (start, m.end()) if m and not text[max(0, start - 1) : start].isalnum() else None
            m = ASSIGNED.match(text, after)
            return m.span(1) if m else None
        if word.endswith("e") and word[0] != " ":
            # One word that ends in "street", then a house number.
            m = HOUSE.match(text, after)
            begin = start
            while begin and text[begin - 1].isalpha() and start - begin < 40:
                begin -= 1
            return (begin, m.end()) if m and begin < start and text[begin].isupper() else None
        head = STREET_HEAD.search(text, max(0, start - 60), start)
        return (head.start(), after) if head and not text[max(0, head.start() - 1) : head.start()].isalnum() else None


def written(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans.get(kind, ()))


_FINDER: list[SpanFinder] = []


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Positions count code points, the end is exclusive. ``spans`` lists the base kinds, then url, address,
    secret and iban, each by start. A null text counts as empty. Rows are independent: no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _FINDER:
            _FINDER.append(SpanFinder())
        for batch in batches:
            for _, part in text_batches(batch, "text"):
                spans = [_FINDER[0].find(t) if t else {} for t in part.column("text").to_pylist()]
                base = [written(s, BASE_KINDS) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")]
                    + [pa.array([len(s.get(k, ())) for s in spans], pa.int64()) for k in BASE_KINDS]
                    + [
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                        pa.array([written(s, BASE_KINDS + MORE_KINDS) for s in spans], pa.string()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
                )

    form = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, form)
