"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, schemes and words that
announce an identifier. Parsers then widen each anchor to the run of characters its kind can
hold, match within the run, and validate. A run holds every match that touches the anchor, so
matches within runs are the leftmost, non-overlapping matches of the whole text. Every parser
reads a run once, so the time is linear in the text.

Kinds, in the order that settles equal starts: ``email``, ``ip``, ``card``, ``phone`` (the base),
then ``login`` (name and password before the host of a URL), ``iban`` (announced, checked
modulo 97), ``ssn``, ``account``, ``passport`` and ``birth`` (announced numbers and dates), ``secret`` (an
announced password, key or token: eight characters or more without space, letters and digits among
them) and ``key`` (access keys that their first letters give away). Cues count in any case
and as whole words. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; one row per input row; an id may be null or
repeated; extra columns are ignored by ``find_personal_data`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account", "passport", "birth", "secret", "key")

# Fixed: the shapes of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER_RUN = re.compile(r"[0-9+\x20().-]*")
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_GAP = r"(?:[\s_-]{0,2}(?:no|nr|num|number|id|code)\b\.?)?(?:\s{0,2}(?:is|was|[:=#-]))?[\s\"']{0,3}"
_AFTER = {
    "iban": re.compile(_GAP + r"([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.A | re.I),
    "ssn": re.compile(r"[\s:#a-z]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.A | re.I),
    "account": re.compile(_GAP + r"([0-9]{6,17})(?![0-9])", re.A | re.I),
    "passport": re.compile(_GAP + r"([A-Z]{0,2}[0-9]{6,9})(?![A-Za-z0-9])", re.A | re.I),
    "birth": re.compile(_GAP + r"([0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9])", re.A | re.I),
    "secret": re.compile(r"[\"']?\s{0,2}(?:[:=]|\bis\b)\s{0,2}[\"']?([^\s\"'<>,;]{8,4096})", re.A),
}
# Fixed: words that announce an identifier, in small letters.
_CUES = {
    "iban": ("iban", "bank account"),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "kontonummer", "cuenta", "compte"),
    "passport": ("passport", "reisepass", "pasaporte", "passeport"),
    "birth": ("date of birth", "birth date", "birthdate", "birthday", "dob", "born on", "geburtsdatum"),
    "secret": ("password", "passwd", "passphrase", "secret", "api key", "api_key", "apikey", "access key", "access_key", "token", "bearer", "kennwort", "passwort"),
}
# Fixed: how access keys of well-known services begin, and what follows.
_KEYS = {
    "akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{20,80}(?![0-9A-Za-z-])"),
    "-----begin ": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
}
_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for sign in "0123456789+":
            automaton.add_word(sign, ("number", 1))
        automaton.add_word("@", ("mail", 1))
        automaton.add_word("://", ("login", 3))
        for kind, words in _CUES.items():
            for word in words:
                automaton.add_word(word, (kind, len(word)))
        for start in _KEYS:
            automaton.add_word(start, ("key", len(start)))
        automaton.make_automaton()
        _automaton = automaton
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _numbers(text: str, start: int, end: int):
    """Addresses, cards and phones in a run of digits and the signs between them."""
    for m in _DOTTED.finditer(text, start, end):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            stop = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield "ip", at, stop
            at = stop + 1
    for m in _CARD.finditer(text, start, end):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text, start, end):
        if 10 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _holds(kind: str, value: str) -> bool:
    """Whether what follows a cue is an identifier of its kind."""
    if kind == "iban":
        return _iban(value.upper())
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value < "9" and value[4:6] != "00" and value[7:] != "0000"
    if kind == "secret":
        return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return True


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all personal data, in order."""
    found: set[tuple[int, int, int]] = set()
    mail_end = number_end = 0
    small = text.lower()
    if len(small) != len(text):  # some capitals have two small letters, which would move what follows
        small = text.translate(_SMALL)
    for at, (kind, size) in _anchors().iter(small):
        if kind == "number":
            if at < number_end:
                continue
            number_end = _NUMBER_RUN.match(text, at).end()
            found.update((a, KINDS.index(k), b) for k, a, b in _numbers(text, at, number_end))
        elif kind == "mail":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                mail_end = domain.end()
                found.add((start, 0, mail_end))
        elif kind == "login":
            m = _LOGIN.match(text, at + 1)
            if m and _SCHEME.search(text[max(0, at - 42) : at - 2]):
                found.add((m.start(), 4, m.end()))
        elif kind == "key":
            start = at + 1 - size
            m = _KEYS[small[start : at + 1]].match(text, start)
            if m and (start == 0 or not text[start - 1].isalnum()):
                found.add((start, KINDS.index("key"), m.end()))
        else:
            m = _AFTER[kind].match(text, at + 1)
            if m and not text[at - size : at + 1 - size].isalnum() and _holds(kind, m.group(1)):
                found.add((m.start(1), KINDS.index(kind), m.end(1)))
    return sorted(found)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (``kind:start:end``, comma-joined) per row."""

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = []
            for text in part.column(1).to_pylist():
                spans = spans_of(text) if text else []
                base = [s for s in spans if s[1] < len(BASE)]
                counts = [sum(1 for s in base if s[1] == k) for k in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
            columns = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(texts, step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with personal data replaced by its kind in angle brackets; overlapping spans by that of the first."""
    out, at, end = [], 0, 0
    for start, kind, stop in spans_of(text):
        if start >= end:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end = max(end, stop)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with masked texts; ``n_chars``, if there, follows the text. Null texts stay null."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: masked(t) if t else t)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out.select(docs.columns)
