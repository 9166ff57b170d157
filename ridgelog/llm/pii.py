"""Personal data: anchors found by an Aho-Corasick automaton and expanded by local parsers."""

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.llm.common import by_runs

#: the kinds that are counted, in the order of equal starts
BASE = ("email", "ip", "card", "phone")
#: kinds that the identifier cues and schemes add
ADDED = ("login", "secret", "iban", "ssn", "account")
KINDS = BASE + ADDED
_RANK = {kind: k for k, kind in enumerate(KINDS)}

# Patterns of the base kinds, each applied where an anchor stands.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_USER_INFO = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_SECRET = re.compile(r"[A-Za-z_]{0,16}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
#: what may stand between a cue and the sign before its number: "number", "no.", "is", the quote that ends a key
_LEAD = r"(?i:[\s_-]{0,3}(?:numbers?|num|no|nr)\b\.?)?[\"']?(?i:\s{1,3}is\b)?"
_IBAN = re.compile(_LEAD + r"[:\s#=\"']{0,5}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[sS]?" + _LEAD + r"[\s:#=()\"'-]{0,5}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(_LEAD + r"[\s:#=\"']{0,5}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])")
#: cue words by the parser that they call; found in any casing, and their words joined by a space, hyphen, underscore or nothing
CUES = {"secret": ("token", "password", "passwd", "pwd", "secret", "api key", "access key", "secret key"), "iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct")}
#: A-Z to a-z
_ASCII_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "phone"), ("://", "login")):
        machine.add_word(sign, (kind, len(sign)))
    for digit in "0123456789":
        machine.add_word(digit, ("digit", 1))
    for kind, words in CUES.items():
        for word in words:
            for form in {word.replace(" ", sign) for sign in (" ", "-", "_", "")}:
                machine.add_word(form, (kind, len(form)))
    machine.make_automaton()
    return machine


def _lower(text: str) -> str:
    """The text in lower case, every character at its place: no character has a shorter lower case, so an equal length means that none has a longer one."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_ASCII_LOWER)


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _iban_holds(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all personal data in a text, in code points, by start and kind.

    Within a base kind the spans are those of a scan for its pattern from left to
    right: a match that fails its check is dropped and the scan goes on behind it.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = phone_end = 0
    for at, (kind, size) in _anchors().iter(_lower(text)):
        if kind == "digit":
            if at >= ip_end and not (at and "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                ip_end = m.end()
                # the parts are compared as text first, because a run of digits may be endless
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                    spans.append((at, ip_end, "ip"))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, card_end, "card"))
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append((start, email_end, "email"))
        elif kind == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append((at, phone_end, "phone"))
        elif kind == "login":
            if m := _USER_INFO.match(text, at + 1):
                spans.append((at + 1, m.end(), "login"))
        elif kind == "secret":
            if m := _SECRET.match(text, at + 1):
                spans.append((*m.span(1), "secret"))
        elif kind == "iban":
            if (m := _IBAN.match(text, at + 1)) and _iban_holds(m[1].replace(" ", "")):
                spans.append((*m.span(1), "iban"))
        elif kind == "ssn":
            if m := _SSN.match(text, at + 1):
                spans.append((*m.span(1), "ssn"))
        elif m := _ACCOUNT.match(text, at + 1):
            spans.append((*m.span(1), "account"))
    return sorted(set(spans), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def joined(spans) -> str:
    """``kind:start:end`` of the spans, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    ``base_sha256`` digests the joined spans of the base kinds, ``spans`` lists all
    spans. Null and empty texts have none. Rows are independent: repeated rows and
    null doc_ids stay; other columns are not read.
    """

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string>")
    def scanned(text: pa.Array) -> pa.Array:
        rows = []
        for t in by_runs(text):
            spans = find_spans(t)
            base = [s for s in spans if s[2] in BASE]
            counts = {f"n_{kind}": sum(s[2] == kind for s in base) for kind in BASE}
            rows.append(counts | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)})
        kinds = [(f"n_{kind}", pa.int64()) for kind in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())]
        return pa.array(rows, pa.struct(kinds))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), scanned(F.col(text).cast("string")).alias("s")).select("doc_id", "s.*")


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced, and ``n_chars``, if there is such a column, counted anew.

    Null texts and their counts stay as they are; no row is dropped.
    """

    @F.arrow_udf("string")
    def mask(text: pa.Array) -> pa.Array:
        return pa.array([redact_text(t) for t in by_runs(text)], pa.string())

    rows = docs.withColumn(text, mask(F.col(text).cast("string")))
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        rows = rows.withColumn(n_chars, F.coalesce(F.length(text).cast(kind), F.col(n_chars))).select(docs.columns)
    return rows
