"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and words
that introduce an identifier. Each anchor is handed to a small deterministic parser that
expands it to both sides as far as the kind's characters go and validates what it got
(octet range, Luhn and mod-97 checks, digit counts). A stretch is parsed once, so the
work is linear in the text.

Kinds, in the order of their spans: ``email``, ``ip``, ``card`` and ``phone``, each the
leftmost non-overlapping matches of its pattern, failing ones dropped; then ``account``
(an account cue, then an IBAN with a valid check or at least six digits), ``secret`` (a
credential cue, ``=`` or ``:``, then at least 16 characters of a key) and ``address`` (the
``user:password`` part of a URL). Spans of different kinds may overlap.

Null texts have no spans and stay null when redacted; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import small_batches

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "address")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|#))?[ ]?[:=#]?[ ]?(?:([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})|([0-9](?:[ -]?[0-9]){5,}))", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?[ ]?(?:=|:)[ ]?[\"']?([A-Za-z0-9_/+=.-]{16,})")
_AUTHORITY = re.compile(r"([^\s/?#@:]+:[^\s/?#@]+)@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number, with however many zeros before it, is at most 255."""
    core = digits.lstrip("0")
    return len(core) <= 3 and int(core or "0") <= 255


def iban(text: str) -> bool:
    compact = text.replace(" ", "").upper()
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def iban_end(text: str) -> int:
    """Length of the longest start of ``text`` that ends at a space or the end and is an IBAN."""
    ends = [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] == " ")]
    return next((e for e in ends if iban(text[:e])), 0)


def _only(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "/"), *((str(d), "0") for d in range(10))]:
        found.add_word(word, (len(word), kind))
    for words, kind in ((ACCOUNT_CUES, "a"), (SECRET_CUES, "s")):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (len(form), kind))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of ``text`` in code points, end exclusive, by kind and then by start."""
    got: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    email_end = dotted_end = spaced_end = account_end = secret_end = 0
    for last, (width, anchor) in _anchors().iter(text):
        end = last + 1
        if anchor == "0":
            if last >= dotted_end:
                m = _DOTTED.match(text, last)
                dotted_end = m.end()
                at, parts = last, m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    width = sum(map(len, parts[i : i + 4])) + 3
                    if all(octet(p) for p in parts[i : i + 4]):
                        got["ip"].append(("ip", at, at + width))
                    at += width + 1
            if last >= spaced_end and (m := _SPACED.match(text, last)):
                spaced_end = m.end()
                digits = _only(m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    got["card"].append(("card", last, spaced_end))
        elif anchor == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, end)):
                got["email"].append(("email", start, email_end := m.end()))
        elif anchor == "+":
            if (m := _DIALLED.match(text, last)) and 9 <= len(_only(m[0])) <= 15:
                got["phone"].append(("phone", last, m.end()))
        elif anchor == "a":
            if end > account_end and not text[end : end + 1].isalpha() and (m := _ACCOUNT.match(text, end)):
                start, width = (m.start(1), iban_end(m[1])) if m[1] else (m.start(2), len(m[2]))
                if width:
                    got["account"].append(("account", start, account_end := start + width))
        elif anchor == "s":
            if end > secret_end and (m := _SECRET.match(text, end)):
                got["secret"].append(("secret", m.start(1), secret_end := m.end()))
        elif m := _AUTHORITY.match(text, end):
            got["address"].append(("address", end, m.end(1)))
    return [span for kind in KINDS for span in got[kind]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind."""
    out, at, reach = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= reach:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = reach = max(reach, end)
    return "".join(out) + text[at:]


def spans(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with the spans of each whole text; a column of that name is replaced."""
    small_batches(docs)

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py() or "")] for t in batch]
            yield pa.array(rows, _SPANS_ARROW)

    return docs.withColumn(out_col, found(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of each text replaced by their kind in brackets."""
    small_batches(docs)

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (s := t.as_py()) is None else redacted(s, find(s)) for t in batch], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
