"""Personal data by anchor expansion (operator 6).

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, schemes and words that
announce an identifier. A local parser of each kind expands its anchor to the left and right, as far as the
characters of the kind go, and validates the result. The base kinds (email, ip, card, phone) are what their
patterns match from left to right without overlap; the cues add logins in addresses, addresses with the
at-sign spelled out, bank accounts with a valid check number, social security numbers and account numbers.
These may overlap base spans; among themselves the one that starts first stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: in the order in which spans of one start are listed
KINDS = ("email", "ip", "card", "phone", "login", "spelled_email", "iban", "ssn", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:?#]+@")
_SPELLED = re.compile(r"[\x20]?[A-Za-z0-9-]+(?:[\x20]?[\[(]dot[\])][\x20]?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.IGNORECASE)
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"\x20?(?:no\.?|nr\.?|number|num\.?)?[\x20:=#]{0,3}([0-9]{6,18})(?![0-9])", re.IGNORECASE)

_CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security no"),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "spelled": ("[at]", "(at)"),
    "login": ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "amqp://", "redis://"),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, words in _CUES.items():
        for word in words:
            for shape in {word, word.upper(), word.capitalize(), word.title()}:
                found.add_word(shape, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _left(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, as (kind, start, end) in code points, in order of start and kind."""
    base: list[tuple[str, int, int]] = []
    cues: list[tuple[str, int, int]] = []
    email_from = ip_from = card_from = phone_from = 0
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_from:
                if match := _IP.match(text, at):
                    ip_from = match.end()
                    if all(map(_octet, match[0].split("."))):
                        base.append(("ip", at, ip_from))
                else:
                    ip_from = _DIGIT_RUN.match(text, at).end()
            if at >= card_from:
                match = _CARD.match(text, at)
                card_from = match.end() if match else at + 1
                if match and 12 <= card_from - at:
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append(("card", at, card_from))
        elif kind == "email":
            if match := _DOMAIN.match(text, last + 1):
                start = _left(text, at, email_from)
                if start < at:
                    email_from = match.end()
                    base.append(("email", start, email_from))
        elif kind == "phone":
            if at >= phone_from and (match := _PHONE.match(text, at)):
                phone_from = match.end()
                if 9 <= sum(c in _DIGITS for c in match[0]) <= 15:
                    base.append(("phone", at, phone_from))
        else:
            cues.append((kind, at, last + 1))
    order = {kind: i for i, kind in enumerate(KINDS)}
    base.sort(key=lambda s: (s[1], order[s[0]]))
    added = []
    for kind, start, end in cues:
        if kind == "login":
            if match := _LOGIN.match(text, end):
                added.append(("login", end, match.end() - 1))
        elif kind == "spelled":
            begin = _left(text, start - (text[start - 1 : start] == " "), 0)
            if (match := _SPELLED.match(text, end)) and begin < start and text[begin:start].strip():
                added.append(("spelled_email", begin, match.end()))
        else:
            bounded = not text[start - 1 : start].isalnum() if start else True
            match = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind].match(text, end) if bounded else None
            if match and (kind != "iban" or _iban_valid(match[1])):
                added.append((kind, *match.span(1)))
    if not added:
        return base, base
    spans, reach = list(base), -1
    for span in sorted(added, key=lambda s: (s[1], -s[2])):
        if span[1] >= reach:
            spans.append(span)
            reach = span[2]
    spans.sort(key=lambda s: (s[1], order[s[0]]))
    return base, spans


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at, covered = [], 0, 0
    for kind, start, end in spans:
        if start >= covered:
            out += [text[at:start], f"<{kind.upper()}>"]
        covered = max(covered, end)
        at = covered
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _lists(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    flat = [span for row in rows for span in row]
    kinds, starts, stops = zip(*flat, strict=True) if flat else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _task(masked: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(low, 512)
                texts = [t.as_py() for t in part.column(0)]
                found = [find(t) if t else ([], []) for t in texts]
                out = [_lists([b for b, _ in found]), _lists([s for _, s in found])]
                if masked:
                    out.append(pa.array([mask(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*out, *part.columns[1:]], ["_base", "_spans", "_masked"][: len(out)] + batch.schema.names[1:])

    return task


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per row: the id, ``base`` and ``spans`` (kind, start, end), ``masked`` if asked for, and the columns ``keep``.

    Null and empty texts have no spans; a null text stays null when masked. Rows with equal ids or texts are
    treated each for itself. Columns that are not named are not read.
    """
    carried = [id_col, *(keep or [])]
    schema = f"_base {_SPANS}, _spans {_SPANS}" + ", _masked string" * masked
    schema += "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    read = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)))
    out = read.mapInArrow(_task(masked), schema)
    return out.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)), F.col("_base").alias("base"), F.col("_spans").alias("spans"),
        *([F.col("_masked").alias("masked")] if masked else []),
    )


def listed(spans: str):
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
