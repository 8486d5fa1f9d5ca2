"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, pairs of digits as they stand in addresses and numbers,
plus signs before digits, schemes with a login, and identifier cues. From an anchor a deterministic parser expands
to the bounds that the kind's characters allow, and validates what stands there. No parser reads a stretch of text
more than a few times, whatever cues repeat in it, so that time is in proportion to a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each, table

BASE = ("email", "ip", "card", "phone")
#: Kinds beside the base ones, in the order of the spans column.
MORE = ("secret", "iban", "account", "login")

Span = tuple[int, int]
_DIGITS = "0123456789"
#: The characters that a match of a kind can consist of.
_RUNS = {kind: (frozenset(chars), re.compile(f"[{chars}]+")) for kind, chars in {"ip": _DIGITS + ".", "card": _DIGITS + " -"}.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may follow the word that a cue stands in, and the word's own end.
_REST, _WORD = re.compile(r"[\w-]*+"), re.compile(r"\w*+")
_SECRET = re.compile(r"[\"']?[ \t]*+[:=][ \t]*+[\"']?([A-Za-z0-9_+/=.-]{16,})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LINE = re.compile(r"[^\n]*")
_ACCOUNT = re.compile(r"\.?+[ \t]*+(?:no|nr|number)?+\.?+[ \t]*+[:=#]?+[ \t]*+([0-9](?:[ -]?[0-9]){7,15})(?![0-9])", re.I)
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_CASES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


class _Anchored:
    """Spans of one kind: remembers where the last match or region ended, as anchors come from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.end, self.spans = text, 0, []

    def add(self, start: int, end: int, valid: bool) -> None:
        self.end = end
        if valid:
            self.spans.append((start, end))

    def region(self, at: int, kind: str) -> Span | None:
        """The longest run around a place, unless it has been dealt with."""
        if at < self.end:
            return None
        start, (allowed, run) = at, _RUNS[kind]
        while start > self.end and self.text[start - 1] in allowed:
            start -= 1
        return start, run.match(self.text, at).end()


class _Email(_Anchored):
    def at(self, sign: int, _: int) -> None:
        start = sign
        while start > self.end and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < sign and (domain := _DOMAIN.match(self.text, sign + 1)):
            self.add(start, domain.end(), True)


class _Ip(_Anchored):
    def at(self, start: int, _: int) -> None:
        if found := self.region(start, "ip"):
            for m in _IP.finditer(self.text, *found):
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                    self.spans.append(m.span())
            self.end = found[1]


class _Card(_Anchored):
    def at(self, start: int, _: int) -> None:
        if found := self.region(start, "card"):
            for m in _CARD.finditer(self.text, *found):
                digits = _digits(m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.spans.append(m.span())
            self.end = found[1]


class _Phone(_Anchored):
    def at(self, plus: int, _: int) -> None:
        if plus >= self.end and (m := _PHONE.match(self.text, plus)):
            self.add(*m.span(), 8 <= len(_digits(m.group())) <= 15)


class _Cued(_Anchored):
    """A kind whose values follow the word that a cue stands in: all cues of a word have the same value, so each word is looked at once."""

    word_end = -1

    def word(self, after: int, rest: re.Pattern) -> bool:
        """Whether the word around a cue hasn't been dealt with; its end is word_end then."""
        if after < self.end or after <= self.word_end:
            return False
        self.word_end = rest.match(self.text, after).end()
        return True


class _Secret(_Cued):
    def at(self, _: int, after: int) -> None:
        if self.word(after, _REST) and (m := _SECRET.match(self.text, self.word_end)):
            value = m.group(1)
            self.add(*m.span(1), any(c in _DIGITS for c in value) and any(c.isalpha() for c in value))


class _Iban(_Anchored):
    def at(self, start: int, after: int) -> None:
        """All numbers from the cue to the end of its line; what fails the check isn't one, and the search goes on within it."""
        at = max(after, self.end)
        stop = _LINE.match(self.text, at).end()
        while m := _IBAN.search(self.text, at, stop):
            at = m.start() + 4
            value = m.group().replace(" ", "")
            for size in range(min(34, len(value)), 14, -1):  # words after the number may look like part of it
                if int("".join(str(int(c, 36)) for c in value[4:size] + value[:4])) % 97 == 1:
                    end = m.start()
                    while size:
                        size -= self.text[end] != " "
                        end += 1
                    self.add(m.start(), end, True)
                    at = end
                    break
        self.end = max(self.end, stop)  # a further cue in the line has nothing left to find


class _Account(_Cued):
    def at(self, _: int, after: int) -> None:
        """The number after the cue's word, or the digits that the word itself ends in."""
        if self.word(after, _WORD):
            start = self.word_end
            while start > after and self.text[start - 1] in _DIGITS:
                start -= 1
            m = _ACCOUNT.match(self.text, self.word_end) or start < self.word_end and _ACCOUNT.match(self.text, start)
            if m:
                self.add(*m.span(1), True)


class _Login(_Anchored):
    def at(self, _: int, after: int) -> None:
        if after >= self.end and (m := _LOGIN.match(self.text, after)):
            self.add(*m.span(), True)


_PARSERS: dict[str, Callable[[str], _Anchored]] = dict(zip(BASE + MORE, (_Email, _Ip, _Card, _Phone, _Secret, _Iban, _Account, _Login)))
#: Anchors of each kind. Cues and schemes are looked for in the text in lower case.
_CUES = {"secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key"), "iban": ("iban",), "account": ("account", "acct", "konto")}
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")


def _anchors() -> Iterator[tuple[str, str]]:
    yield "@", "email"
    for a in _DIGITS:
        yield f"+{a}", "phone"
        for b in _DIGITS:
            yield f"{a}.{b}", "ip"
            for sep in ("", " ", "-"):
                yield f"{a}{sep}{b}", "card"
    for kind, cues in _CUES.items():
        for cue in cues:
            yield cue, kind
    for scheme in _SCHEMES:
        yield scheme, "login"


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in _anchors():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


def _lower(text: str) -> str:
    """The text in lower case, every character in its place: A-Z alone where lower() would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_CASES)


def find(text: str | None) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) of each kind in a whole text; kinds without one are missing."""
    parsers: dict[str, _Anchored] = {}
    for last, (size, kind) in _automaton().iter(_lower(text or "")):
        if kind not in parsers:
            parsers[kind] = _PARSERS[kind](text)
        parsers[kind].at(last + 1 - size, last + 1)
    return {k: p.spans for k, p in parsers.items() if p.spans}


SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column) -> Column:
    """All spans of a text column, by kind, then start; an empty list for null and empty texts."""

    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = []
        for text in each(texts):
            found = find(text)
            rows.append([{"kind": k, "start": s, "end": e} for k in BASE + MORE for s, e in found.get(k, ())])
        return pa.array(rows, kind)

    return F.arrow_udf(of, SPANS_DDL)(text)


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and then longest counts."""
    if not (found := find(text)):
        return text
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, all_ in found.items() for s, e in all_), key=lambda x: (x[0], -x[1], x[2])):
        if start >= at:
            out += text[at:start], f"[{kind.upper()}]"
            at = end
        elif end > at:  # what a partly hidden span leaves is hidden too
            at = end
    return "".join([*out, text[at:]])


def redact(text: Column) -> Column:
    """A text column with its personal data replaced; null stays null."""
    return F.arrow_udf(lambda texts: pa.array(map(redact_text, each(texts)), pa.string()), "string")(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and found (the spans) of each row; other columns are ignored, whatever their names."""
    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("found"))


def _of(*kinds: str) -> Column:
    return F.filter("found", lambda x: x["kind"].isin(*kinds))


def _joined(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(_of(*kinds), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(BASE + MORE).alias("spans"))
