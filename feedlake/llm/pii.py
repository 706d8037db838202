"""Personal data in texts: plain identifiers, and disguised ones found through offset-keeping transducers.

A base identifier stands in a text as it is. A disguised one appears only after rewriting, by a chain of
transducers of which each reads what the one before wrote: homoglyphs and digits of other scripts become
ASCII and invisible characters vanish; bracketed at and dot become their signs; spoken at and dot do
within what reads as an address; runs of spelled digits become digits. A ``Rewrite`` keeps, for each
piece it wrote, the source span the piece came from, and a ``Chain`` of them maps a span found in any
step's text back to source code points. Detection runs on every step's text. A disguised span is added
wherever its source range is no base span's, also where it reaches further than a base span that saw
only a part of the identifier.

A single spoken dot after a single plain word ("met at noon dot com") is an address only behind a word
that announces one; see ``_announced``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: n for n, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMERIC = re.compile(r"[0-9][0-9. -]*")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһկոԛԝвмнтАВЕКМНОРСТХУІЈЅαινορυκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhknqwbmhtABEKMHOPCTXYIJSaivopuktABEZHIKMNOPTYX",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
_DOTS = {"。": ".", "․": ".", "｡": ".", "‧": "."}
# The digits' names in English, German, French and Spanish, and words for signs.
_DIGIT_WORDS = {
    w: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
}
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_AT_WORDS = ("at", "arroba")
_ENDINGS = frozenset("com org net edu gov mil int info biz io ai app dev me tv co uk us de fr es it nl eu ch at be se no pl ru cn jp in br mx example test invalid".split())

_ODD = re.compile(f"[{_INVISIBLE}{''.join(_DOTS)}{''.join(_LOOKALIKES)}٠-٩۰-۹०-९！-～﹒﹫₀-₉⁰¹²³⁴-⁹]")
_AT_SIGN = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{'|'.join(_AT_WORDS)}|@)\s{{0,3}}[\])}}>]\s{{0,3}}", re.IGNORECASE)
_DOT_SIGN = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{'|'.join(_DOT_WORDS)}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.IGNORECASE)
_BRACKET = re.compile(r"[\[({<]")
_SAID_DOT = rf"\s{{1,3}}(?:{'|'.join(_DOT_WORDS)})\s{{1,3}}"
_SAID_AT = rf"\s{{1,3}}(?:{'|'.join(_AT_WORDS)})\s{{1,3}}"
_NAME = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
# A local part holds 31 dots at most and a host 15.
_SPOKEN_MAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>{_NAME}(?:{_SAID_DOT}{_NAME}){{0,31}})(?P<at>{_SAID_AT}|@)(?P<host>{_LABEL}(?:(?:{_SAID_DOT}|\.){_LABEL}){{0,15}})(?:{_SAID_DOT}|\.)(?:{'|'.join(sorted(_ENDINGS))})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_SAID = re.compile(rf"(?P<dot>{_SAID_DOT})|{_SAID_AT}", re.IGNORECASE)
# Words that announce an address.
_CUES = ("mail", "email", "e-mail", "contact", "write", "reach", "address", "ping", "reply", "kontakt", "adresse", "courriel", "correo", "schreib", "écri", "escrib")
_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus\s{{1,2}})?(?:{_WORDS}|[0-9]|{'|'.join(_DOT_WORDS)})(?:[ ,.-]{{1,3}}(?:{_WORDS}|[0-9]|{'|'.join(_DOT_WORDS)})){{6,}})(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(plus)\s*|({'|'.join(_DOT_WORDS)})|({_WORDS})|([0-9])|[ ,.-]+", re.IGNORECASE)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", done if domain else at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = int(d) * (1 + n % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _bare(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Plain identifiers: leftmost, not overlapping within a kind; matches that fail their check are dropped."""
    out = list(_emails(text))
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        chunk = run.group()
        out += [("ip", a + m.start(), a + m.end()) for m in _IP.finditer(chunk) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(chunk):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _bare(m.group())) <= 19 and luhn(digits):
                out.append(("card", a + m.start(), a + m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_bare(m.group())) <= 15]
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], _ORDER[span[0]], span[2]


class Rewrite:
    """Rewritten text whose positions map back to source code points."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.starts, self.pieces, written, at = [], [], [], 0
        position = 0
        for a, b, new in [*edits, (len(source), len(source), "")]:
            for piece, lo, hi, verbatim in ((source[at:a], at, a, True), (new, a, b, False)):
                if piece:
                    self.starts.append(position)
                    self.pieces.append((lo, hi, verbatim))
                    written.append(piece)
                    position += len(piece)
            at = b
        self.text = "".join(written)

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of rewritten positions ``start`` to ``end``, and whether anything in it was rewritten."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        lo, hi, verbatim = self.pieces[first]
        a = lo + start - self.starts[first] if verbatim else lo
        lo, hi, verbatim = self.pieces[last]
        b = lo + end - self.starts[last] if verbatim else hi
        return a, b, any(not p[2] for p in self.pieces[first : last + 1])


def _plain_sign(char: str) -> str:
    if char in _INVISIBLE:
        return ""
    if char in _LOOKALIKES or char in _DOTS:
        return _LOOKALIKES.get(char) or _DOTS[char]
    if (digit := unicodedata.decimal(char, None)) is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", char)
    return wide if len(wide) == 1 and wide.isascii() else char


def _merged(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, each starting where the one before has ended or later."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class Chain:
    """Transducers one after another; ``origin`` maps positions of the last text through all of them."""

    def __init__(self, source: str):
        self.text, self.steps = source, []

    def then(self, edits: list[tuple[int, int, str]]) -> bool:
        """Rewrite the present text; whether there was anything to rewrite."""
        if edits:
            self.steps.append(Rewrite(self.text, _merged(edits)))
            self.text = self.steps[-1].text
        return bool(edits)

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of positions ``start`` to ``end`` of the present text, and whether any step rewrote something in it."""
        changed = False
        for step in reversed(self.steps):
            start, end, here = step.origin(start, end)
            changed |= here
        return start, end, changed


def signs(text: str) -> list[tuple[int, int, str]]:
    """Edits that make homoglyphs and foreign digits ASCII and drop invisible characters."""
    return [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain_sign(m.group())) != m.group()]


def bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits that make bracketed at and dot their signs."""
    return [(m.start(), m.end(), "@") for m in _AT_SIGN.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT_SIGN.finditer(text)]


def _announced(text: str, m: re.Match) -> bool:
    """Whether what reads as a spoken address is one: by a sign or a dot or digit in its local part, two dots in its host, or a word before it."""
    if m["at"] == "@" or re.search(r"[0-9._%+-]|\s", m["local"]) or re.search(r"\s|\.", m["host"]):
        return True
    before = text[max(0, m.start() - 40) : m.start()].lower()
    return any(c in before or m["local"].lower() == c for c in _CUES)


def spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits that make spoken at and dot signs within addresses."""
    out = []
    for m in _SPOKEN_MAIL.finditer(text):
        if _announced(text, m):
            out += [(s.start(), s.end(), "." if s["dot"] else "@") for s in _SAID.finditer(text, *m.span())]
    return out


_LETTER = re.compile(r"[^\W\d_]")


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that make runs of seven or more spelled digits, with words for dot and plus, digits."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        if not _LETTER.search(run.group()):
            continue  # digits as they are
        for m in _SPELLED_PART.finditer(text, *run.span()):
            plus, dot, word, digit = m.groups()
            edits.append((m.start(), m.end(), "+" if plus else "." if dot else _DIGIT_WORDS[word.lower()] if word else digit or ""))
    return edits


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only a rewriting shows in their full range, which is no base span's."""
    chain = Chain(text)
    found: list[Span] = []
    plain = {(a, b) for _, a, b in base}

    def detect() -> None:
        for kind, a, b in base_spans(chain.text):
            lo, hi, changed = chain.origin(a, b)
            if changed and (lo, hi) not in plain and not any(x <= lo and hi <= y for _, x, y in found):
                found[:] = [f for f in found if not (lo <= f[1] and f[2] <= hi)]
                found.append((kind, lo, hi))

    if not text.isascii() and chain.then(signs(text)):
        detect()
    if _BRACKET.search(chain.text) and chain.then(bracketed(chain.text)):
        detect()
    low = chain.text.lower()
    if any(w in low for w in _DOT_WORDS) and chain.then(spoken(chain.text)):
        detect()
    if chain.then(spelled(chain.text)):
        detect()
    return sorted(found, key=_place)


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, in order; a null text has none."""
    base = base_spans(text or "")
    added = disguised_spans(text or "", base)
    return base, sorted(base + added, key=_place)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one, under the first's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_disguised long, base_spans string, spans string, redacted string"


def find(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """``docs`` without its text, with counts of base spans by kind, both span lists, and on demand the redacted text.

    One pass over whole texts of any length, no shuffle. A null text counts as empty and stays null when
    redacted. Spans of one start are listed by kind. Repeated rows give equal results, an empty table
    none. Columns of ``docs`` by this operator's names are replaced; all others pass through as they are.
    """

    def make(texts):
        rows = []
        for t in texts:
            base, spans = all_spans(t)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, len(spans) - len(base), written(base), written(spans), redact(t, spans) if redacted and t is not None else None))
        return list(zip(*rows, strict=True)) or [()] * 8

    return map_rows(docs, [text], SCHEMA, make, drop=[text])


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document text."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_disguised")
