"""Personal data by offset-preserving deobfuscation.

Base spans come from the text as it is. Then transducers rewrite the text: homoglyphs and full-width signs become the ASCII
they look like, zero-width signs go, spelled digits become digits, and at/dot disguises become @ and dots. Each output character
keeps the source characters it stands for, so what is detected in the rewritten text maps back to a span of the source.
A rewritten find counts only if a disguise took part in it, no span found before holds it whole; base spans
of its kind that it overlaps saw only a part and become one with it.

A transducer only fires on strict forms, to leave ordinary prose alone: a bracketed at or dot, or a bare `at` that a spelled
`dot` and a top-level name follow; spelled digits only in runs of PHONE_DIGITS digits or more, or four by four in an address; and identifiers must pass the same checks.

Cases: null and empty texts have no spans; very long texts are scanned in linear time, since no pattern begins with a run that it could
begin anew within, and what stands around an at or a bracket is walked from there; repeated rows and null keys are scanned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import small_batches

KINDS = ("email", "ip", "card", "phone")
PHONE_DIGITS, MOST_DIGITS = 9, 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HAS_IP = re.compile(r"[0-9]\.[0-9]")
_HAS_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12}")

# Characters that look like ASCII ones, as lookalike then ASCII.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ȷ": "j", "․": ".", "。": ".", "·": ".", "‧": ".", "﹒": ".", "｡": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "﹢": "+",
}
# The full-width forms stand in ASCII's order, the digits of other scripts in blocks of ten.
HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
HOMOGLYPHS |= {chr(start + i): chr(first + i) for start, first in ((0x1D400, 65), (0x1D41A, 97), (0x1D5A0, 65), (0x1D5BA, 97), (0x1D670, 65), (0x1D68A, 97)) for i in range(26)}
ZERO_WIDTH = "­​‌‍⁠﻿"
# Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + ZERO_WIDTH + "]")
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELLED_PAIR = re.compile(rf"(?i)\b{_DIGIT_WORD}[ \-,.]{{1,2}}{_DIGIT_WORD}\b")
_SPELLED_RUN = re.compile(rf"(?i)(?:(?<![A-Za-z0-9])(?:plus[ \-,.]{{0,3}}|\+[ ]?)?(?:{_DIGIT_WORD}|[0-9]+)(?![A-Za-z])(?:[ \-,.()]{{0,3}})){{3,}}")
_OCTET = rf"(?:[0-9]{{1,3}}|{_DIGIT_WORD}(?:[ \-]{_DIGIT_WORD}){{0,2}})"
_SPELLED_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_SPELLED_IP = re.compile(rf"(?i)(?<![A-Za-z0-9]){_OCTET}(?:{_SPELLED_DOT}{_OCTET}){{3}}(?![A-Za-z0-9])")
_SPELLED_OCTET = re.compile(rf"(?i){_DIGIT_WORD}(?:[ \-]{_DIGIT_WORD}){{0,2}}")
_SPELLED_ONE = re.compile(rf"(?i){_DIGIT_WORD}|plus|\+|[0-9]+")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]\s*")
_SPACED_AT = re.compile(r"(?i)(?<=[a-z0-9])\s+@\s*(?=[a-z0-9-]+\s*\.)|(?<=[a-z0-9])@\s+(?=[a-z0-9-]+\s*\.)")
_SPACED_DOT = re.compile(r"(?i)[a-z0-9](?:\s+|_)dot(?:\s+|_)[a-z0-9]")
# Top-level names that end a spelled-out address; none is an everyday word.
TOP_LEVEL = "com org net edu gov mil int info biz io ai app dev co uk de fr es pt nl ch eu ru pl br mx ca au jp cn test example local".split()
_LABEL, _SEPARATOR = "[a-z0-9-]+", r"(?:\s+|_)"
_SPACED_WORD_AT = re.compile(rf"(?i)(?<=[a-z0-9.%+-]){_SEPARATOR}at{_SEPARATOR}(?={_LABEL})")
_SPACED_LABEL = re.compile(rf"(?i)(?!at{_SEPARATOR}){_LABEL}")
_SPACED_NEXT = re.compile(rf"(?i){_SEPARATOR}dot{_SEPARATOR}(?={_LABEL})")
_TOP_LEVEL_NAME = re.compile(r"(?i)(?:" + "|".join(TOP_LEVEL) + r")\b")
_BEFORE_AT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.%+-")
_SPACED_PART = re.compile(r"(?i)(?:\s+|_)(at|dot)(?:\s+|_)")
_SPACED_IP = re.compile(r"(?i)(?<![0-9])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the run of local characters before it, walked back from the @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                last = m.end()
                out.append((start, last))
        at = text.find("@", at + 1)
    return out


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind, in code points."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _HAS_IP.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _HAS_CARD.search(text):
        found["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= MOST_DIGITS and luhn(d)]
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if PHONE_DIGITS <= len(_digits(m[0])) <= 15]
    return found


class Spans:
    """Spans apart, in order; what overlaps becomes one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and end <= self.ends[i]

    def meets(self, start: int, end: int) -> bool:
        return bisect_right(self.ends, start) < bisect_left(self.starts, end)

    def add(self, start: int, end: int) -> None:
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def listed(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))


class Rewritten:
    """A text with stretches replaced, and where each of its characters comes from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, replacement), in order and apart."""
        parts, self.starts, self.sources, last, size = [], [0], [(0, 0, False)], 0, 0
        for start, end, new in edits:
            self._add(size, last, start, False)
            parts.append(text[last:start])
            size += start - last
            self._add(size, start, end, True)
            parts.append(new)
            size += len(new)
            last = end
        self._add(size, last, len(text), False)
        parts.append(text[last:])
        self.text = "".join(parts)

    def _add(self, at: int, start: int, end: int, edited: bool) -> None:
        if self.starts[-1] == at:  # the stretch before it has no characters here
            self.sources[-1] = (start, end, edited)
        else:
            self.starts.append(at)
            self.sources.append((start, end, edited))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of characters start to end, and whether an edit lies in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, a_end, a_edit = self.sources[i]
        b, b_end, b_edit = self.sources[j]
        first = a if a_edit else a + start - self.starts[i]
        last = b_end if b_edit else b + end - self.starts[j]
        return first, last, any(self.sources[k][2] for k in range(i, j + 1)) or last - first != end - start


def _lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), HOMOGLYPHS.get(m[0], "")) for m in _ODD.finditer(text)]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    addresses = [m.span() for m in _SPELLED_IP.finditer(text)]
    edits = [(m.start(), m.end(), "".join(SPELLED[x[0].lower()] for x in _SPELLED_ONE.finditer(m[0]))) for a, b in addresses for m in _SPELLED_OCTET.finditer(text, a, b)]
    taken = Spans(addresses)
    for m in _SPELLED_RUN.finditer(text):
        if taken.meets(m.start(), m.end()):
            continue
        run = m[0].rstrip(" -,.()")
        if sum(1 for _ in re.finditer(rf"(?i){_DIGIT_WORD}", run)) >= 3:
            digits = "".join({"plus": "+", "+": "+"}.get(x[0].lower(), SPELLED.get(x[0].lower(), x[0])) for x in _SPELLED_ONE.finditer(run))
            plain = digits.replace("+", "")
            if PHONE_DIGITS <= len(plain) <= MOST_DIGITS:
                edits.append((m.start(), m.start() + len(run), digits))
    return sorted(edits)


def _word_before(text: str, end: int) -> int | None:
    """Where the word of an address that ends here starts; None if there is none, or it is an `at`."""
    start = end
    while start and text[start - 1] in _BEFORE_AT:
        start -= 1
    return None if start == end or text[start:end].lower() == "at" else start


def _blanks_before(text: str, end: int) -> int:
    """Where the blanks or the underscore that end here start."""
    if end and text[end - 1] == "_":
        return end - 1
    while end and text[end - 1].isspace():
        end -= 1
    return end


def _spaced_mails(text: str) -> list[tuple[int, int]]:
    """Addresses spelled out with a bare `at` and `dot`, walked from each `at` to both sides; no word before or behind it is an `at`, so that no word is walked twice for one side."""
    out, last = [], 0
    for m in _SPACED_WORD_AT.finditer(text):
        if m.start() < last:
            continue
        ends, label = [], _SPACED_LABEL.match(text, m.end())
        while label and (dot := _SPACED_NEXT.match(text, label.end())):
            if top := _TOP_LEVEL_NAME.match(text, dot.end()):
                ends.append(top.end())
            label = _SPACED_LABEL.match(text, dot.end())
        start = _word_before(text, m.start())
        if not ends or start is None:
            continue
        while (gap := _blanks_before(text, start)) < start and text[max(gap - 3, 0) : gap].lower() == "dot" and (more := _blanks_before(text, gap - 3)) < gap - 3 and (word := _word_before(text, more)) is not None:
            start = word
        if start >= last and not (start and text[start - 1] == "_"):
            last = ends[-1]
            out.append((start, last))
    return out


def _disguise_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(_blanks_before(text, m.start()) if text[m.start() - 1 : m.start()].isspace() else m.start(), m.end(), "@" if re.search(r"(?i)at|@", m[0]) else ".") for m in _BRACKETED.finditer(text)]
    if _SPACED_DOT.search(text):
        for a, b in [*_spaced_mails(text), *[m.span() for m in _SPACED_IP.finditer(text)]]:
            edits += [(p.start(), p.end(), "@" if p[1].lower() == "at" else ".") for p in _SPACED_PART.finditer(text, a, b)]
    if "@" in text:
        edits += [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)]
    if any(x[2] == "@" for x in edits):  # the dots of an address with a disguised at may be spelled
        edits += [(m.start(), m.end(), ".") for m in re.finditer(r"(?i)(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9])", text)]
    out: list[tuple[int, int, str]] = []
    for x in sorted(set(edits)):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _may_look_alike(text: str) -> bool:
    return not text.isascii() and _ODD.search(text) is not None


def _may_spell(text: str) -> bool:
    return bool(_SPELLED_PAIR.search(text) or _SPELLED_IP.search(text))


def _may_disguise(text: str) -> bool:
    return bool(_BRACKETED.search(text) or _SPACED_DOT.search(text) or ("@" in text and _SPACED_AT.search(text)))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans by kind, all spans by kind)."""
    base = detect(text)
    stages: list[Rewritten] = []
    now, numbers = text, []
    for step, may in ((_lookalike_edits, _may_look_alike), (_spelled_edits, _may_spell), (_disguise_edits, _may_disguise)):
        if may(now) and (edits := step(now)):
            if step is _spelled_edits:  # spelled out, a phone number needs no plus
                numbers = [(start, end, len(stages), _digits(new)) for start, end, new in edits if len(_digits(new)) >= PHONE_DIGITS]
            stages.append(Rewritten(now, edits))
            now = stages[-1].text
    if not stages:
        return base, base
    firm, spans = [Spans(x) for x in base.values()], {kind: Spans(x) for kind, x in base.items()}
    found = [(kind, start, end, len(stages)) for kind, own in detect(now).items() for start, end in own]
    for start, end, depth, digits in numbers:
        if len(digits) >= 13 and luhn(digits):
            found.append(("card", start, end, depth))
        elif len(digits) <= 15:
            found.append(("phone", start, end, depth))
    for kind, start, end, depth in found:
        edited = depth < len(stages)
        for stage in reversed(stages[:depth]):
            start, end, touched = stage.source(start, end)
            edited |= touched
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if edited and start < end and not any(x.holds(start, end) for x in (*firm, *spans.values())):
            spans[kind].add(start, end)
    return base, {kind: x.listed() for kind, x in spans.items()}


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    _, spans = find(text)
    out, last = [], 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a < last:  # spans of two kinds overlap: one mark stands for both
            last = max(last, b)
            continue
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join([*out, text[last:]])


def _scan(batches):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, spans = find(text or "")
            for c, v in zip(rows, (key, *[len(base[k]) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(rows)], names=names)


def pii_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, spans with the disguised ones)."""
    small_batches(docs.sparkSession)
    out = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("doc_id", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans of the text column replaced by [kind]; null stays null."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = pa.array([None if t is None else redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op1_pii_offsets(spark, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
