"""Personal data: fixed patterns on the raw text, and the same patterns on a normalised view of it.

The normalised view undoes homoglyphs, invisible characters, spelled digits and at/dot
disguises. Each step is a transducer that keeps, for every normalised character, the span of
source characters it came from, so that what is found there is reported in source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only spares retries inside a run of digits, where no match can start.
_ip = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]+){3})")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping per kind, the failing ones dropped."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # an email starts where the run of local characters before its @ does
        start = at
        while start > last and _local.match(text, start - 1):
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            last = m.end()
            out.append((start, 0, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the normalised view ---------------------------------------------------------------------

#: Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "․": ".", "。": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-",
    "–": "-", "﹫": "@", "﹢": "+",
}
_one = {ord(k): v for k, v in HOMOGLYPHS.items()}
for _point in range(0xA0, 0x20000):  # full-width, mathematical, circled, raised and other forms of one such character
    if re.fullmatch(r"[A-Za-z0-9@.+_%-]", _same := unicodedata.normalize("NFKC", chr(_point))):
        _one.setdefault(_point, _same)
for _zero in (0x0660, 0x06F0, 0x0966):  # digits of other scripts
    _one |= {_zero + i: chr(48 + i) for i in range(10)}
#: Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­"
_odd = frozenset(map(chr, _one)) | frozenset(INVISIBLE)
_hidden = re.compile(f"[{INVISIBLE}]")

#: Digits as words in the four languages, from 0 to 9.
DIGIT_WORDS = (
    "zero oh null zéro cero", "one eins ein un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_word_digit = {w: str(d) for d, ws in enumerate(DIGIT_WORDS) for w in ws.split()}
_dot_words = "dot|point|punkt|punto"
_at_words = "at|arroba|arobase|klammeraffe"
#: Words that repeat the digit after them.
_times = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
_simple = "|".join(sorted(_word_digit, key=len, reverse=True))
_token = rf"(?:(?:{'|'.join(_times)})[ -])?(?:{_simple})"
_o, _c = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_boxed = rf"\s{{0,3}}{_o}(?:{_dot_words}|\.){_c}\s{{0,3}}"
_between = rf"(?:{_boxed}|[\s,.()-]{{1,4}}(?:(?:{_dot_words})\s+)?)"
_spelled = re.compile(rf"(?i)(?:\bplus\s+|\+\s*)?(?<![^\W_])(?:{_token}|[0-9]+)(?:{_between}(?:{_token}|[0-9]+)(?![^\W_]))+")
# Every run with a spelled digit has one before or after another digit, else a dot is a word or in brackets.
_spelled_hint = re.compile(rf"(?i)(?<![^\W_])(?:{_simple}){_between}(?:{_token}|[0-9])")
_number_hint = re.compile(rf"(?i)[0-9](?:{_between}(?:{_token})(?![^\W_])|(?:{_boxed}|[\s,.()-]{{1,4}}(?:{_dot_words})\s+)[0-9])")
_disguised_dot = re.compile(rf"(?i)\b(?:{_dot_words})\b|{_o}\.{_c}")
_piece = re.compile(rf"(?i)(\bplus\b|\+)|({_token})|([0-9]+)|(\b(?:{_dot_words})\b|\.)")

_at_hint = re.compile(rf"(?i)\s{{0,3}}{_o}(?:{_at_words}|@){_c}\s{{0,3}}|\s{{1,3}}(?:{_at_words})\s{{1,3}}|\s{{1,3}}@\s{{0,3}}|@\s{{1,3}}|@")
_d = rf"(?:\s{{0,3}}{_o}(?:{_dot_words}|\.){_c}\s{{0,3}}|\s{{1,3}}(?:{_dot_words})\s{{1,3}}|\.)"
_after = re.compile(rf"(?i)[A-Za-z0-9-]+(?:{_d}[A-Za-z0-9-]+)+")
_local_chars = frozenset(c for c in map(chr, range(0x2200)) if re.match(r"(?i)[A-Za-z0-9_%+-]", c))
_dot_before, _dot_width = re.compile(rf"(?i){_d}\Z"), 19  # the widest disguised dot
_any_dot = re.compile(rf"(?i){_d}")
#: Words that follow a spoken "at" in prose.
_article = re.compile(r"(?i)(?:the|a|an|this|that|my|your|our|his|her|their|its)\b")
# A number complete in itself and one word like "one" or "ein" after it: prose, not a further digit.
_last_word = re.compile(rf"(?i)[\s,.()-]{{1,4}}(?:{_token})\Z")


def _visible(text: str) -> tuple[str, list[int] | None]:
    """Homoglyphs replaced one for one and invisible characters dropped; source positions if any were."""
    plain = text.translate(_one)
    if not _hidden.search(plain):
        return plain, None
    kept = [i for i, c in enumerate(plain) if c not in INVISIBLE]
    return "".join(plain[i] for i in kept), kept


def _digits(run: str) -> tuple[str, list[tuple[int, int]], bool]:
    """A run of spelled or plain digits as digits, + and dots, with the source span of each."""
    out, spans, spelled = [], [], False
    before = 0  # digits of the token before: 0 none, 1 a word or one digit, more a number

    def group(at: int) -> None:
        if before and out[-1] != " ":
            out.append(" "), spans.append((at - 1, at))

    for m in _piece.finditer(run):
        if m[2]:
            if before > 1:
                group(m.start())
            *times, word = m[2].lower().replace("-", " ").split(" ")
            for _ in range(_times[times[0]] if times else 1):
                out.append(_word_digit[word]), spans.append(m.span())
            spelled, before = True, 1
        elif m[3]:
            if len(m[3]) > 1 or before > 1:  # a number of several digits is a group of its own
                group(m.start())
            for i, c in enumerate(m[3]):
                out.append(c), spans.append((m.start() + i, m.start() + i + 1))
            before = len(m[3])
        else:
            out.append("+" if m[1] else "."), spans.append(m.span())
            before = 0
    return "".join(out), spans, spelled


def _local_start(view: str, end: int) -> int:
    """Where the local part that ends at end starts; end if there is none. Walked backwards, so linear in its length."""
    start = at = end
    while True:
        here = at
        while at > 0 and view[at - 1] in _local_chars:
            at -= 1
        if at == here:  # nothing before the dot
            return start
        start = at
        if not (dot := _dot_before.search(view, max(0, start - _dot_width), start)):
            return start
        at = dot.start()


_spoken = re.compile(rf"(?i)(?:(?<=\s)|(?<![^\W_]))(?:{_token})\Z")
_name_before = re.compile(r"[A-Za-z][A-Za-z0-9._%+-]*\s{1,3}\Z")
_widest = max(map(len, _word_digit)) + max(map(len, _times)) + 1


def _spoken_start(view: str, start: int, end: int) -> int:
    """Where a local part starts whose last pieces, from start to end, are digits as words: `john four two` is john42.

    Two or more such words in a row belong together and to the name before them; a single one,
    as in `page four at`, stands for itself.
    """
    words, at = 0, end
    while m := _spoken.search(view, max(0, at - _widest - 1), at):
        words, start = words + 1, min(start, m.start())
        at = m.start()
        while at > 0 and at > m.start() - 3 and view[at - 1] in " -":
            at -= 1
        if at == m.start():
            break
    if words > 1 and (m := _name_before.search(view, max(0, start - 67), start)):
        start = _local_start(view, len(view[: m.end()].rstrip()))
    return start


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What only the normalised view shows, in source offsets, apart from spans inside a base span of the kind."""
    found: list[Span] = []
    view, kept = (text, None) if text.isascii() or _odd.isdisjoint(text) else _visible(text)
    plain = base
    if view is not text:
        found += (plain := base_spans(view))
    if _number_hint.search(view) or _spelled_hint.search(view):
        for m in _spelled.finditer(view):
            run, spans, spelled = _digits(m[0])
            if spelled or _disguised_dot.search(m[0]):
                hits = [(m.start() + spans[a][0], k, m.start() + spans[b - 1][1]) for a, k, b in base_spans(run) if k]
                found += [x for x in hits if not any(b[:2] == x[:2] and _last_word.fullmatch(view, b[2], x[2]) for b in plain)]
    for m in _at_hint.finditer(view):
        mark = m[0].strip()
        after = _after.match(view, m.end())
        if not after:
            continue
        start = _local_start(view, m.start())
        if start == m.start():
            continue
        if m[0] != "@":
            start = _spoken_start(view, start, m.start())
        dots = _any_dot.findall(after[0])
        if mark.isalpha() and (all(x == "." for x in dots) or _article.match(after[0])):
            continue  # "at example.com" and "at the dot" are prose, "at example dot com" is not
        if mark == "@" and m[0] == "@" and all(x == "." for x in dots + _any_dot.findall(view, start, m.start())):
            continue  # nothing disguised
        found.append((start, 0, after.end()))
    if kept is not None:
        found = [(kept[a], k, kept[b - 1] + 1) for a, k, b in found]
    new = {s for s in found if not any(b[1] == s[1] and b[0] <= s[0] and s[2] <= b[2] for b in base)}
    return sorted(new)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), n_added, base_spans, spans; a row per input row.

    Offsets are code points, ends exclusive. A null text counts as empty and has no spans;
    repeated rows give repeated results; only doc_id and text are read. One text is held at a
    time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts: list[list[int]] = [[] for _ in range(5)]
                based, every = [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    base = base_spans(text)
                    more = added_spans(text, base)
                    for k in range(4):
                        counts[k].append(sum(s[1] == k for s in base))
                    counts[4].append(len(more))
                    based.append(joined(base))
                    every.append(joined(sorted(base + more)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(based, pa.string()), pa.array(every, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "spans"],
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; overlapping spans are merged, the first kind kept."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(b) <= at:
            continue
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
        at = int(b)
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
