"""Personal data: detectors over each text and over its deobfuscated form, whose spans map back to the source."""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import BETWEEN, arrow_map, passes, prefix_sums, span_hashes, words

KINDS = ("email", "ip", "card", "phone")
#: An address is a run of _LOCAL characters, an @ and a _HOST: looked for from each @, so that time is linear.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: All starts in one run of digits end alike, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones, and number words.
HOMOGLYPHS = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵ‐‑‒–﹣－．。｡＠﹫＋（）",
    "ABEKMHOPCTXaeopcyxijsdgABEZHIKMNOPTYXov------...@@+()",
)
HOMOGLYPHS |= {0xFF10 + i: str(i) for i in range(10)}
HOMOGLYPHS |= {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
HOMOGLYPHS |= {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)}
ZERO_WIDTH = "​‌‍⁠﻿­"
DIGIT_WORDS = {
    **{w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}, "oh": "0",
    **{w: str(i) for i, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(i) for i, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(i) for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: So many words for digits, and digits in all, make a spelled number: less is prose.
SPELLED, LEAST_DIGITS = 3, 7
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_WORDS}|[0-9]+)[\x20.,-]{{1,3}}){{{SPELLED},}}(?:{_WORDS}|[0-9]+)(?![^\W_])", re.IGNORECASE)
_PART = re.compile(rf"{_WORDS}|[0-9]+", re.IGNORECASE)
_PLUS = re.compile(r"\bplus[\x20-]+(?=\+?[0-9])", re.IGNORECASE)
_AT = re.compile(r"(?:(?<!\x20)\x20++)?(?:(?:&#0*64;|&commat;)\x20*|[\[({<]\x20*(?:at|@|arroba|chez)\x20*[\])}>]\x20*)", re.IGNORECASE)
_DOT = re.compile(r"(?:(?<!\x20)\x20++)?(?:&#0*46;\x20*|[\[({<]\x20*(?:dot|\.|punkt|point|punto)\x20*[\])}>]\x20*)", re.IGNORECASE)
_SPOKEN = re.compile(r"(?<=[A-Za-z0-9_])\x20(?:at|AT|arroba)\x20(?=[A-Za-z0-9-]+(?:\x20(?:dot|DOT|punkt|punto)\x20[A-Za-z0-9-]+)+\b)")
_SPOKEN_DOT = re.compile(r"\x20(?:dot|DOT|punkt|punto)\x20(?=[A-Za-z0-9-])")
_SPACED = re.compile(r"(?<=[A-Za-z0-9_])\x20{0,2}@\x20{0,2}(?=[A-Za-z0-9-]+(?:\x20{1,2}\.\x20{0,2}|\.)[A-Za-z]{2,}\b)")
_SPACED_HOST = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:\x20{1,2}\.\x20{0,2}[A-Za-z0-9-]+)+")
_BRACKETED = re.compile(r"&#0*64;|&commat;|[\[({<]\x20*(?:at|@|dot|arroba|chez|punkt|point|punto|\.)\x20*[\])}>]", re.IGNORECASE)
_DOTTED = (" dot ", " DOT ", " punkt ", " punto ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the leftmost, non-overlapping addresses."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base match."""
    out: list[tuple[int, int, int]] = []
    out += [(a, 0, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    if text.count(".") >= 3:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(out)


class Rewriting:
    """A text being rewritten, with the source start and end of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.changed = text, False
        self.start, self.end = np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32)

    def apply(self, pattern: re.Pattern, to) -> None:
        """Replace each match by ``to(match)`` (None: leave it); all its characters stand for the whole match."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            a, b = m.span()
            parts += [self.text[at:a], new]
            start += [self.start[at:a], np.repeat(self.start[a], len(new))]
            end += [self.end[at:a], np.repeat(self.end[b - 1], len(new))]
            at = b
        if parts:
            self.text, self.changed = "".join(parts) + self.text[at:], True
            self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])


_HIDDEN = re.compile(f"[{ZERO_WIDTH}]")
_ALIKE = re.compile("[" + re.escape("".join(map(chr, HOMOGLYPHS))) + ZERO_WIDTH + "]")


def _number_word_hashes() -> np.ndarray:
    data = [w.encode() for w in {x for w in DIGIT_WORDS for x in (w, "".join(c if c.isascii() else c.upper() for c in w))}]  # A-Z hash as a-z
    ends = np.cumsum([len(w) for w in data])
    return np.unique(span_hashes(prefix_sums(np.frombuffer(b"".join(data), dtype=np.uint8)), ends - [len(w) for w in data], ends))


def _digits_of(m: re.Match) -> str | None:
    parts = _PART.findall(m.group())
    digits = "".join(DIGIT_WORDS.get(p.lower(), p) for p in parts)
    return digits if sum(not p.isdigit() for p in parts) >= SPELLED and len(digits) >= LEAST_DIGITS else None


def spelled_out(column: pa.Array) -> np.ndarray:
    """Of each text: whether it may hold a spelled number, that is four tokens or more in a row that are digits or their
    names, three of them names. A token with a character that isn't printable ASCII, as a quotation mark, may hold a
    name at either end of such a row. Whatever _SPELLED and _digits_of accept has such a row, look-alikes aside."""
    out, names = np.zeros(len(column), dtype=bool), _number_word_hashes()
    for a, b, data, offsets in passes(column):
        starts, ends, bounds = words(data, offsets, BETWEEN)
        name = np.isin(span_hashes(prefix_sums(data), starts, ends), names)
        if not name.any():
            continue
        strange = np.concatenate([[0], np.cumsum((data < 32) | (data > 126))])
        edge = strange[ends] > strange[starts]
        fits = name | ((data[starts] >= 48) & (data[starts] <= 57))
        new = np.zeros(len(starts) + 1, dtype=bool)  # a text's first token
        new[bounds[:-1]] = True
        first = np.flatnonzero(fits & (new[:-1] | ~np.concatenate([[False], fits[:-1]])))
        last = np.flatnonzero(fits & (new[1:] | ~np.concatenate([fits[1:], [False]]))) + 1
        named = np.concatenate([[0], np.cumsum(name)])
        beside = (edge[first - 1] & ~new[first] & (first > 0)).astype(int) + (np.append(edge, False)[last] & ~new[last])
        rows = (last - first + beside > SPELLED) & (named[last] - named[first] + beside >= SPELLED)
        out[a + np.searchsorted(bounds, first[rows], "right") - 1] = True
    return out


def deobfuscated(text: str, spelled: bool = True) -> Rewriting | None:
    """The text after the transducers, or None if none of them applies; ``spelled`` says whether it may hold spelled numbers."""
    alike = not text.isascii() and _ALIKE.search(text)
    spaced = " @" in text or "@ " in text
    plus = "plus" in text.lower() and _PLUS.search(text)
    if not alike and not spelled and not spaced and not plus and not any(x in text for x in _DOTTED) and not _BRACKETED.search(text):
        return None
    r = Rewriting(text)
    if alike:
        flat = r.text.translate(HOMOGLYPHS)  # one character for one
        r.changed, r.text = flat != text, flat
        r.apply(_HIDDEN, lambda m: "")
    if spelled or alike:
        r.apply(_SPELLED, _digits_of)
    r.apply(_PLUS, lambda m: "+")
    r.apply(_AT, lambda m: "@")
    r.apply(_DOT, lambda m: ".")
    r.apply(_SPOKEN, lambda m: "@")
    if spaced:
        r.apply(_SPACED, lambda m: "@")
        r.apply(_SPACED_HOST, lambda m: m.group().replace(" ", ""))
    if "@" in r.text and _SPOKEN_DOT.search(r.text):
        host = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:\x20(?:dot|DOT|punkt|punto)\x20[A-Za-z0-9-]+)+")
        r.apply(host, lambda m: _SPOKEN_DOT.sub(".", m.group()))
    return r if r.changed else None


def all_spans(text: str, spelled: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and further spans), each by start and then kind; a further span overlaps none of its kind."""
    base = detect(text)
    r = deobfuscated(text, spelled)
    if r is None:
        return base, base
    further = []
    of_kind = [[x for x in base if x[1] == k] for k in range(len(KINDS))]  # in order, and none overlaps another
    for a, k, b in detect(r.text):
        span = (int(r.start[a:b].min()), k, int(r.end[a:b].max()))
        i = bisect.bisect_left(of_kind[k], (span[2],))
        if not i or of_kind[k][i - 1][2] <= span[0]:
            further.append(span)
    return base, sorted({*base, *further})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Base matches are leftmost and non-overlapping per kind. Transducers then undo homoglyphs, zero-width characters,
    spelled digits (at least seven digits in a row, three of them words of four languages), and at/dot disguises, keeping each character's source
    span; what the same detectors find in the result is mapped back, and added where no base span of its kind overlaps.
    A rewritten base match is thus counted once, as it stands in the text. Positions are code points, end exclusive.

    A null text is an empty one. Every row is kept, whatever its id; nothing is shuffled. Other columns are ignored.
    An empty table gives no rows.
    """

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, sha, spans = [[], [], [], []], [], []
        for t, spelled in zip(batch.column(1).to_pylist(), spelled_out(batch.column(1)).tolist(), strict=True):
            base, whole = all_spans(t or "", spelled)
            for k in range(4):
                n[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(whole))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(spans, pa.string())], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return arrow_map(rows, f, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
