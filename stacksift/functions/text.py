"""Text functions that built-in expressions can't spell, as Arrow-batched UDFs over plain Python ones."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

LIMIT = 24
CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W_]+")
#: Letters that decomposition leaves whole.
WHOLE = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "ё": "е"})


def fold(text: str) -> str:
    """Compatibility forms, lower case, no accents."""
    flat = unicodedata.normalize("NFKD", text.replace("'", "").replace("’", "").lower().translate(WHOLE))
    return unicodedata.normalize("NFC", "".join(c for c in flat if not unicodedata.combining(c) or "゙" <= c <= "゚"))


def tokens(text: str) -> list[str]:
    """Folded words cut at 24 letters; runs of Chinese and kana as overlapping pairs."""
    out: list[str] = []
    for word in WORD.findall(fold(text)):
        if CJK.fullmatch(word):
            out += [word] if len(word) == 1 else [word[i : i + 2] for i in range(len(word) - 1)]
        else:
            out += [word[i : i + LIMIT] for i in range(0, len(word), LIMIT)]
    return out


def osa(a: str, b: str, limit: int = 2) -> int:
    """Edits and swaps of neighbours between two words; limit + 1 when there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows = [rows[-1], row]
        if min(row) > limit:
            return limit + 1
    return min(rows[-1][-1], limit + 1)


def repaired(text: str) -> str:
    """Text that was read as Windows-1252 but is UTF-8."""
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text


def isbn13(text: str) -> str | None:
    """Thirteen digits of a valid ISBN of either length."""
    digits = re.sub(r"[^0-9Xx]", "", text)
    if len(digits) == 10 and digits[:9].isdigit():
        check = sum((10 - i) * (10 if c in "Xx" else int(c)) for i, c in enumerate(digits))
        if check % 11:
            return None
        digits = "978" + digits[:9]
        return digits + str(-sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(digits)) % 10)
    if len(digits) == 13 and digits.isdigit() and digits[:3] in ("978", "979"):
        return digits if sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(digits)) % 10 == 0 else None
    return None


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def abbreviates(word: str, behind: str) -> bool:
    """Whether a stop behind a word belongs to the word: short words without a vowel (Mr, Dr, vs), single letters, and words that
    a figure or a small letter follows."""
    short = len(word) <= 4 and not re.search(r"[aeiouyà-ÿ]", word.lower())
    return short or len(word) == 1 or bool(re.match(r"[\da-zß-ÿ]", behind))


def sentences(text: str) -> list[tuple[int, str]]:
    """Sentences with their offsets; a stop that belongs to its word doesn't end one."""
    out, start = [], 0
    for m in re.finditer(r"[.!?…]+[\"'»”)]*\s+", text):
        word = re.search(r"(\w+)\.$", text[start : m.end()].rstrip())
        if word and abbreviates(word[1], text[m.end() : m.end() + 1]):
            continue
        out.append((start, text[start : m.end()].strip()))
        start = m.end()
    if text[start:].strip():
        out.append((start, text[start:].strip()))
    return out


def dialogue(text: str) -> list[tuple[int, str, str]]:
    """Narration and speech in turn, with offsets."""
    out, at = [], 0
    for m in re.finditer(r"[\"“«]([^\"”»]*)[\"”»]", text):
        if text[at : m.start()].strip():
            out.append((at, "narration", text[at : m.start()].strip()))
        words = m[1].split()
        out.append((m.start(), "scare" if len(words) <= 2 and not re.search(r"[,.!?]$", m[1]) else "speech", m[1]))
        at = m.end()
    if text[at:].strip():
        out.append((at, "narration", text[at:].strip()))
    return out


def bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pairs merged by rank, the least first."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def udf(f, kind: str):
    """An Arrow-batched UDF of a function of one text; null stays null."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else f(x))

    return run


def osa_distance(a, b):
    """Edits and swaps of neighbours between two columns of words, 3 for more than two."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)
