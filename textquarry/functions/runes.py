"""Classes, lower case and Latin normalisation of single characters, as lookup arrays.

Normalisation goes by Unicode names: a Latin letter with at most one mark, or turned, reversed and the like,
stands for the plain letter its name gives; full-width forms stand for their ASCII characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

WHITE, NON_WORD, DELIMITER, LOWER, UPPER, LETTER, NUMBER = range(7)
LIMIT = 0x110000
NAME = re.compile(r"(?:COMBINING |SUPERSCRIPT )?LATIN (?:SUBSCRIPT )?(SMALL LETTER|CAPITAL LETTER|LETTER SMALL CAPITAL) (?:[A-Z]{2,} )*([A-Z])(?: WITH (?!.* AND ).*)?")
NAMED = (range(0xC0, 0x2B0), range(0x363, 0x370), range(0x1D00, 0x1D66), range(0x1E00, 0x1EFA), (0x2071,), range(0x2095, 0x209D), (0x2184,))
UNNAMED = {"ß": "s", "ɑ": "a", "｡": "."}


def simple_lower(c: str) -> str:
    return c if len(c) != 1 else c.lower()[:1]


def lower_text(text: str) -> str:
    return "".join(map(simple_lower, text))


@lru_cache(maxsize=1)
def plain_letters() -> dict[str, str]:
    """Marked or unusual Latin letter -> plain one; capitals beyond Latin-1 that only pair with the next letter stay."""
    out = dict(UNNAMED)
    for code in (c for r in NAMED for c in r):
        char = chr(code)
        known = NAME.fullmatch(unicodedata.name(char, ""))
        if not known:
            continue
        kind, letter = known.groups()
        paired = kind == "CAPITAL LETTER" and 0x100 <= code < 0x23A and char.lower() == chr(code + 1)
        if not paired and not (kind == "CAPITAL LETTER" and code >= 0x1E00):
            out[char] = letter.lower() if kind == "SMALL LETTER" else letter
    return out | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


def plain_text(text: str) -> str:
    return text.translate(str.maketrans(plain_letters()))


def class_of(char: str, delimiters: str) -> int:
    if char in delimiters:
        return DELIMITER
    kind = unicodedata.category(char)
    if char in "\t\n\v\f\r\x85" or kind in ("Zs", "Zl", "Zp"):
        return WHITE
    return {"Ll": LOWER, "Lu": UPPER}.get(kind) or {"L": LETTER, "N": NUMBER}.get(kind[0], NON_WORD)


@lru_cache(maxsize=8)
def class_table(delimiters: str, size: int) -> np.ndarray:
    return np.fromiter((class_of(chr(c), delimiters) for c in range(size)), np.int8, size)


@lru_cache(maxsize=4)
def lower_table(size: int) -> np.ndarray:
    return np.fromiter((ord(simple_lower(chr(c))) for c in range(size)), np.uint32, size)


@lru_cache(maxsize=4)
def plain_table(size: int) -> np.ndarray:
    table = np.arange(size, dtype=np.uint32)
    for char, plain in plain_letters().items():
        if ord(char) < size:
            table[ord(char)] = ord(plain)
    return table
