"""Text expressions: strip, normalise, count words, find markers, fold accents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, and as part of a word.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
ASCII_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21))))
OTHER_SPACE = "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def strip(text: Column) -> Column:
    """Remove outer white space. ``text`` stands once in it, so nested uses stay small."""
    return F.btrim(text, F.lit(ASCII_SPACE + OTHER_SPACE))


def normalise_prompt(text: Column) -> Column:
    """Lower case, outer white space removed, inner white space as one blank."""
    blanks = F.translate(
        F.lower(text),
        ASCII_SPACE + OTHER_SPACE,
        " " * (len(ASCII_SPACE) + len(OTHER_SPACE)),
    )
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def contains_any(text: Column, tokens: Iterable[str]) -> Column:
    """True when any token occurs anywhere in ``text``, also inside a word."""
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(text, F.lit(token))
    return found


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks whose base is one character."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        char = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()

_HANGUL = range(0xAC00, 0xD7A4)
_VOWELS, _TAILS = 21, 28


def _ranges(codes: Iterable[int]) -> str:
    """The inside of a character class."""
    found: list[list[int]] = []
    for code in sorted(codes):
        if found and code == found[-1][1] + 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in found)


def _wide_tables() -> tuple[dict[str, str], dict[str, str], list[int]]:
    """Compatibility bases that ``ACCENTED`` lacks, of one and of more characters, and all marks."""
    single, several, marks = {}, {}, []
    known = set(ACCENTED)
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or code in _HANGUL or char in known:
            continue
        if unicodedata.combining(char):
            marks.append(code)
            continue
        parts = unicodedata.normalize("NFKD", char)
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if base != char:
            (single if len(base) == 1 else several)[char] = base
    return single, several, marks


_SINGLE, _SEVERAL, _MARKS = _wide_tables()
#: Few ranges that hold every character of the wide tables; plain Latin text has none of them.
_LOW = [c for c in (*map(ord, _SINGLE), *map(ord, _SEVERAL), *_MARKS) if c < 0x530]
_PERHAPS_WIDE = rf"[{_ranges(_LOW)}\x{{530}}-\x{{1dff}}\x{{2000}}-\x{{10ffff}}]"
_IS_SEVERAL = f"[{_ranges([*map(ord, _SEVERAL), *_HANGUL])}]"
_IS_MARK = f"[{_ranges(_MARKS)}]+"


def _syllable(char: Column) -> Column:
    """The letters of a Hangul syllable, by its number."""
    number = F.ascii(char) - _HANGUL.start
    letters = [
        F.array(*[F.lit(chr(0x1100 + i)) for i in range(len(_HANGUL) // (_VOWELS * _TAILS))]),
        F.array(*[F.lit(chr(0x1161 + i)) for i in range(_VOWELS)]),
        F.array(F.lit(""), *[F.lit(chr(0x11A8 + i)) for i in range(_TAILS - 1)]),
    ]
    places = [F.floor(number / (_VOWELS * _TAILS)), F.floor(number / _TAILS) % _VOWELS, number % _TAILS]
    whole = F.concat(*[F.get(a, i.cast("int")) for a, i in zip(letters, places, strict=True)])
    return F.when(number.between(0, len(_HANGUL) - 1), whole)


def _fold_wide(text: Column) -> Column:
    pairs = "\x02".join(f"{char}\x01{base}" for char, base in _SEVERAL.items())
    bases = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    text = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_IS_SEVERAL), F.lit(0)))
    text = F.aggregate(
        found, text, lambda whole, c: F.replace(whole, c, F.coalesce(F.try_element_at(bases, c), _syllable(c), c))
    )
    return F.regexp_replace(text, _IS_MARK, "")


def fold_accents(text: Column) -> Column:
    """Compatibility bases without marks, of all characters; ``text`` should be a plain column."""
    folded = F.translate(text, ACCENTED, PLAIN)
    return F.when(text.rlike(_PERHAPS_WIDE), _fold_wide(folded)).otherwise(folded)
