"""Lists of strings as Python and JSON write them, read by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of one letter, in Python's notation.
SIMPLE_ESCAPES = {
    "\\": "\\", "'": "'", '"': '"', "a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b",
    "\n": "",
}

# Repetitions never give anything back, so lists of any length are matched without recursion.
_STRING = r"""(?:'(?:[^'\\\n]++|\\[\s\S])*+'|"(?:[^"\\\n]++|\\[\s\S])*+")"""
_LIST = rf"\A\s*+\[\s*+(?:{_STRING}\s*+(?:,\s*+{_STRING}\s*+)*+(?:,\s*+)?)?\]\s*+\z"
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_PIECE = (
    rf"[^\\]++|{_PAIR}|\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}|\\U[0-9a-fA-F]{{8}}|\\[0-7]{{1,3}}|\\[\s\S]"
)


def _letter(code: Column) -> Column:
    """The character of a code point in hexadecimal; nothing for what is no character."""
    number = F.conv(code, 16, 10).cast("long")
    real = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))


def _unescaped(piece: Column) -> Column:
    """What a piece of a string literal stands for; NULL where that is no text."""
    sign = F.substring(piece, 2, 1)
    high, low = (F.conv(F.substring(piece, at, 4), 16, 10).cast("long") for at in (3, 9))
    both = F.hex((high - 0xD800) * 1024 + (low - 0xDC00) + 0x10000)
    found = F.when(~F.startswith(piece, F.lit("\\")), piece)
    for name, letter in SIMPLE_ESCAPES.items():
        found = found.when(piece == "\\" + name, F.lit(letter))
    return (
        found.when(F.length(piece) == 12, _letter(both))
        .when(sign.isin("x", "u", "U") & (F.length(piece) > 2), _letter(F.substring(piece, 3, 8)))
        .when(sign.between("0", "7"), _letter(F.conv(F.substring(piece, 2, 3), 8, 16)))
        # Escapes cut short, and characters by their names.
        .when(sign.isin("x", "u", "U", "N"), F.lit(None))
        # A backslash that escapes nothing stays.
        .otherwise(piece)
    )


def string_list(text: Column) -> Column:
    """The list of strings that ``text`` writes, or NULL where it is none.

    Strings stand in single or double quotes. Escapes are Python's; of JSON's own,
    the two halves of a character beyond 16 bits are put together. ``\\N{..}`` and lone halves are no text.
    """
    strings = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    inner = F.transform(strings, lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    pieces = F.transform(inner, lambda s: F.transform(F.regexp_extract_all(s, F.lit(_PIECE), F.lit(0)), _unescaped))
    readable = F.forall(pieces, lambda p: F.forall(p, lambda x: x.isNotNull()))
    joined = F.transform(pieces, lambda p: F.array_join(p, ""))
    return F.when(F.rlike(text, F.lit(_LIST)), F.when(readable, joined))
