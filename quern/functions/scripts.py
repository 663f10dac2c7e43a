"""Scripts of tokens by Unicode block, and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let

# First, last code point and name of each block, checked in order.
BLOCKS = [
    (0x0000, 0x024F, "Latin"), (0x0300, 0x036F, "Combining"), (0x0400, 0x04FF, "Cyrillic"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x1000, 0x109F, "Myanmar"), (0x3040, 0x30FF, "Kana"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
THREE_BYTES = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Myanmar", "Han", "Hangul", "Kana"]
TWO_BYTES = ["Arabic", "Cyrillic", "Syriac"]
INDIC = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala"]


def char_script(ch: Column) -> Column:
    point = F.ascii(ch)
    out = F.lit("Other")
    for lo, hi, name in reversed(BLOCKS):
        out = F.when((point >= lo) & (point <= hi), name).otherwise(out)
    return out


def token_script(token: Column) -> Column:
    """The script of over half of the letters and marks; Mixed without such, Symbol without letters. Punctuation, numbers,
    separators, control characters and combining marks don't count."""
    chars = F.filter(F.split(F.regexp_replace(token, r"[\p{P}\p{N}\p{Z}\p{C}▁]", ""), ""), lambda c: c != "")

    def dominant(scripts):
        most = F.filter(F.array_distinct(scripts), lambda n: F.size(F.filter(scripts, lambda s: s == n)) * 2 > F.size(scripts))
        return F.when(F.size(scripts) == 0, "Symbol").otherwise(F.coalesce(F.get(most, F.lit(0)), F.lit("Mixed")))

    return let(F.filter(F.transform(chars, char_script), lambda s: s != "Combining"), dominant)


def bytes_per_char(script: Column) -> Column:
    return F.when(script.isin(THREE_BYTES), 3).when(script.isin(TWO_BYTES), 2).otherwise(1)


def byte_prefix(token: Column, width: int) -> Column:
    """The first bytes of a token, as hex."""
    return F.hex(F.substring(F.encode(token, "UTF-8"), 1, width))
