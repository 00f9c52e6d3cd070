"""Unicode normal form and case folding.

Spark SQL has ``lower`` but neither NFC nor full case folding.  Almost every row
needs only ``lower``; the rows that need more are recognised by a character class
computed here from the Unicode database.  Those call the Unicode library that Spark itself
ships for its collations, so no row leaves the JVM.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

APOSTROPHES = "’ʼ"


def _needs_folding(char: str) -> bool:
    """True when lower() alone may differ from NFC + full case folding."""
    if char in APOSTROPHES or char == "ß":
        return False
    if unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
        return True
    if "ᅡ" <= char <= "ᇿ" or unicodedata.category(char).startswith("M"):
        return True
    return char.casefold() != char.lower() or len(char.lower()) > 1


@functools.lru_cache(maxsize=1)
def slow_path_pattern() -> str:
    """Java pattern that finds a code point that ``lower`` alone does not fold.

    Latin-1 is passed over first (its few special letters are handled natively), so the
    long class is tried only on the rare characters beyond it.
    """
    spans: list[list[int]] = []
    for point in range(0x100, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or not _needs_folding(chr(point)):
            continue
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    # Capital sigma lowers differently at the end of a word; fold it in full too.
    spans.append([0x3A3, 0x3A3])
    members = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in spans)
    # One plain range: as a negated class of a range and signs, Java takes ten times as long.
    return f"[\\x{{100}}-\\x{{10ffff}}](?<![{APOSTROPHES}])(?<=[{members}])"


def _fold(text: Column) -> Column:
    """NFC and full case folding of a text that is not null."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.translate(composed, APOSTROPHES, "''"), F.lit(True)
    )


def normalise(text: Column) -> Column:
    """NFC, typographic apostrophes to ``'``, full case folding; null becomes ''."""
    plain = text
    for sign, own in (*((a, "'") for a in APOSTROPHES), ("µ", "μ")):
        plain = F.replace(plain, F.lit(sign), F.lit(own))
    plain = F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))
    # Counting bytes and characters is quicker than a search; most lines are plain ASCII.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(text.isNull(), F.lit("")).when(ascii_only, F.lower(text)).when(text.rlike(slow_path_pattern()), _fold(text)).otherwise(plain)
