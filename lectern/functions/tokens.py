"""Index terms: runs of letters and digits, folded; marks belong to the term they stand in, and are dropped.

Folding is simple case folding; a letter that is one of a-z with one mark loses the mark, composed or not. Letters of other
scripts keep their composed marks, and so do letters with two.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The combining marks that a term drops; all others part terms.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
_LETTER = r"\p{L}\p{N}\p{Co}"


def _plain(ch: str) -> str:
    folded = ch.casefold()
    folded = folded if len(folded) == 1 else ch.lower()
    parts = unicodedata.normalize("NFD", folded)
    return parts[0] if len(parts) == 2 and parts[0] in "abcdefghijklmnopqrstuvwxyz" else folded


def _table() -> dict[str, str]:
    """What lower-casing alone leaves different from its folded form, over the letters of the basic plane."""
    lower = {ch.lower() for ch in map(chr, range(0x80, 0xD800)) if ch.isalpha()}
    return {ch: _plain(ch) for ch in sorted(lower) if len(ch) == 1 and len(_plain(ch)) == 1 and _plain(ch) != ch}


def fold(text: Column) -> Column:
    plain = _table()
    return F.translate(F.lower(text), "".join(plain), "".join(plain.values()))


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included; none of a null text."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"[{_LETTER}][{_LETTER}{MARKS}]*"), F.lit(0))
    return F.transform(found, lambda t: F.translate(t, MARKS, ""))
