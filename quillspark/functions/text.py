"""Column functions on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by decomposition; Đ is added as it has none."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accent_table()
_MARKS = r"[̀-ͯ]"


def fold_accents(text: Column) -> Column:
    """Letters without accents, case kept; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), _MARKS, "")


def normalize_space(text: Column) -> Column:
    """Every run of white space, also of non-breaking spaces, as one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def name_words(text: Column) -> Column:
    """Lower-case ASCII words, other signs as one space."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), r"[^a-z0-9]+", " "))
