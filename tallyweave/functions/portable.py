"""Column functions that give the same values in Spark and in DuckDB."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def r6(c: Column) -> Column:
    """Rounded to six digits, half away from zero."""
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _accented() -> tuple[str, str]:
    """Lower-case letters that are one letter and accents, with that letter, and then all combining accents."""
    pairs = [(chr(c), plain(chr(c))) for c in (*range(0xC0, 0x250), *range(0x386, 0x460), *range(0x1E00, 0x2000)) if chr(c) == chr(c).lower()]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_FROM, _TO = _accented()


def fold_accents(text: Column) -> Column:
    """Lower case without accents: of Latin, Greek and Cyrillic letters, and combining ones."""
    return F.translate(F.lower(text), _FROM, _TO)
