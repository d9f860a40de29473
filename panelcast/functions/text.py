"""String expressions: name normalisation (F35), case-insensitive search (P9),
note templates (P14)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.exprs import col


@lru_cache(maxsize=1)
def _accent_translation() -> tuple[str, str]:
    """(accented, plain) character strings for ``F.translate``.

    Built by rule from Unicode: every character, of any script, whose canonical
    decomposition without its combining marks (category ``Mn``) is one other character maps
    to that.  This is what NFD + dropping ``Mn`` does, expressed as a JVM-side translate;
    Hangul syllables and the few letters that decompose into several (as some Tamil
    vowels, with spacing marks) stay composed.
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x110000):
        ch = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or not unicodedata.decomposition(ch):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != ch:
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


def strip_accents(c: str | Column) -> Column:
    """Text without accents: composed letters become their base letters, and
    combining marks that stand alone, as in decomposed text, go."""
    src, dst = _accent_translation()
    return F.regexp_replace(F.translate(col(c), src, dst), r"\p{Mn}", "")


def normalized_name(c: str | Column) -> Column:
    """Accent-free, lower-case name without '.' and "'" and outer white space; NULL stays NULL."""
    x = strip_accents(col(c))
    x = F.lower(x)
    x = F.regexp_replace(x, r"[.']", "")
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def contains_ci(c: str | Column, needle: str, regex: bool = False) -> Column:
    """Case-insensitive containment; a NULL value is "not contained"."""
    x = col(c)
    if regex:
        cond = x.rlike("(?i)" + needle)
    else:
        cond = F.lower(x).contains(needle.lower())
    return F.coalesce(cond, F.lit(False))


def season_note(period: str | Column, years_away: str | Column) -> Column:
    """``Based on {period} season, {n}yr away``."""
    return F.format_string("Based on %d season, %dyr away", col(period).cast("int"), col(years_away).cast("int"))
