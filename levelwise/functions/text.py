"""Text expressions. All of them are built-in, whole-text and JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's ``str.isspace`` accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Preview length and marker.
PREVIEW_CHARS = 100
PREVIEW_MARK = "..."

# Letters, marks and digits of every script make words.
WORD = r"[\pL\pM\pN]+"
MARK = r"\pM+"


def clean_text(text: Column | str) -> Column:
    """Strip leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(_col(text).cast("string"), F.lit(WHITESPACE))


def is_blank(text: Column | str) -> Column:
    """True for NULL, empty and whitespace-only text; never NULL."""
    return F.coalesce(clean_text(text) == "", F.lit(True))


def null_as_text(text: Column | str) -> Column:
    """NULL -> the word ``nan``, for parity with a plain string cast."""
    return F.coalesce(_col(text).cast("string"), F.lit("nan"))


def text_preview(text: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    """First ``chars`` characters plus a marker; shorter text is unchanged."""
    text = _col(text)
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(PREVIEW_MARK))
    ).otherwise(text)


def words(text: Column | str, fold: bool = False) -> Column:
    """Lower-cased words of the whole text, in order; ``fold`` takes accents off Latin letters."""
    lowered = F.lower(_col(text))
    return F.regexp_extract_all(fold_accents(lowered) if fold else lowered, F.lit(WORD), 0)


def fold_accents(text: Column | str) -> Column:
    """Latin letters without their accents, composed or not; other scripts keep their letters."""
    accented, plain = _accents()
    return F.regexp_replace(F.translate(_col(text), accented, plain), MARK, "")


def _accents() -> tuple[str, str]:
    """Accented Latin letters that decompose into an ASCII letter, and those letters."""
    latin = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in latin]
    pairs = [(c, base) for c, base in pairs if c != base and base.isascii()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text
