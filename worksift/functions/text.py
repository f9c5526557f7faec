"""Text rules as column expressions; one small Python function for Unicode folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from worksift.config import COMMON_TOKENS

# Characters on which lower-casing alone equals compatibility normalisation followed by case
# folding: ASCII, plus the Latin-1 capitals and small letters without the sharp s.
_PLAIN = r"^[\x00-\x7FÀ-Þà-ÿ]*$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Tabs to spaces, trimmed, runs of white space to one space, empty to null."""
    spaced = F.replace(c, F.lit("\t"), F.lit(" "))
    # Patterns are slow: ASCII text, which is most of it, is trimmed by bytes, and few texts hold a run.
    plain = F.octet_length(spaced) == F.length(spaced)
    tidy = F.when(plain, F.btrim(spaced, F.lit("\n\x0b\f\r "))).otherwise(stripped(spaced))
    runs = ~plain | F.contains(F.translate(tidy, "\n\x0b\f\r", "    "), F.lit("  "))
    return F.nullif(F.when(runs, F.regexp_replace(tidy, r"(?U)\s{2,}", " ")).otherwise(tidy), F.lit(""))


def activity_strip(c: Column) -> Column:
    """The activity behind a ``WS/ MP620/2024-2025/133166-`` reference; bare text passes."""
    return clean_text(F.regexp_replace(F.trim(c), r"(?s)^WS/\s*MP\d+/\d{4}-\d{4}/\d+-(?=.)", ""))


def _folded(text: str | None) -> str | None:
    return unicodedata.normalize("NFKC", text).casefold() if text is not None else None


# Row by row, a hundred to a message: an Arrow batch would hold ten thousand whole texts in Python at a time.
_fold = F.udf(_folded, StringType(), useArrow=False)


def canonical_text(c: Column) -> Column:
    """Compatibility-normalised, case-folded, every run of characters other than letters,
    digits and marks to one space. Only rows that need real folding carry text to Python."""
    plain = F.coalesce(c.rlike(_PLAIN), F.lit(True))
    folded = F.when(plain, F.lower(c)).otherwise(_fold(F.when(~plain, c)))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}]+", " "))


def text_fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def content_tokens(canonical: Column, common: Sequence[str] = COMMON_TOKENS) -> Column:
    """Distinct canonical words outside the common list, sorted; an empty text has none."""
    words = F.filter(F.split(canonical, " "), lambda w: w != "")
    if common:
        words = F.array_except(words, F.array(*[F.lit(w) for w in common]))
    return F.array_sort(F.array_distinct(words))


def percent_encode(c: Column) -> Column:
    """URL quoting with no safe characters beyond letters, digits and ``_.-~``."""
    quoted = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted


def slug(label: Column) -> Column:
    """Lower case, other runs to one underscore; a label with no ASCII letters or digits is
    percent encoded, and a blank or pure-punctuation one is an error."""
    # White space at the ends becomes underscores, which go; only other alphabets need it stripped first.
    folded = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), F.lit("_"))
    trimmed = stripped(label)
    return (
        F.when(label.isNull(), None)
        .when(folded != "", folded)
        .when(trimmed.rlike(r"[^\x00-\x7F]"), percent_encode(trimmed))
        .otherwise(F.raise_error(F.concat(F.lit("no stable id for label: "), label)))
    )
