"""Text column expressions: markup removal, token cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.scalars import col

# fixed values: white space, as one regular-expression class
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
# fixed values: what is taken out of a page, in this order (pattern, replacement)
MARKUP = (
    (r"(?is)<head.*?>.*?</head>", ""),
    (r"(?is)<a\s.*?>", " HYPERLINK "),
    (r"(?s)<.*?>", ""),
    (SPACE + r"*\n", "\n"),
)
URL = r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>\"']+"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}*)?(?:[eE][+-]?\p{Nd}+)?"
NON_WORD = r"[^\p{L}\p{N}_]+"


def unescape(c) -> Column:
    """Decoded character entities; row by row, as texts may be long."""

    @F.udf("string", useArrow=False)
    def decode(s):
        import html

        return None if s is None else html.unescape(s)

    return decode(col(c))


def strip_markup(c) -> Column:
    out = col(c)
    for pattern, replacement in MARKUP:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def html_to_text(c) -> Column:
    """Plain text of a page: no head, links marked, tags dropped, entities decoded."""
    return unescape(strip_markup(c))


def clean_words(c, lower=True, urls=True, numbers=True, punctuation=True) -> Column:
    """Lower-cased text with URL and NUMBER marks and single separators."""
    out = F.coalesce(col(c), F.lit(""))
    if lower:
        out = F.lower(out)
    if urls:
        out = F.regexp_replace(out, URL, " URL ")
    if numbers:
        out = F.regexp_replace(out, NUMBER, "NUMBER")
    if punctuation:
        out = F.regexp_replace(out, NON_WORD, " ")
    return out


def words(c) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")
