"""String expressions: trimming, card masking, keyword tests, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of a text value.
WHITESPACE = " \t\n\r\f\u000b\u0085\u00a0\u1680\u2003\u2009\u202f\u3000"

# Display symbol of each known currency code.
CURRENCY_SYMBOLS = {
    "USD": "$",
    "GBP": "£",
    "EUR": "€",
    "INR": "₹",
    "CAD": "CA$",
    "AUD": "A$",
}

# A card number is three groups of four digits and zero to four more, each
# boundary holding at most one space or hyphen. Every alternative fixes the
# length of the tail, so that the last four digits fall into capture groups;
# groups that take no part are empty. (?U) makes \b, \d and \s follow Unicode.
CARD_NUMBER = (
    r"(?U)\b\d{4}[\s\-]?\d{4}[\s\-]?(?:"
    r"\d{4}[\s\-]?(\d{4})"
    r"|\d{3}(\d)[\s\-]?(\d{3})"
    r"|\d{2}(\d{2})[\s\-]?(\d{2})"
    r"|\d(\d{3})[\s\-]?(\d)"
    r"|(\d{4})[\s\-]?"
    r")\b"
)
_LAST_FOUR = "****$1$2$3$4$5$6$7$8"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def mask_cards(text: Column) -> Column:
    """Replace card numbers of 12 to 16 digits by ``****`` and the last four."""
    return F.regexp_replace(text, F.lit(CARD_NUMBER), F.lit(_LAST_FOUR))


def has_keyword(text: Column, keyword: str | Column) -> Column:
    """Case-insensitive literal containment; a null text has no keyword."""
    needle = F.lit(keyword.lower()) if isinstance(keyword, str) else F.lower(keyword)
    return F.coalesce(F.contains(F.lower(text), needle), F.lit(False))


def short_name(text: Column, width: int = 40) -> Column:
    return F.substring(text, 1, width)


def currency_label(code: Column) -> Column:
    """Symbol of a known code, else the upper-cased code and a blank."""
    pairs = [F.lit(x) for item in CURRENCY_SYMBOLS.items() for x in item]
    upper = F.upper(code)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper), F.concat(upper, F.lit(" ")))


def axis_label(codes: Column) -> Column:
    """Label for an array of codes: its symbol, or ``Mixed currencies``."""
    return (
        F.when(F.size(codes) > 1, F.lit("Mixed currencies"))
        .when(F.size(codes) == 1, currency_label(F.try_element_at(codes, F.lit(1))))
        .otherwise(F.lit("$"))
    )
