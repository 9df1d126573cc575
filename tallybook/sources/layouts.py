"""Bank layouts: how to recognise an export by its header and normalise it.

To add a bank, build a ``Layout`` and pass it to ``register_layout``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.parse import DAY_FIRST, bare_side, day_text, or_fail, read_any_day, read_side
from tallybook.functions.text import strip
from tallybook.schema import DEFAULT_CURRENCY, MONEY, named
from tallybook.sources.columns import strip_names

# Currency codes that a header may name, the columns of an HDFC
# statement that make up a transaction, and those it is recognised by.
_CURRENCY_HEADER = re.compile(r"(gbp|usd|eur|inr|cad|aud)\s+amount", re.IGNORECASE)
_HDFC_COLUMNS = ("Date", "Narration", "Chq./Ref.No.", "Withdrawal Amt.", "Deposit Amt.", "Description", "Amount", "Currency")
_HDFC_MARKS = frozenset({"Narration", "Withdrawal Amt.", "Deposit Amt."})
LINEAGE = "source_file"
RAW_DATE, RAW_AMOUNT = "_raw_date", "_raw_amount"


@dataclass(frozen=True)
class Options:
    """Choices that a layout's normaliser may need."""

    currency: str | None = None
    date_formats: tuple[str, ...] | None = None
    pivot_year: int | None = None
    strict: bool = True
    dtype: str = MONEY


@dataclass(frozen=True)
class Layout:
    name: str
    fingerprint: frozenset[str]
    normalise: Callable[[DataFrame, Options], DataFrame]

    def fits(self, columns: Iterable[str]) -> bool:
        return self.fingerprint <= {c.strip() for c in columns}


def infer_currency(columns: Iterable[str], override: str | None = None) -> str:
    """Override, else the code in a header such as ``GBP Amount``, else USD."""
    if override:
        return override.upper()
    for name in columns:
        found = _CURRENCY_HEADER.fullmatch(name.strip())
        if found:
            return found.group(1).upper()
    return DEFAULT_CURRENCY


def fill_currency(df: DataFrame, default: str = DEFAULT_CURRENCY) -> DataFrame:
    """Add ``Currency``, or fill only its missing values."""
    if "Currency" in df.columns:
        return df.withColumn("Currency", F.coalesce(F.col("Currency"), F.lit(default)))
    return df.withColumn("Currency", F.lit(default))


def _generic(df: DataFrame, options: Options) -> DataFrame:
    if options.currency:
        return df.withColumn("Currency", F.lit(options.currency.upper()))
    return fill_currency(df, infer_currency(df.columns))


def _hdfc(df: DataFrame, options: Options) -> DataFrame:
    df = strip_names(df)
    paid_in, paid_out = F.col("`Deposit Amt.`"), F.col("`Withdrawal Amt.`")
    # Cleaned texts are columns of their own, so each is worked out once a row.
    texts = {"_day": day_text(F.col("Date")), "_in": bare_side(paid_in), "_out": bare_side(paid_out), "_told": strip(F.col("Narration"))}
    if "Chq./Ref.No." in df.columns:
        texts["_ref"] = strip(F.col("`Chq./Ref.No.`"))
    others = [c for c in df.columns if c not in _HDFC_COLUMNS and c != LINEAGE]
    df = df.withColumns(texts)
    description = F.col("_told")
    if "_ref" in texts:
        ref = F.col("_ref")
        usable = F.when((F.length(ref) > 0) & (F.lower(ref) != "nan"), ref)
        description = F.concat_ws(" | Ref: ", description, usable)
    money = options.dtype
    credit, debit = read_side(F.col("_in"), money), read_side(F.col("_out"), money)
    day = read_any_day(F.col("_day"), options.date_formats or DAY_FIRST, options.pivot_year)
    if options.strict:
        credit = or_fail(credit, paid_in, "deposit", nullable=False)
        debit = or_fail(debit, paid_out, "withdrawal", nullable=False)
        day = or_fail(day, F.col("Date"), "date", nullable=False)
    keep = [F.col(LINEAGE)] if LINEAGE in df.columns else []
    if not options.strict:
        keep += [
            F.col("Date").alias(RAW_DATE),
            F.concat_ws(" / ", paid_in, paid_out).alias(RAW_AMOUNT),
        ]
    return df.select(
        day.alias("Date"),
        description.alias("Description"),
        (credit - debit).cast(money).alias("Amount"),
        F.lit((options.currency or "INR").upper()).alias("Currency"),
        *keep,
        *[named(c) for c in others],
    )


GENERIC = Layout("Generic", frozenset(), _generic)
_LAYOUTS: dict[str, Layout] = {
    "hdfc": Layout("HDFC", _HDFC_MARKS, _hdfc),
}


def register_layout(key: str, layout: Layout) -> None:
    """Add a bank; layouts are tried in the order they were added."""
    _LAYOUTS[key.strip().lower()] = layout


def detect_layout(columns: Iterable[str], hint: str | None = None) -> Layout:
    """The hinted layout, else the first whose fingerprint fits, else generic."""
    if hint is not None:
        try:
            return _LAYOUTS[hint.strip().lower()]
        except KeyError:
            known = ", ".join(sorted(_LAYOUTS))
            raise ValueError(f"No layout goes by the name {hint!r}; there are {known}.") from None
    columns = list(columns)
    return next((x for x in _LAYOUTS.values() if x.fits(columns)), GENERIC)
