"""Dates: strict canonical ISO check and unambiguous value normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.money import is_plain_decimal
from docaudit.functions.text import py_strip

ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def is_canonical_date(s: Column) -> Column:
    """A real calendar date written exactly as YYYY-MM-DD, year 0001..9999.

    The cast alone accepts ``2026-8-03``, padding and year 0000, so a regex
    guard and a year test come first.
    """
    return (
        s.rlike(ISO_DATE)
        & (F.substring(s, 1, 4) != F.lit("0000"))
        & s.try_cast("date").isNotNull()
    )


def parse_date(s: Column) -> Column:
    """Date of a canonical string, else null."""
    return F.when(is_canonical_date(s), s.try_cast("date"))


#: Month names; a word is a month when it is a name or its first three letters or more.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_of(word: Column) -> Column:
    """Number of a month's name or of its beginning (three letters at least), in any case; else null."""
    low, found = F.lower(word), None
    for number, name in enumerate(MONTHS, 1):
        cond = (F.length(low) >= 3) & F.lit(name).startswith(low)
        found = F.when(cond, number) if found is None else found.when(cond, number)
    return found


_SLASH = r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
_FORMS = (  # pattern, and the places of year, month and day in it
    (r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z", 1, 2, 3),
    (r"\A([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})\z", 1, 2, 3),
    (r"\A([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\z", 3, 2, 1),
)
_WORD_FORMS = ((r"\A([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})\z", 3, 2, 1), (r"\A([A-Za-z]+) ([0-9]{1,2}), ([0-9]{4})\z", 3, 1, 2))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD of texts or numbers if that is a real date, else null."""
    text = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(is_canonical_date(text), text)


def _spaced(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _slash_parts(t: Column) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(t, _SLASH, k).try_cast("int") for k in (1, 2, 3))


def day_order(s: Column) -> Column:
    """What a printed date proves of its source's slash dates: ``day`` first, ``month`` first, or null."""
    a, b, _ = _slash_parts(_spaced(s))
    return F.when((a > 12) & (b <= 12), "day").when((b > 12) & (a <= 12), "month")


def normalize_date(s: Column, order: Column | None = None) -> Column:
    """Normalise a printed date to YYYY-MM-DD when unambiguous, else null.

    Forms: ``2026-08-12``, ``2026/08/10``, ``09.08.2026`` (day first),
    ``12 Aug 2026``, ``12 August 2026``, ``AUG 11, 2026``, ``August 13, 2026``,
    and slash dates ``A/B/YYYY`` when one part exceeds 12, both are equal, or
    ``order`` says which comes first.  A word is a month by ``month_of`` alone.
    """
    t = _spaced(s)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    found = None
    for pattern, y, m, d in _FORMS:
        made = _iso(part(pattern, y), part(pattern, m), part(pattern, d))
        found = F.when(t.rlike(pattern), made) if found is None else found.when(t.rlike(pattern), made)
    for pattern, y, m, d in _WORD_FORMS:
        month = month_of(part(pattern, m))
        found = found.when(t.rlike(pattern), F.when(month.isNotNull(), _iso(part(pattern, y), month, part(pattern, d))))
    a, b, _ = _slash_parts(t)
    year = part(_SLASH, 3)
    first = F.coalesce(day_order(s), F.when(a == b, "day"), *([order] if order is not None else []))
    slash = F.when(first == "day", _iso(year, b, a)).when(first == "month", _iso(year, a, b))
    return found.when(t.rlike(_SLASH), slash)


def normalize_source_dates(df: DataFrame, source: str, text: str, out: str) -> DataFrame:
    """``normalize_date`` of ``text``, reading slash dates in the day order that other dates of the same ``source`` prove.

    A source without proof, or with proof of both orders, has its ambiguous
    dates left null; so has a null source.  What is joined is one row a source.
    """
    proof = F.col("__order")
    by_source = df.select(source, day_order(F.col(text)).alias("__order")).where(proof.isNotNull()).groupBy(source).agg(
        F.when(F.min(proof) == F.max(proof), F.min(proof)).alias("__order")
    )
    return df.join(by_source, source, "left").withColumn(out, normalize_date(F.col(text), proof)).drop("__order")


def normalize_currency(s: Column) -> Column:
    return F.upper(py_strip(s))


_CODE_OR_SIGN = r"(?:[A-Z]{3}|[$€£¥₹])"
#: Digits alone or in groups of three by commas, then an optional decimal point.
_POINT = r"\A(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\z"
#: Digits alone or in groups of three by points or spaces, then a decimal comma and one or two digits.
_COMMA = r"\A(?:[0-9]{1,3}(?:[. ][0-9]{3})+|[0-9]+),[0-9]{1,2}\z"


def normalize_money(s: Column) -> Column:
    """Plain decimal of a printed amount in a known form, else null.

    Known: an optional currency code or sign at either end, a minus before or
    after the sign, or parentheses for a negative amount; ``1,234.56``,
    ``1234.56``, ``1.234,56``, ``1 234,56``, ``12,5``.  Anything else (words,
    exponents, two numbers) is null.
    """
    t = py_strip(s)
    closed = t.rlike(r"\A\(.*\)\z")
    body = py_strip(F.when(closed, F.regexp_replace(t, r"\A\(|\)\z", "")).otherwise(t))
    first = F.regexp_replace(body, r"\A-\s*", "")
    bare = F.regexp_replace(F.regexp_replace(first, rf"\A{_CODE_OR_SIGN}\s*", ""), rf"\s*{_CODE_OR_SIGN}\z", "")
    number = F.regexp_replace(bare, r"\A-\s*", "")
    minus = (first != body).cast("int") + (number != bare).cast("int") + closed.cast("int")
    plain = F.when(number.rlike(_POINT), F.regexp_replace(number, ",", "")).when(
        number.rlike(_COMMA), F.translate(F.regexp_replace(number, "[. ]", ""), ",", ".")
    )
    signed = F.when(minus == 1, F.concat(F.lit("-"), plain)).when(minus == 0, plain)
    return F.when(is_plain_decimal(signed), signed)
