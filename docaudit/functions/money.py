"""Money: plain-decimal strings, exact decimal values, Python-style decimal text.

Money travels as a plain decimal string (``-?(0|[1-9]\\d*)(\\.\\d+)?``, no
exponent, no ``+``, no leading zeros) of any length.  Signs and equality are
read from its canonical text (``plain``).  Sums and products are exact: in
``decimal(28,12)``, products in parts (``product_parts``), where every value
fits; in limbs (``functions.limbs``) where one does not.

``decimal_text`` prints an exact decimal the way Python's ``str(Decimal)``
does for a given exponent: the scale of a product is the sum of the operand
scales, of a sum the largest scale; below 1E-6 Python switches to exponent
form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_DECIMAL = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
DECIMAL_TYPE = "decimal(28,12)"


def is_plain_decimal(s: Column) -> Column:
    return s.rlike(PLAIN_DECIMAL)


def scale_of(s: Column) -> Column:
    """Number of fraction digits of a plain decimal string (0 when no point)."""
    dot = F.instr(s, ".")
    return F.when(dot > 0, F.length(s) - dot).otherwise(F.lit(0))


def plain(s: Column) -> Column:
    """Canonical text of a valid money string, else null: no closing zeros of the fraction, no minus on zero.  Equal numbers have equal texts."""
    short = F.when(F.instr(s, ".") > 0, F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    return F.when(is_plain_decimal(s), F.when(short == "-0", F.lit("0")).otherwise(short))


def below(text: Column) -> Column:
    """Whether a canonical text is below zero."""
    return text.startswith("-")


def above(text: Column) -> Column:
    """Whether a canonical text is above zero."""
    return ~text.startswith("-") & (text != "0")


def decimal_of(text: Column) -> Column:
    """Exact decimal(28,12) of a canonical text of at most 16 integer and 12 fraction digits, else null."""
    dot = F.instr(text, ".")
    whole = F.when(dot > 0, dot - 1).otherwise(F.length(text)) - text.startswith("-").cast("int")
    return F.when((whole <= 16) & (scale_of(text) <= 12), text.try_cast(DECIMAL_TYPE))


def to_decimal(s: Column) -> Column:
    """Exact decimal(28,12) of a valid money string that fits, else null."""
    return decimal_of(plain(s))


def product_parts(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(negative, integer part, fraction part) of the exact product of two decimal(28,12), as decimal(35,0) and decimal(24,24)."""

    def split(v: Column) -> tuple[Column, Column]:
        whole = F.floor(F.abs(v)).cast("decimal(16,0)")
        return whole, (F.abs(v) - whole).cast("decimal(12,12)")

    (xi, xf), (yi, yf) = split(x), split(y)
    middle = xi * yf + xf * yi
    above = F.floor(middle).cast("decimal(18,0)")
    below = (middle - above).cast("decimal(12,12)") + xf * yf
    carry = F.floor(below).cast("decimal(1,0)")
    return (x < 0) != (y < 0), (xi * yi + above + carry).cast("decimal(35,0)"), (below - carry).cast("decimal(24,24)")


def product_differs(x: Column, y: Column, z: Column, tolerance: Column) -> Column:
    """|x * y - z| > tolerance, exactly; the tolerance is a decimal(18,6)."""
    negative, whole, part = product_parts(x, y)
    signed = lambda v: F.when(negative, -v).otherwise(v)
    z_whole = F.when(z < 0, F.ceil(z)).otherwise(F.floor(z)).cast("decimal(16,0)")
    gap = signed(whole) - z_whole
    rest = signed(part) - (z - z_whole).cast("decimal(12,12)")
    # factors that decimal(18,6) holds have a product that decimal(37,12) holds: no parts are needed
    xs, ys = x.try_cast("decimal(18,6)"), y.try_cast("decimal(18,6)")
    return F.when((xs == x) & (ys == y), F.abs(xs * ys - z) > tolerance).when(F.abs(gap) >= F.lit(10**13).cast("decimal(14,0)"), F.lit(True)).otherwise(
        F.abs(gap.try_cast("decimal(13,0)") + rest) > tolerance
    )


def sum_differs(terms: list[tuple[int, tuple[Column, ...]]], tolerance: Column) -> Column:
    """|sum of sign * product of canonical texts| > tolerance, exactly, as integers of up to 38 digits; null where those do not hold it."""
    scales = [sum((scale_of(x) for x in factors[1:]), scale_of(factors[0])) for _, factors in terms]
    scale = F.greatest(F.lit(6), *scales)
    padded = lambda digits, zeros: F.concat(digits, F.repeat(F.lit("0"), zeros)).try_cast("decimal(38,0)")
    fits, total = scale <= 24, None
    for (sign, factors), own in zip(terms, scales):
        digits, value = F.lit(0), None
        for x in factors:
            digits = digits + F.length(F.translate(x, "-.", ""))
            whole = F.translate(x, ".", "").try_cast("decimal(38,0)")
            value = whole if value is None else F.try_multiply(value, whole)
        fits = fits & (digits + scale - own <= 36)
        value = padded(value.cast("string"), scale - own) * F.lit(sign).cast("decimal(1,0)")
        total = value if total is None else total + value
    bound = padded((tolerance * F.lit(10**6)).cast("decimal(24,0)").cast("string"), scale - 6)
    return F.when(fits, F.abs(total) > bound)


def product_text(x: Column, y: Column, scale: Column) -> Column:
    """``decimal_text`` of the exact product of two decimal(28,12)."""
    negative, whole, part = product_parts(x, y)
    nonzero = (x != 0) & (y != 0)
    fraction = F.substring_index(part.cast("string"), ".", -1)
    return F.when(x.isNotNull() & y.isNotNull(), python_text(negative & nonzero, whole.cast("string"), fraction, scale))


def decimal_text(value: Column, scale: Column) -> Column:
    """Python ``str(Decimal)`` of ``value`` carried at exponent ``-scale``.

    ``value`` must be exact at ``scale`` digits (true for products and sums of
    the source values); ``scale`` is an int column or literal.
    """
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    raw = value.cast("string")
    negative = raw.startswith("-")
    body = F.regexp_replace(raw, "^-", "")
    int_part = F.substring_index(body, ".", 1)
    frac_raw = F.when(F.instr(body, ".") > 0, F.substring_index(body, ".", -1)).otherwise(F.lit(""))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(python_text(negative, int_part, frac_raw, scale))


def python_text(negative: Column, int_part: Column, frac_raw: Column, scale: Column) -> Column:
    """Python ``str(Decimal)`` at exponent ``-scale`` from the digits before and after the point."""
    frac = F.substring(F.concat(frac_raw, F.repeat(F.lit("0"), scale)), F.lit(1), scale)
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, int_part, F.when(scale > 0, F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    coefficient = F.regexp_replace(F.concat(int_part, frac), "^0+", "")
    coefficient = F.when(coefficient == "", F.lit("0")).otherwise(coefficient)
    left_digits = F.length(coefficient) - scale
    scientific = F.concat(
        sign,
        F.substring(coefficient, 1, 1),
        F.when(
            F.length(coefficient) > 1,
            F.concat(F.lit("."), coefficient.substr(F.lit(2), F.length(coefficient))),
        ).otherwise(F.lit("")),
        F.lit("E"),
        (left_digits - 1).cast("string"),
    )
    return F.when(left_digits > -6, plain).otherwise(scientific)


def money_text(d: Column, scale: int) -> Column:
    """Fixed-scale text of a decimal (used by adapters that emit money strings)."""
    return d.cast(f"decimal(18,{scale})").cast("string")
