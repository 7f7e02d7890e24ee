"""Exact decimal arithmetic.

Money is divided as whole cents. A share is never materialised and multiplied
back: ``t * w / total`` is one integer division, rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
DIGITS = 38


def power(n: int) -> Column:
    """A power of ten as a decimal literal; it may be wider than a machine integer."""
    return F.lit(str(10**n)).cast(f"decimal({n + 1},0)")


def whole(column: Column, scale: int, digits: int) -> Column:
    """A decimal with ``scale`` places as a whole number of its last place."""
    return (column * power(scale)).cast(f"decimal({digits},0)")


def unscale(column: Column, scale: int, precision: int) -> Column:
    """The inverse of ``whole``."""
    unit = F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale},{scale})")
    return (column.cast(f"decimal({precision - 1},0)") * unit).cast(f"decimal({precision},{scale})")


def div(a: Column, b: Column) -> Column:
    """Whole-number division; Spark returns it as BIGINT."""
    return F.call_function("div", a, b)


def half_of(total: Column, digits: int) -> Column:
    """Half of a whole number, rounded down."""
    two = F.lit("2").cast("decimal(1,0)")
    return ((total - total % two) * F.lit("0.5").cast("decimal(1,1)")).cast(f"decimal({digits},0)")


def mul_div(t: Column, w: Column, total: Column, *, digits: tuple[int, int, int], even: bool = False,
            half: Column | None = None) -> Column:
    """``t * w / total`` as BIGINT, rounded half up (or half even).

    All three are whole, ``t`` and ``w`` not negative, ``total`` positive, and
    ``digits`` is how many digits each may have. ``half`` is ``half_of(total)``
    where the caller has it ready, one per group. The result must fit in 18 digits.

    Adding half the total before dividing rounds half up. When the product could
    pass 38 digits ``t`` is cut into limbs and divided by long division, so no step
    overflows and the result stays exact.
    """
    t_digits, w_digits, total_digits = digits
    if max(t_digits + w_digits, total_digits) < DIGITS:
        half = half_of(total, total_digits) if half is None else half
        value = (t * w + half).cast("decimal(38,0)")
        quotient = div(value, total)
        if not even:
            return quotient
        # A tie was rounded up: nothing is left over, and half of the total was exact.
        tie = (value % total == 0) & (total % 2 == 0)
        return F.when(tie & (quotient % 2 != 0), quotient - 1).otherwise(quotient)
    limb = min(DIGITS - w_digits - 1, DIGITS - 1 - total_digits, 17)
    if limb < 1:
        raise ValueError(f"cannot divide exactly: {digits} digits")
    quotient, rest = None, None
    for i in reversed(range(-(-t_digits // limb))):
        part = div(t % power(limb * (i + 1)), power(limb * i)).cast(f"decimal({limb},0)")
        value = (part * w).cast("decimal(38,0)")
        if rest is not None:
            value = (rest * power(limb) + value).cast("decimal(38,0)")
        q = div(value, total)
        quotient = q if quotient is None else quotient * F.lit(10**limb) + q
        rest = (value % total).cast(f"decimal({total_digits},0)")
    # Compare the rest with what is missing, not with a doubled total: no digit is added.
    missing = total - rest
    up = (rest > missing) | ((rest == missing) & (quotient % 2 != 0)) if even else rest >= missing
    return F.when(up, quotient + 1).otherwise(quotient)


def money(column: Column) -> Column:
    """Cents, half up."""
    return F.round(column, 2).cast(MONEY)


def half_even(column: Column, scale: int, precision: int) -> Column:
    """Quantise with ties to the even digit, as the stored run fields are."""
    return F.bround(column, scale).cast(f"decimal({precision},{scale})")
