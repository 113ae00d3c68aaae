"""Exact rounding in integer arithmetic.

``ROUND(AVG(money), 2)`` and friends are computed as half-away-from-zero rounding of an
exact rational ``num / den`` with integral division, never by rounding a double: two
engines that round doubles differ on ties (``round(1.005, 2)``), while integer division
is the same everywhere.  Money is summed as DECIMAL (exact) and turned into integer
cents before dividing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal(38,0) keeps intermediate products exact far beyond BIGINT.
WIDE = "decimal(38,0)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div_floor(num, den) -> Column:
    """floor(num / den) for integral ``num`` and positive integral ``den``."""
    num, den = _c(num), _c(den)
    return F.call_function("div", num - F.pmod(num, den), den)


def half_up_div(num, den) -> Column:
    """Integer nearest to ``num / den``, halves away from zero; null when ``den`` is 0/null.

    ``den`` must be positive (counts, totals).  Arguments are widened to decimal(38,0)
    so products such as ``10000 * late`` cannot overflow.
    """
    n = _c(num).cast(WIDE)
    d = F.nullif(_c(den).cast(WIDE), F.lit(0).cast(WIDE))
    mag = F.call_function("div", 2 * F.abs(n) + d, 2 * d)
    return (F.signum(n).cast(WIDE) * mag).cast(WIDE)


def ratio_round(num, den, digits: int) -> Column:
    """``ROUND(num / den, digits)`` exactly, returned as DOUBLE."""
    scale = 10 ** digits
    return (half_up_div(_c(num).cast(WIDE) * scale, den).cast("double") / scale)


def cents(money) -> Column:
    """Exact integer cents of a DECIMAL(_,2) money column or sum."""
    return (_c(money) * 100).cast(WIDE)


def money_avg(sum_money, count, digits: int = 2) -> Column:
    """``ROUND(AVG(price), digits)`` from an exact money sum and a non-null count."""
    return ratio_round(cents(sum_money), _c(count) * 100, digits)


def to_double(col) -> Column:
    return _c(col).cast("double")


def to_cents(money) -> Column:
    """Exact integer cents of a two-decimal money value as BIGINT.  Sums of cents stay
    in 64-bit integer arithmetic inside whole-stage codegen (wide DECIMAL sums fall back
    to arbitrary-precision objects per row); BIGINT holds 9.2e16 currency units per group."""
    # rounded, as doubles such as 19.99 * 100 lie just below the cent
    return F.round(_c(money) * 100).cast("bigint")


def from_cents(cents_col, dtype: str = "decimal(22,2)") -> Column:
    """DECIMAL money from integer cents (exact)."""
    return (_c(cents_col).cast(WIDE) / 100).cast(dtype)


def cents_to_double(cents_col) -> Column:
    """DOUBLE money from integer cents: the same double as casting the exact DECIMAL."""
    return _c(cents_col).cast("double") / 100


def cents_avg(sum_cents, count, digits: int = 2) -> Column:
    """``ROUND(AVG(money), digits)`` from a sum of cents and a non-null count."""
    return ratio_round(sum_cents, _c(count) * 100, digits)
