"""Money as BIGINT cents; percentages as BIGINT basis points.

Sums of doubles depend on the order of addition, so every amount is held as
integer cents and turned into a DOUBLE only on output (``cents / 100``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Two-decimal amount -> BIGINT cents, half away from zero (``toFixed(2)``)."""
    return F.round(amount * 100).cast("bigint")


def cents_to_amount(cents: Column) -> Column:
    """BIGINT cents -> DOUBLE amount (the reference's ``::money::float8`` output)."""
    return cents / F.lit(100)


def half_up_div(numerator: Column, denominator: int) -> Column:
    """Exact ``round(numerator / denominator)``, half away from zero, as BIGINT.

    Uses DECIMAL(38,0) so large products of cents and basis points do not lose
    precision the way a DOUBLE division would.
    """
    magnitude = F.abs(numerator).cast("decimal(38,0)") + F.lit(denominator // 2)
    quotient = F.floor(magnitude / F.lit(denominator)).cast("bigint")
    return F.when(numerator < 0, -quotient).otherwise(quotient)


def apply_percent_off(total_cents: Column, bp_off: Column) -> Column:
    """``total - sum(percent)/100 * total`` in cents: every percent is taken off
    the original total (additive), with no floor at 0."""
    # DECIMAL(38,0) before multiplying: no BIGINT overflow for any total.
    return half_up_div(total_cents.cast("decimal(38,0)") * (F.lit(10000) - bp_off), 10000)
