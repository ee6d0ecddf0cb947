"""Money columns.

Amounts are held as BIGINT minor units (cents): exact sums, fixed-width shuffle rows and
long-arithmetic codegen.  Inputs with more than two decimals are rounded half-even on the way in;
the reference rounds its float balances to two places at output, so results agree to the cent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SCALE = 2
DISPLAY_TYPE = "decimal(20,2)"


def cents(x: Column | str) -> Column:
    """Numeric or text amount -> BIGINT cents; unparsable text gives NULL (quarantined later)."""
    c = F.col(x) if isinstance(x, str) else x
    dec = c.try_cast("decimal(38,6)")
    return F.bround(dec * F.lit(100), 0).try_cast("bigint")


def signed_amount(credit: Column, debit: Column) -> Column:
    """Debit when present, else minus credit; both set -> debit wins; both null -> null."""
    return F.coalesce(debit, -credit)


def readable_amount(credit: Column, debit: Column) -> Column:
    """P2 over raw cells: a cell that holds something which is no amount makes the row unreadable
    (null, so quarantined) instead of passing for an empty cell."""
    def unreadable(c: Column) -> Column:
        return (F.trim(c.cast("string")) != "") & cents(c).isNull()

    bad = F.coalesce(unreadable(debit), F.lit(False)) | F.coalesce(unreadable(credit), F.lit(False))
    return F.when(~bad, signed_amount(cents(credit), cents(debit)))


def cents_to_decimal(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return (c.cast("decimal(20,0)") / F.lit(100)).cast(DISPLAY_TYPE)
