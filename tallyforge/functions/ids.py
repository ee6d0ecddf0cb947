"""Transaction identifiers.

The reference hashes (row index, date, timestamp, delta, description) of one account's frame.
We hash the same fields plus the account (decision Q7: equal first rows in two accounts must not
collide) with SHA-256, a built-in both Spark and the DuckDB oracle compute identically.  The
account is length-prefixed and the description comes last, so no two field tuples share a
preimage; a null description hashes differently from the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefmt import date_text


def transaction_id(account: Column, seq: Column, date: Column, epoch: Column, amount: Column,
                   description: Column) -> Column:
    desc_token = F.when(description.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), description))
    return F.sha2(
        F.concat_ws(
            "|",
            seq.cast("string"),
            date_text(date),
            epoch.cast("string"),
            amount.cast("string"),
            F.length(account).cast("string"),
            account,
            desc_token,
        ),
        256,
    )


def transaction_id_sql(account: str, seq: str, date: str, epoch: str, amount: str,
                       description: str) -> str:
    """The same identifier in DuckDB SQL (used by the oracle queries)."""
    return (
        "sha256(concat_ws('|', cast({seq} as varchar), strftime({date}, '%Y-%m-%d'), "
        "cast({epoch} as varchar), cast({amount} as varchar), cast(length({account}) as varchar), "
        "{account}, CASE WHEN {desc} IS NULL THEN '~' ELSE '=' || {desc} END))"
    ).format(seq=seq, date=date, epoch=epoch, amount=amount, account=account, desc=description)
