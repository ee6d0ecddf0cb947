"""Account browser queries: L17, P9, O3, F2-F5, S15, S16.

The reference's table widget sorts by a clicked column (ascending first, the same column again
flips), applies a description filter and shows the rows.  These are plain DataFrame operations;
the toggle itself is driver-side state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_text


def select_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The given columns, in that order; they must exist and match the frame's width."""
    missing = [c for c in order if c not in df.columns]
    if missing or len(order) != len(df.columns):
        raise ValueError(f"column order {list(order)} does not fit frame columns {df.columns}")
    return df.select(*order)


@dataclass
class SortState:
    """O3 toggle: a new column sorts ascending, the same column again flips the direction."""
    column: str | None = None
    descending: bool = False

    def click(self, column: str) -> SortState:
        if column != self.column:
            return SortState(column, False)
        return SortState(column, not self.descending)


def sort_frame(df: DataFrame, state: SortState, tie_break: Sequence[str] = ()) -> DataFrame:
    """O3: nulls first in both directions (as the reference's frame sort), then ``tie_break``
    (decision Q20).  A distributed range sort; nothing is collected."""
    col = F.col(state.column or df.columns[0])
    key = col.desc_nulls_first() if state.descending else col.asc_nulls_first()
    return df.orderBy(key, *[F.col(c).asc() for c in tie_break if c != state.column])


def filter_description(df: DataFrame, text: str, column: str = "description") -> DataFrame:
    """F2 (decision Q6: the ``description`` column)."""
    return df if text == "" else df.where(contains_text(F.col(column), text))


def filter_sql(df: DataFrame, condition: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """F3 (decision Q3: the filter is applied): ``SELECT * WHERE condition``; values are passed as
    named parameters (``:name``), never spliced into the text."""
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{frame}} WHERE {condition}", args=dict(args or {}), frame=df)


def time_range(df: DataFrame, start: int, end: int, column: str = "epoch") -> DataFrame:
    """closed range start <= t <= end."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def apply_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a caller-supplied frame -> frame function (errors are raised, not hidden)."""
    return df.transform(fn)


def browse(df: DataFrame, columns: Sequence[str], state: SortState, text: str = "",
           tie_break: Sequence[str] = ()) -> DataFrame:
    """Sort, then filter, then show all columns in the chosen order (P9: any other list is an error)."""
    shown = sort_frame(select_columns(df, columns), state, tie_break)
    return filter_description(shown, text)


def account_names(accounts: DataFrame, column: str = "name") -> DataFrame:
    """Stored names, sorted."""
    return accounts.select(F.col(column).alias("name")).distinct().orderBy("name")


def run_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame],
            args: Mapping[str, object] | None = None) -> DataFrame:
    """Any SQL over the ledger's tables, registered as temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))
