"""Internal transfers: F7, J4, J5, A8, A9, L7, V7, V9.

For each mapping (from account + patterns, to account + patterns) the reference pairs the k-th
matching row of the from account with the k-th matching row of the to account, cut to the
shorter side, logs whether the paired amounts are exact opposites and lists the tail of the
longer side as missing on the other account.

Here all mappings run in one job: the distinct patterns of the mapping table are matched in one pass
(``operators.matcher``), a row meets only the mappings of its account whose pattern it matches, both sides
are ranked by one ordered scan, and the ranked sides are zipped block by block: blocks of ranks hold
the k-th rows of both sides next to each other, so there is no join of the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import ENTRY_COLUMNS
from .matcher import matching_patterns
from .sequencing import ordered_scan

RANK_BLOCK = 1 << 16  # ranks zipped in one group: at most two rows each


def usable_mappings(mappings: DataFrame) -> DataFrame:
    """a mapping from an account to itself is skipped (and reported by V7)."""
    return mappings.where(F.col("from_account") != F.col("to_account"))


def self_transfers(mappings: DataFrame) -> DataFrame:
    """V7."""
    return mappings.where(F.col("from_account") == F.col("to_account")).select(
        "mapping_no", F.col("from_account").alias("account"))


def ranked_sides(txn: DataFrame, mappings: DataFrame) -> DataFrame:
    """``mapping_no, side, k`` and the row's fields for every matching row of either side of a mapping;
    k is the row's position among its side's matches in account order."""
    m = usable_mappings(mappings)
    sides = m.select("mapping_no", F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_account").alias("account"), F.col(f"{side}_regex").alias("regex"))
        for side in ("from", "to")])))
    hits = matching_patterns(txn.select("account", "seq", "id", "amount", "description", "date", "epoch"), sides)
    return ordered_scan(hits.join(sides, ["account", "regex"]).drop("regex"), ["mapping_no", "side"], ["seq"], index="k")


def transfer_matches(txn: DataFrame, mappings: DataFrame) -> DataFrame:
    """J4 + J5: full pairing on (mapping_no, k); one side null = no partner.  Ranks are dense on both
    sides, so inside a block of ranks, ordered by (k, side), partners are neighbours."""
    fields = ("account", "seq", "id", "amount", "description", "date", "epoch")
    ranked = ranked_sides(txn, mappings).withColumn("_block", F.expr(f"k div {RANK_BLOCK}"))
    w = Window.partitionBy("mapping_no", "_block").orderBy("k", "side")
    row = F.struct("k", *fields)
    zipped = ranked.withColumn("_next", F.lead(row).over(w)).withColumn("_before", F.lag("k").over(w))
    is_from = F.col("side") == "from"
    partner = F.when(is_from & (F.col("_next.k") == F.col("k")), F.col("_next")).when(~is_from, row)
    whole = zipped.where(is_from | ~F.col("k").eqNullSafe(F.col("_before")))
    return whole.select(
        "mapping_no", "k", *[F.when(is_from, F.col(c)).alias(f"from_{c}") for c in fields],
        *[partner.getField(c).alias(f"to_{c}") for c in fields])


def transfer_pairs(matches: DataFrame) -> DataFrame:
    """The paired rows (both sides present) with ``in_sync`` per pair."""
    p = matches.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    return p.withColumn("pair_in_sync", F.col("from_amount") == -F.col("to_amount"))


def transfer_entries(matches: DataFrame) -> DataFrame:
    """Ledger entries of the pairs, delta = |from amount|."""
    p = transfer_pairs(matches)
    return p.select(
        F.col("from_account").alias("from_account_name"),
        F.col("from_id").alias("from_transaction_id"),
        F.col("to_account").alias("to_account_name"),
        F.col("to_id").alias("to_transaction_id"),
        F.abs("from_amount").alias("delta"),
    ).select(*ENTRY_COLUMNS)


def unpaired(matches: DataFrame) -> DataFrame:
    """Matched rows with no partner, reported as missing on the other account."""
    f = matches.where(F.col("to_id").isNull()).select(
        "mapping_no", "k", F.lit("from").alias("side"), F.col("from_account").alias("account"),
        F.col("from_id").alias("id"), F.col("from_seq").alias("seq"),
        F.col("from_amount").alias("amount"), F.col("from_date").alias("date"),
        F.col("from_description").alias("description"))
    t = matches.where(F.col("from_id").isNull()).select(
        "mapping_no", "k", F.lit("to").alias("side"), F.col("to_account").alias("account"),
        F.col("to_id").alias("id"), F.col("to_seq").alias("seq"),
        F.col("to_amount").alias("amount"), F.col("to_date").alias("date"),
        F.col("to_description").alias("description"))
    return f.unionByName(t)


def transfer_report(mappings: DataFrame, matches: DataFrame) -> DataFrame:
    """A8, A9, V9 per usable mapping: match counts per side, pairs, sync, unpaired rows.

    ``in_sync`` is true when every pair has opposite amounts (true for no pairs, as the
    reference's frame comparison of two empty columns)."""
    m = usable_mappings(mappings).select("mapping_no", "from_account", "to_account")
    agg = matches.groupBy("mapping_no").agg(
        F.count("from_id").alias("n_from"),
        F.count("to_id").alias("n_to"),
        F.count(F.when(F.col("from_id").isNotNull() & F.col("to_id").isNotNull(), 1)).alias("n_paired"),
        F.coalesce(F.bool_and(F.when(F.col("from_id").isNotNull() & F.col("to_id").isNotNull(),
                                     F.col("from_amount") == -F.col("to_amount"))), F.lit(True)).alias("in_sync"),
    )
    r = m.join(agg, "mapping_no", "left")
    return r.select(
        "mapping_no", "from_account", "to_account",
        F.coalesce("n_from", F.lit(0)).alias("n_from"),
        F.coalesce("n_to", F.lit(0)).alias("n_to"),
        F.coalesce("n_paired", F.lit(0)).alias("n_paired"),
        F.least(F.coalesce("n_from", F.lit(0)), F.coalesce("n_to", F.lit(0))).alias("pair_count"),
        F.coalesce("in_sync", F.lit(True)).alias("in_sync"),
        (F.coalesce("n_to", F.lit(0)) - F.coalesce("n_from", F.lit(0))).alias("diff_to_from"),
    )
