"""Table schemas of the ledger model."""

from pyspark.sql import types as T

# txn_raw: imported rows before numbering.  (src_file, src_block, src_row) restore file order:
# src_row is unique inside (account, epoch, src_file, src_block).
RAW_COLUMNS = ["account", "date", "epoch", "amount", "description", "src_file", "src_block", "src_row"]

RAW_SCHEMA = T.StructType([
    T.StructField("account", T.StringType(), False),
    T.StructField("date", T.DateType(), True),
    T.StructField("epoch", T.LongType(), True),
    T.StructField("amount", T.LongType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("src_file", T.StringType(), True),
    T.StructField("src_block", T.LongType(), True),
    T.StructField("src_row", T.LongType(), True),
])

# txn: identified source transactions, all accounts in one table.
TXN_COLUMNS = ["account", "seq", "id", "date", "epoch", "amount", "description",
               "src_file", "src_block", "src_row"]

# derived_txn
DERIVED_COLUMNS = ["derived_account", "seq", "id", "date", "epoch", "amount", "description",
                   "source_id", "source_account", "rule_no", "matching_no", "source_seq"]

# ledger entries (the reference's five columns)
ENTRY_COLUMNS = ["from_account_name", "from_transaction_id", "to_account_name",
                 "to_transaction_id", "delta"]

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("start_value", T.LongType(), False),
])

# unaccounted list, as the reference orders its columns
UNACCOUNTED_COLUMNS = ["index", "date", "description", "delta", "account"]
