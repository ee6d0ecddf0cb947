"""JSON edge: S4-S9 (account files, frame files, ledger configuration, rule files).

The reference writes UTF-8 JSON with a byte-order mark; Spark's JSON reader accepts it.  Rule
files and ledger configurations are configuration: read with explicit schemas by Spark (so they
can live on any Hadoop file system) and, being small, turned into driver-side objects.
Transactions inside account files are never collected: ``inline`` turns the nested array into
rows.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import cents
from ..plans.config import AccountMapping, DerivedRule, Matching, TransferMapping
from ..session import materialize
from .byte_ranges import PART_BYTES, json_array_parts, list_files

# Fixed field names of the reference's JSON files.
F_DEFAULT_LEDGER = "default ledger"
F_LEDGERS = "ledgers"
F_LEDGER_NAME = "ledger name"
F_ACCOUNTING_FILE = "accounting file"
F_SOURCE_DIR = "source account directory"
F_SOURCE_ACCOUNTS = "source accounts"
F_ACCOUNT_NAME = "account name"
F_OPENING = "opening balance"
F_DERIVED = "derived accounts"
F_MATCHINGS = "matchings"
F_STRINGS = "strings"
F_STARTING = "starting value"
F_INTERNAL = "internal transactions"
F_FROM_ACCOUNT = "from account"
F_FROM_MATCHINGS = "from matchings"
F_TO_ACCOUNT = "to account"
F_TO_MATCHINGS = "to matchings"
F_TREE = "derived account category tree"

TXN_STRUCT = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])

ACCOUNT_FILE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("start_value", T.DoubleType()),
    T.StructField("end_value", T.DoubleType()),
    T.StructField("transactions", T.ArrayType(TXN_STRUCT)),
    T.StructField("first_position", T.LongType()),  # of a long account's later files; else absent
])
FILE_ROWS = 100_000  # rows that one exported JSON object holds at most

CONFIG_SCHEMA = T.StructType([
    T.StructField(F_DEFAULT_LEDGER, T.StringType()),
    T.StructField(F_LEDGERS, T.ArrayType(T.StructType([
        T.StructField(F_LEDGER_NAME, T.StringType()),
        T.StructField(F_ACCOUNTING_FILE, T.StringType()),
        T.StructField(F_SOURCE_DIR, T.StringType()),
        T.StructField(F_SOURCE_ACCOUNTS, T.ArrayType(T.StructType([
            T.StructField(F_ACCOUNT_NAME, T.StringType()),
            T.StructField(F_OPENING, T.DoubleType()),
        ]))),
    ]))),
])

MAPPING_SCHEMA = T.StructType([
    T.StructField(F_DERIVED, T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField(F_MATCHINGS, T.ArrayType(T.StructType([
            T.StructField(F_ACCOUNT_NAME, T.StringType()),
            T.StructField(F_STRINGS, T.ArrayType(T.StringType())),
        ]))),
        T.StructField(F_STARTING, T.DoubleType()),
    ]))),
    T.StructField(F_INTERNAL, T.ArrayType(T.StructType([
        T.StructField(F_FROM_ACCOUNT, T.StringType()),
        T.StructField(F_FROM_MATCHINGS, T.ArrayType(T.StringType())),
        T.StructField(F_TO_ACCOUNT, T.StringType()),
        T.StructField(F_TO_MATCHINGS, T.ArrayType(T.StringType())),
    ]))),
    T.StructField(F_TREE, T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def _bt(name: str) -> str:
    return f"`{name}`"


def read_json_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


# ---- ledger configuration (S7, D10, D11) --------------------------------------------------

def read_ledger_configuration(spark: SparkSession, path: str) -> DataFrame:
    """One row per (ledger, source account): ledger_name, accounting_file, source_dir,
    is_default, account, start_value (cents; default 0).  A missing or unreadable file gives an
    empty configuration, as in the reference."""
    empty = spark.createDataFrame([], "ledger_name string, accounting_file string, source_dir string, "
                                      "is_default boolean, account string, start_value bigint")
    try:
        cfg = read_json_object(spark, path, CONFIG_SCHEMA)
        cfg.schema  # noqa: B018 - forces the listing
    except Exception:  # noqa: BLE001 - reference: bad configuration -> empty configuration
        return empty
    led = cfg.select(F.col(_bt(F_DEFAULT_LEDGER)).alias("default"), F.inline_outer(_bt(F_LEDGERS)))
    acc = led.select(
        F.col(_bt(F_LEDGER_NAME)).alias("ledger_name"),
        F.col(_bt(F_ACCOUNTING_FILE)).alias("accounting_file"),
        F.col(_bt(F_SOURCE_DIR)).alias("source_dir"),
        (F.col(_bt(F_LEDGER_NAME)) == F.col("default")).alias("is_default"),
        F.inline_outer(_bt(F_SOURCE_ACCOUNTS)),
    )
    return acc.where(F.col("ledger_name").isNotNull()).select(
        "ledger_name", "accounting_file", "source_dir", F.coalesce("is_default", F.lit(False)).alias("is_default"),
        F.col(_bt(F_ACCOUNT_NAME)).alias("account"),
        F.coalesce(cents(F.col(_bt(F_OPENING))), F.lit(0).cast("bigint")).alias("start_value"),
    )


def select_ledger(config: DataFrame, name: str | None = None) -> DataFrame:
    """The named ledger, or the configured default."""
    if name is not None:
        return config.where(F.col("ledger_name") == F.lit(name))
    return config.where("is_default")


# ---- rule file (S8, S9) --------------------------------------------------------------------

def read_account_mapping(spark: SparkSession, path: str) -> AccountMapping:
    """S8 + S9 -> driver-side configuration (a rule file is small; bounded by its rule count).

    A missing file is a fresh, empty mapping (the reference writes one); a missing tree means
    one root over all derived accounts (Q17)."""
    try:
        df = read_json_object(spark, path, MAPPING_SCHEMA)
        rows = df.limit(1).collect()
    except AnalysisException:  # missing file: a fresh, empty mapping
        return AccountMapping()
    if not rows:
        return AccountMapping()
    r = rows[0]
    derived = []
    for d in r[F_DERIVED] or []:
        ms = tuple(Matching(m[F_ACCOUNT_NAME], tuple(m[F_STRINGS] or ())) for m in (d[F_MATCHINGS] or []))
        start = d[F_STARTING]
        derived.append(DerivedRule(d["name"], ms, int(round((start or 0.0) * 100))))
    transfers = [TransferMapping(t[F_FROM_ACCOUNT], tuple(t[F_FROM_MATCHINGS] or ()), t[F_TO_ACCOUNT],
                                 tuple(t[F_TO_MATCHINGS] or ())) for t in (r[F_INTERNAL] or [])]
    tree_df = df.select(F.posexplode(F.map_entries(F.col(_bt(F_TREE)))).alias("pos", "e"))
    tree = None
    if r[F_TREE] is not None:
        entries = tree_df.orderBy("pos").collect()
        tree = {e["e"]["key"]: list(e["e"]["value"]) for e in entries}
    return AccountMapping(derived, transfers, tree)


def tree_edges_from_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """S9 as a distributed read: edges (parent, child, ord) from the rule file's tree map."""
    from ..operators.hierarchy import edges_from_map
    return edges_from_map(read_json_object(spark, path, MAPPING_SCHEMA), F_TREE)


# ---- account and frame files (S4, S6) -------------------------------------------------------

def _account_parts(spark: SparkSession, path: str, part_bytes: int) -> tuple[DataFrame, DataFrame]:
    files = list_files(spark, path)
    rows, heads = json_array_parts(files, "transactions", part_bytes)
    head = F.from_json("head", ACCOUNT_FILE_SCHEMA)
    return rows, heads.select("path", head.alias("h")).select("path", "h.*")


def read_account_files(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Account JSON files -> identified transaction rows (account, seq, id, date, epoch,
    amount, description); ``seq`` is the position in the stored array.  A long file is cut at element
    borders and read by many tasks, ``part_bytes`` each."""
    rows, heads = _account_parts(spark, path, part_bytes)
    rows = materialize(rows, "account-parts")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.where("first = 0").select("path", "start", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    named = heads.select("path", F.col("name").alias("account"), F.coalesce("first_position", F.lit(0)).alias("file_first"))
    rows = rows.join(firsts.join(named, "path"), ["path", "start"])
    rows = rows.select("account", (F.col("file_first") + F.col("base") + F.col("first")).alias("first"),
                       F.posexplode(F.from_json("chunk", T.ArrayType(TXN_STRUCT))).alias("seq", "t"))
    return rows.select(
        "account", (F.col("first") + F.col("seq")).cast("bigint").alias("seq"), F.col("t.ID").alias("id"),
        F.to_date("t.date").alias("date"), F.floor("t.timestamp").cast("bigint").alias("epoch"),
        cents(F.col("t.delta")).alias("amount"), F.col("t.description").alias("description"))


def read_account_headers(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Name, start and end values (cents) of account files."""
    _, acc = _account_parts(spark, path, part_bytes)
    return acc.where(F.coalesce("first_position", F.lit(0)) == 0).select(
        F.col("name"), F.lit("source").alias("kind"), cents(F.col("start_value")).alias("start_value"),
        cents(F.col("end_value")).alias("end_value"))


def read_frame_file(spark: SparkSession, path: str, row_schema: T.StructType) -> DataFrame:
    """``{"frame": [rows]}`` -> rows."""
    schema = T.StructType([T.StructField("frame", T.ArrayType(row_schema))])
    return read_json_object(spark, path, schema).select(F.inline("frame"))


def write_frame_files(df: DataFrame, path: str, rows_per_file: int = FILE_ROWS) -> None:
    """``{"frame": [rows]}`` objects of at most ``rows_per_file`` rows, one a file, which
    ``read_frame_file`` reads back together."""
    names = df.columns
    part = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    chunk = F.floor(F.pmod("_at", F.lit(1 << 33)) / rows_per_file)
    frames = part.groupBy("_part", chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_at", F.struct(*names).alias("row")))).alias("rows"))
    frames.select(F.transform("rows", lambda r: r["row"]).alias("frame")).write.option("maxRecordsPerFile", 1).json(path)


def write_account_files(txn: DataFrame, balances: DataFrame, path: str, rows_per_file: int = FILE_ROWS) -> None:
    """Account objects (name, start and end value, transactions) that S4 reads back, one a file.
    An account of more than ``rows_per_file`` transactions takes several, each with its
    ``first_position``, so no row grows with its account.  ``balances``: name, start_value, end_value."""
    amount = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("double")
    t = F.struct("seq", F.struct(F.col("id").alias("ID"), F.date_format("date", "yyyy-MM-dd").alias("date"), amount("amount").alias("delta"),
                                 "description", F.col("epoch").cast("double").alias("timestamp")).alias("t"))
    chunks = txn.groupBy(F.col("account").alias("name"), F.floor(F.col("seq") / rows_per_file).alias("chunk")).agg(
        F.sort_array(F.collect_list(t)).alias("rows"))
    rows = balances.join(chunks, "name", "left")
    out = rows.select("name", amount("start_value").alias("start_value"), amount("end_value").alias("end_value"),
                      F.coalesce(F.transform("rows", lambda r: r["t"]), F.array().cast(T.ArrayType(TXN_STRUCT))).alias("transactions"),
                      F.when(F.col("chunk") > 0, F.col("chunk") * rows_per_file).alias("first_position"))
    out.write.option("maxRecordsPerFile", 1).json(path)


def write_account_mapping(spark: SparkSession, mapping: AccountMapping, path: str) -> None:
    """A rule file (as a folder with one file) that ``read_account_mapping`` reads back."""
    rules = {
        F_DERIVED: [{"name": r.name, F_MATCHINGS: [{F_ACCOUNT_NAME: m.account_name or "", F_STRINGS: list(m.strings)} for m in r.matchings],
                     F_STARTING: r.start_value / 100} for r in mapping.derived],
        F_INTERNAL: [{F_FROM_ACCOUNT: t.from_account, F_FROM_MATCHINGS: list(t.from_strings), F_TO_ACCOUNT: t.to_account,
                      F_TO_MATCHINGS: list(t.to_strings)} for t in mapping.transfers],
    }
    if mapping.tree is not None:
        rules[F_TREE] = mapping.tree
    spark.createDataFrame([(json.dumps(rules, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_transactions_jsonl(txn: DataFrame, path: str) -> None:
    """S5 / S6 export: one JSON line per transaction in the reference's field names, partitioned
    by account.  (A whole account in one JSON object, as the reference stores it, would put an
    unbounded group into one row; the line form keeps the same fields without that.)"""
    out = txn.select(
        "account", F.col("id").alias("ID"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        (F.col("amount").cast("decimal(20,0)") / 100).cast("double").alias("delta"), "description",
        F.col("epoch").cast("double").alias("timestamp"))
    out.write.mode("overwrite").partitionBy("account").json(path)
