"""Bank CSV folders: S1, S2, S3, P1, P2, V8.

Layout (as the reference): ``<root>/<account name>/*.csv``; only files directly in an account
folder count, other files are ignored.  Each account has a bank *format*: a reader schema plus a
``DataFrame -> DataFrame`` function producing ``TransDate, Credit, Debit, Description`` (S3; the
reference executes a script found in the data folder, which we do not).  All accounts of one
format are read in ONE scan; the account comes from the file path and file order is kept through
``_metadata.file_name``, ``_metadata.file_block_start`` and a row id taken directly on the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import readable_amount
from ..functions.timefmt import epoch_seconds
from ..session import materialize
from .byte_ranges import first_records, list_files
from .schemas import RAW_COLUMNS, RAW_SCHEMA

BANK_COLUMNS = ["TransDate", "Credit", "Debit", "Description"]

DEFAULT_SCHEMA = T.StructType([
    T.StructField("TransDate", T.StringType(), True),
    T.StructField("Credit", T.StringType(), True),
    T.StructField("Debit", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
])


def _default_transform(df: DataFrame) -> DataFrame:
    # text that is no date becomes null and goes to quarantine (V8)
    return df.withColumn("TransDate", F.try_to_timestamp("TransDate", F.lit("yyyy-MM-dd")).cast("date"))


@dataclass
class BankFormat:
    """How one bank's CSV export becomes TransDate / Credit / Debit / Description.

    ``schema`` None reads each file's columns by its own header, all as text (the default format);
    a schema is applied by position, as Spark does with ``header`` and a given schema."""
    name: str = "default"
    schema: T.StructType | None = None
    options: Mapping[str, str] = field(default_factory=lambda: {"header": "true"})
    transform: Callable[[DataFrame], DataFrame] = _default_transform


DEFAULT_FORMAT = BankFormat()
LINEAGE = ["_file", "_block", "_row"]


def _escape_glob(name: str) -> str:
    out = []
    for ch in name:
        if ch in "{}[]*?\\,":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def _scan(spark: SparkSession, root: str, accounts: Sequence[str] | None, fmt: BankFormat) -> DataFrame | None:
    """One scan over the accounts' folders (``None``: every folder under ``root``)."""
    if accounts is not None and not accounts:
        return None
    if accounts is None:
        glob = f"{root.rstrip('/')}/*/*.csv"
    else:
        glob = f"{root.rstrip('/')}/{{{','.join(_escape_glob(a) for a in accounts)}}}/*.csv"
    return _scan_paths(spark, glob, fmt)


def _scan_paths(spark: SparkSession, glob: str | list[str], fmt: BankFormat) -> DataFrame | None:
    try:
        if fmt.schema is None and str(fmt.options.get("header", "")).lower() == "true":
            return _scan_by_header(spark, glob, fmt)
        reader = spark.read if fmt.schema is None else spark.read.schema(fmt.schema)
        df = reader.options(**fmt.options).csv(glob)
    except AnalysisException as e:  # no CSV file in any of these folders
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise
    return _with_lineage(df, df.columns)


def read_files(spark: SparkSession, files: DataFrame, formats: Mapping[str, BankFormat] | None = None) -> DataFrame:
    """S1 for chosen files (columns ``path``, ``format``): txn_raw of just these.  Their paths pass through the driver,
    which lists the files of every scan anyway."""
    formats = {DEFAULT_FORMAT.name: DEFAULT_FORMAT} | dict(formats or {})
    by_format: dict[str, list[str]] = {}
    for r in files.select("path", "format").distinct().collect():
        by_format.setdefault(r["format"], []).append(_escape_glob(r["path"]))
    out = spark.createDataFrame([], RAW_SCHEMA)
    for fname, paths in sorted(by_format.items()):
        out = out.unionByName(_conform(_scan_paths(spark, sorted(paths), formats[fname]), formats[fname]))
    return out


def _account_dir() -> F.Column:
    """The folder name of the file.  File paths are URL-encoded; a plus sign stands for itself."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return F.url_decode(F.regexp_replace(folder, r"\+", "%2B"))


def _with_lineage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # Lineage columns must be taken on the scan itself, before any shuffle.
    return df.select(
        *[F.col(f"`{c}`") for c in columns],
        _account_dir().alias("_account_dir"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _scan_by_header(spark: SparkSession, glob: str | list[str], fmt: BankFormat) -> DataFrame:
    """Every file's columns under the names of its own first record, found in a listing pass that reads the
    files' heads only.  Where all agree the CSV reader names the columns, else values are picked by
    position; the reader drops each file's header itself."""
    options = dict(fmt.options)
    heads = first_records(list_files(spark, glob), options.get("quote", '"'), options.get("encoding", "utf-8"))
    heads = materialize(heads.select(F.col("uri").alias("_path"), "value"), "csv-heads")  # a row a file
    kinds = [r[0] for r in heads.select("value").distinct().collect()]  # distinct headers of a bank's export
    if len(kinds) <= 1:
        df = spark.read.options(**options).csv(glob)
        return _with_lineage(df, df.columns)
    width = max(k.count(options.get("sep", ",")) + 1 for k in kinds)
    slots = [f"_c{i}" for i in range(width)]
    text = T.StructType([T.StructField(c, T.StringType(), True) for c in slots])
    csv_options = {k: v for k, v in options.items() if k in ("sep", "quote", "escape")}
    parsed = F.from_csv("value", F.lit(", ".join(f"{c} string" for c in slots)), csv_options | {"multiLine": "true"})
    names = F.transform(F.array(*[F.col(f"h.{c}") for c in slots]), lambda x: F.trim(x))
    heads = heads.withColumn("h", parsed).select("_path", names.alias("_names"))
    wanted = [r[0] for r in heads.select(F.explode("_names").alias("n")).where("n is not null and n <> ''").distinct().collect()]
    rows = spark.read.schema(text).options(**options).csv(glob)
    rows = rows.select(F.array(*slots).alias("_values"), F.col("_metadata.file_path").alias("_path"), _account_dir().alias("_account_dir"),
                       F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row")).join(heads, "_path")
    value = lambda n: F.try_element_at("_values", F.nullif(F.array_position("_names", F.lit(n)).cast("int"), F.lit(0)))
    return rows.select(*[value(n).alias(n) for n in sorted(wanted)], "_account_dir", "_file", "_block", "_row")


def homogenize(bank: DataFrame) -> DataFrame:
    """Bank columns -> txn_raw (date, epoch seconds, signed cents, description)."""
    dtype = bank.schema["TransDate"].dataType
    if isinstance(dtype, T.StringType):
        d = F.col("TransDate").try_cast("date")
        dtype = T.DateType()
    else:
        d = F.col("TransDate")
    date = d if isinstance(dtype, T.DateType) else F.to_date(d)
    return bank.select(
        F.col("account"),
        date.alias("date"),
        epoch_seconds(d, dtype).alias("epoch"),
        readable_amount(F.col("Credit"), F.col("Debit")).alias("amount"),
        F.col("Description").cast("string").alias("description"),
        F.col("_file").alias("src_file"),
        F.col("_block").alias("src_block"),
        F.col("_row").alias("src_row"),
    )


def read_account_folders(spark: SparkSession, root: str, accounts: Mapping[str, str] | Sequence[str],
                         formats: Mapping[str, BankFormat] | None = None) -> DataFrame:
    """txn_raw for the configured accounts (names from configuration, decision Q13).

    ``accounts`` maps account name -> format name (or is a list, all in the default format).
    Folders without CSV files give no rows; no accounts give a typed empty frame (Q10)."""
    if not isinstance(accounts, Mapping):
        accounts = {a: DEFAULT_FORMAT.name for a in accounts}
    formats = dict(formats or {})
    formats.setdefault(DEFAULT_FORMAT.name, DEFAULT_FORMAT)
    by_format: dict[str, list[str]] = {}
    for acct, fname in accounts.items():
        by_format.setdefault(fname, []).append(acct)
    parts = []
    for fname, accts in sorted(by_format.items()):
        scanned = _scan(spark, root, sorted(accts), formats[fname])
        if scanned is not None:
            parts.append(_conform(scanned, formats[fname]))
    if not parts:
        return spark.createDataFrame([], RAW_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _conform(scanned: DataFrame, fmt: BankFormat) -> DataFrame:
    """A scan through its bank format, with the schema check P8."""
    bank = fmt.transform(scanned)
    missing = [c for c in BANK_COLUMNS + ["_account_dir"] + LINEAGE if c not in bank.columns]
    if missing:
        raise ValueError(f"format {fmt.name!r} does not produce {missing}")
    return homogenize(bank.withColumnRenamed("_account_dir", "account")).select(*RAW_COLUMNS)


def read_selected_folders(spark: SparkSession, root: str, accounts: DataFrame,
                          formats: Mapping[str, BankFormat] | None = None) -> DataFrame:
    """S1 for an account list that is itself a DataFrame (``account`` and, optionally, ``format``):
    one scan of the folders per format, kept by a semi join, so no name list passes through the
    driver.  Gives what ``read_account_folders`` gives for the same list."""
    formats = {DEFAULT_FORMAT.name: DEFAULT_FORMAT} | dict(formats or {})
    if "format" not in accounts.columns:
        accounts = accounts.withColumn("format", F.lit(DEFAULT_FORMAT.name))
    out = None
    for fname in sorted(r[0] for r in accounts.select("format").distinct().collect()):
        own = accounts.where(F.col("format") == F.lit(fname)).select(F.col("account").alias("_account_dir"))
        scanned = _scan(spark, root, None, formats[fname])
        if scanned is not None:
            part = _conform(scanned.join(own, "_account_dir", "left_semi"), formats[fname])
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RAW_SCHEMA) if out is None else out


def unpaired_to_csv(unpaired: DataFrame, path: str) -> None:
    """The transfer rows without a partner, written as CSV."""
    unpaired.write.mode("overwrite").option("header", "true").csv(path)
