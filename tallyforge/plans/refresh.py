"""Incremental refresh: I1-I6, I8 (the reference's content-hash cache, re-aimed at partitions).

Keys:
* I1 folder fingerprint: file path, modification time and size of every file below an account
  folder, combined order-free (count + sums of two 64-bit hashes) per account;
* I2 source key: account, folder fingerprint, opening balance, ``LOGIC_VERSION``;
* I3 derived key: the rule, the keys of the accounts it reads (all of them for a universal
  rule), ``LOGIC_VERSION``;
* I4 ledger key: the whole mapping and all source keys.

``refresh_ledger`` compares the keys with those of the store's newest version (``plans.manifest_log``), extends the
accounts that only gained later rows, rebuilds the others that changed, and publishes all tables and
keys as one new version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import LOGIC_VERSION
from ..operators import ledger as ledger_ops
from ..operators import rules as rule_ops
from ..operators import transfers as transfer_ops
from ..operators.identity import identify, valid_raw
from ..session import materialize
from ..sources.csv_folders import read_files
from ..sources.schemas import DERIVED_COLUMNS, RAW_SCHEMA, TXN_COLUMNS
from .config import AccountMapping, mappings_frame
from .manifest_log import PARTS, ManifestLog


# ---- I1 / I2 / I3 / I4 ----------------------------------------------------------------------

def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(account, path, rel, mtime, length) of every file below an account folder; content is not read."""
    root = root.rstrip("/")
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                 .select("path", "modificationTime", "length"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "account string, path string, rel string, mtime timestamp, length long")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _re_escape(root.split(":")[-1]) + "/", "")
    f = files.select(F.split(rel, "/").getItem(0).alias("account"), "path", rel.alias("rel"),
                     F.col("modificationTime").alias("mtime"), "length")
    return f.where(F.instr("rel", "/") > 0)  # files directly in root belong to no account


def fingerprints(files: DataFrame) -> DataFrame:
    """(account, n_files, fingerprint) of listed files: an order-free sum over their hashes."""
    row = F.struct("rel", F.col("mtime").cast("string"), "length")
    agg = files.groupBy("account").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("_x"),
        F.sum(F.hash(row).cast("decimal(38,0)")).alias("_m"))
    return agg.select("account", "n_files", F.sha2(F.concat_ws("|", "n_files", F.col("_x").cast("string"),
                                                                F.col("_m").cast("string")), 256).alias("fingerprint"))


def folder_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """I1 of every account folder with files."""
    return fingerprints(folder_files(spark, root))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def source_keys(accounts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(object_name = 'source:<account>', account, fingerprint)."""
    j = accounts.select(F.col("name").alias("account"), "start_value").join(fingerprints, "account", "left")
    key = F.sha2(F.concat_ws("|", F.lit(LOGIC_VERSION), F.length("account").cast("string"), "account",
                             F.coalesce("fingerprint", F.lit("no files")), F.col("start_value").cast("string")), 256)
    return j.select(F.concat(F.lit("source:"), "account").alias("object_name"), "account", key.alias("fingerprint"))


def _agg_keys(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).alias("_x"),
        F.sum(F.hash("fingerprint").cast("decimal(38,0)")).alias("_m"))


def derived_keys(spark: SparkSession, mapping: AccountMapping, src_keys: DataFrame) -> DataFrame:
    """One key per derived account over the keys of the accounts its rule reads."""
    deps = []
    for number, rule in enumerate(mapping.derived):
        # stored rows carry the rule's number, so its place in the list is part of the key
        text = json.dumps({"number": number, "rule": asdict(rule)}, sort_keys=True)
        if rule.is_universal:
            deps.append((rule.name, None, text))
        else:
            deps.extend((rule.name, m.account_name, text) for m in rule.matchings if not m.is_blank)
    dep = spark.createDataFrame(deps, "derived string, account string, rule_text string")
    sk = src_keys.select("account", "fingerprint")
    named = dep.where(F.col("account").isNotNull()).join(sk, "account", "left") \
        .select("derived", F.coalesce("fingerprint", F.lit("missing")).alias("fingerprint"))
    parts = _agg_keys(named, "derived").select("derived", "_n", "_x", "_m")
    # A universal rule reads every account: one aggregate row over all keys, as literals.
    t = _agg_keys(sk.withColumn("derived", F.lit("*")), "derived").collect()
    tn, tx, tm = (t[0]["_n"], t[0]["_x"], t[0]["_m"]) if t else (0, 0, 0)
    univ = dep.where(F.col("account").isNull()).select(
        "derived", F.lit(tn).cast("bigint").alias("_n"), F.lit(str(tx)).cast("decimal(38,0)").alias("_x"),
        F.lit(str(tm)).cast("decimal(38,0)").alias("_m")).distinct()
    parts = parts.unionByName(univ)
    text = dep.groupBy("derived").agg(F.first("rule_text").alias("rule_text"))
    j = text.join(parts, "derived", "left")
    key = F.sha2(F.concat_ws("|", F.lit(LOGIC_VERSION), "rule_text", F.coalesce(F.col("_n").cast("string"), F.lit("0")),
                             F.coalesce(F.col("_x").cast("string"), F.lit("0")),
                             F.coalesce(F.col("_m").cast("string"), F.lit("0"))), 256)
    return j.select(F.concat(F.lit("derived:"), "derived").alias("object_name"),
                    F.col("derived").alias("account"), key.alias("fingerprint"))


def ledger_key(spark: SparkSession, mapping: AccountMapping, src_keys: DataFrame, mappings_df: DataFrame) -> DataFrame:
    """I4: the whole rule file, the transfer table and every source key."""
    text = json.dumps({"derived": [asdict(r) for r in mapping.derived],
                       "transfers": [asdict(t) for t in mapping.transfers]}, sort_keys=True)
    mrow = F.struct(*[F.col(c).cast("string") for c in mappings_df.columns])
    m = mappings_df.agg(F.count(F.lit(1)).alias("_mn"),
                        F.sum(F.xxhash64(mrow).cast("decimal(38,0)")).alias("_mx")).collect()[0]
    k = _agg_keys(src_keys.withColumn("g", F.lit(1)), "g").collect()
    k = k[0] if k else {"_n": 0, "_x": 0, "_m": 0}
    parts = [LOGIC_VERSION, text] + [str(v if v is not None else 0)
                                     for v in (m["_mn"], m["_mx"], k["_n"], k["_x"], k["_m"])]
    import hashlib
    key = hashlib.sha256("|".join(parts).encode()).hexdigest()
    return spark.createDataFrame([("ledger", None, key)], "object_name string, account string, fingerprint string")


def stale_objects(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Objects whose key differs from the recorded one (or that were never recorded)."""
    m = recorded.select("object_name", F.col("fingerprint").alias("_old"))
    return current.join(m, "object_name", "left").where(
        ~F.col("fingerprint").eqNullSafe(F.coalesce("_old", F.lit("0"))))


# ---- I5 refresh -------------------------------------------------------------------------------

@dataclass
class RefreshResult:
    """``sources``: (account, action) of the accounts that changed, action ``rebuilt``, ``extended`` or ``removed``."""
    sources: DataFrame
    rebuilt_derived: list[str]
    ledger_rebuilt: bool
    version: int

    def accounts(self, action: str) -> list[str]:
        """The accounts of one action, by name."""
        return sorted(r["account"] for r in self.sources.where(F.col("action") == action).collect())


def with_formats(accounts: DataFrame, account_formats: dict[str, str] | None) -> DataFrame:
    """``account`` with its bank format's name; accounts that are not named use the default."""
    spark = accounts.sparkSession
    named = spark.createDataFrame(list((account_formats or {}).items()), "account string, format string")
    return accounts.join(named, "account", "left").select(*accounts.columns, F.coalesce("format", F.lit("default")).alias("format"))


def account_bucket(account_col: F.Column, buckets: int) -> F.Column:
    """Storage bucket of an account: the unit a refresh rewrites (one folder per bucket, not per
    account, so a billion accounts still make only ``buckets`` partitions)."""
    return F.pmod(F.xxhash64(account_col), F.lit(buckets)).cast("int")


def _last_states(txn: DataFrame | None, accounts: DataFrame) -> DataFrame:
    """(account, base, last_epoch) of the stored rows of some accounts."""
    if txn is None:
        return accounts.sparkSession.createDataFrame([], "account string, base long, last_epoch long")
    own = txn.join(accounts.select("account").distinct(), "account", "left_semi")
    return own.groupBy("account").agg(F.count(F.lit(1)).alias("base"), F.max("epoch").alias("last_epoch"))


def _written_parts(df: DataFrame, store: str, table: str, column: str) -> DataFrame:
    """``df`` as new data folders, one per value of the integer ``column``: (table, part, path)."""
    spark = df.sparkSession
    folder = f"{store}/data/{table}-{uuid.uuid4().hex}"
    df.repartition(column).write.mode("errorifexists").partitionBy(column).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder).select(column).distinct().select(
        F.lit(table).alias("table"), F.col(column).cast("string").alias("part"), F.concat(F.lit(f"{folder}/{column}="), F.col(column)).alias("path"))


def refresh_ledger(spark: SparkSession, src_root: str, accounts: DataFrame, mapping: AccountMapping,
                   store_root: str, prefix: str = "ledger", buckets: int = 1024, formats=None,
                   account_formats: dict[str, str] | None = None) -> RefreshResult:
    """Bring the store under ``store_root`` up to date and publish it as one new version.

    Tables ``txn``, ``derived``, ``entries`` and ``unaccounted`` are read by ``stored_table`` (or, in this session, as
    the temporary views ``{prefix}_txn`` and so on).

    * An account that only gained files, all of whose rows are later than its stored ones, is *extended*: just the
      new files are read, their rows continue the stored positions, and a new folder joins its bucket.
    * Any other change *rebuilds* the account from its own files; its bucket's folder is written anew from the stored
      rows of the other accounts and the new ones.  Other buckets are not touched.
    * Stale derived accounts are built anew, entries and the unaccounted list when the ledger's key moved.

    Nothing is visible before the commit: when a step fails, or another refresh committed first
    (``ConcurrentRefresh``), the store stays at its old version and keys.  ``formats`` and ``account_formats`` are those
    of ``read_account_folders``."""
    log = ManifestLog(spark, store_root)
    base = log.snapshot()
    store = log.root
    # Listed once: the folders may change while we run, and the version must record exactly what was built.
    listed = materialize(folder_files(spark, src_root).join(accounts.select(F.col("name").alias("account")), "account", "left_semi"), "files")
    sk = materialize(source_keys(accounts, fingerprints(listed)), "keys")
    stale = materialize(stale_objects(sk, base.keys).select("account"), "stale")
    removed = materialize(base.files.select("account").distinct().join(sk.select("account"), "account", "left_anti"), "removed")
    nobody = spark.createDataFrame([], "account string")
    rebuilt, extended, parts = nobody, nobody, base.parts
    txn_parts = parts.where("table = 'txn'")
    if not (stale.isEmpty() and removed.isEmpty()):
        rebuilt, extended, txn_parts = _new_txn_parts(base, store, listed, stale, removed, buckets, formats, account_formats)
    txn = _read_parts(txn_parts, TXN_COLUMNS)
    if txn is None:
        txn = identify(spark.createDataFrame([], RAW_SCHEMA))

    dk = derived_keys(spark, mapping, sk)
    dk = spark.createDataFrame(dk.collect(), "object_name string, account string, fingerprint string")
    stale_der = [r["account"] for r in stale_objects(dk, base.keys).collect()]  # names of the rule file
    der_parts = parts.where("table = 'derived'")
    if stale_der:
        d = rule_ops.derived_transactions(txn, mapping.derived, only=set(stale_der))
        number = {r.name: i for i, r in enumerate(mapping.derived)}
        made = _written_parts(d.withColumn("rule", F.col("rule_no")), store, "derived", "rule")
        named = spark.createDataFrame([(str(i), n) for n, i in number.items()], "part string, name string")
        der_parts = der_parts.where(~F.col("part").isin(stale_der)).unionByName(
            made.join(named, "part").select("table", F.col("name").alias("part"), "path"))
    der_parts = materialize(der_parts.where(F.col("part").isin([r.name for r in mapping.derived])), "parts")
    derived = _read_parts(der_parts, DERIVED_COLUMNS)
    if derived is None:
        derived = rule_ops.derived_transactions(txn.where("false"), mapping.derived)

    mappings_df = mappings_frame(spark, mapping.transfers)
    lk = ledger_key(spark, mapping, sk, mappings_df)
    lk = spark.createDataFrame(lk.collect(), "object_name string, account string, fingerprint string")
    ledger_stale = not stale_objects(lk, base.keys).isEmpty() or not base.has("entries")
    rest = parts.where("table in ('entries', 'unaccounted')")
    if ledger_stale:
        paths = {t: f"{store}/data/{t}-{uuid.uuid4().hex}" for t in ("entries", "unaccounted")}
        ledger_ops.ledger_entries(rule_ops.derived_entries(derived), transfer_ops.transfer_entries(
            transfer_ops.transfer_matches(txn, mappings_df))).write.parquet(paths["entries"])
        ledger_ops.unaccounted(txn, spark.read.parquet(paths["entries"])).write.parquet(paths["unaccounted"])
        rest = spark.createDataFrame([(t, "0", p) for t, p in paths.items()], PARTS)

    version = log.commit(base, sk.select("object_name", "fingerprint").unionByName(dk.select("object_name", "fingerprint"))
                         .unionByName(lk.select("object_name", "fingerprint")), listed,
                         txn_parts.unionByName(der_parts.select("table", "part", "path")).unionByName(rest.select("table", "part", "path")))
    for t in TABLES:
        stored_table(spark, store_root, t).createOrReplaceTempView(f"{prefix}_{t}")
    action = lambda df, a: df.select("account", F.lit(a).alias("action"))
    changed = action(rebuilt, "rebuilt").unionByName(action(extended, "extended")).unionByName(action(removed, "removed"))
    return RefreshResult(changed, sorted(stale_der), ledger_stale, version)


TABLES = ("txn", "derived", "entries", "unaccounted")


def _read_parts(parts: DataFrame, columns) -> DataFrame | None:
    paths = [r["path"] for r in parts.select("path").distinct().collect()]  # folders: at most buckets x refreshes
    return parts.sparkSession.read.parquet(*paths).select(*columns) if paths else None


def _new_txn_parts(base, store: str, listed: DataFrame, stale: DataFrame, removed: DataFrame, buckets: int, formats, account_formats):
    """(rebuilt accounts, extended accounts, the folders of ``txn``) for stale and removed accounts."""
    spark = listed.sparkSession
    bucket = account_bucket(F.col("account"), buckets)
    nobody = spark.createDataFrame([], "account string")
    readable = listed.where(F.col("rel").rlike(r"^[^/]+/[^/]+\.csv$"))

    def rows_of(files: DataFrame, some: DataFrame) -> DataFrame:
        return read_files(spark, with_formats(files.join(some.select("account").distinct(), "account", "left_semi"), account_formats), formats)

    # accounts that only gained files, against those with a file that changed or went, or without a recorded key
    same = ["account", "rel", "mtime", "length"]
    recorded = base.keys.where("object_name like 'source:%'").select(F.expr("substr(object_name, 8)").alias("account"))
    lost = base.files.join(listed.select(*same), same, "left_anti").select("account")
    maybe = materialize(stale.join(recorded, "account", "left_semi").join(lost, "account", "left_anti").select("account"), "gained")
    extended, more = nobody, None
    if not maybe.isEmpty():
        gained = readable.join(base.files.select(*same), same, "left_anti")
        new_raw = materialize(rows_of(gained, maybe), "new-rows")
        states = _last_states(base.table("txn"), maybe)
        early = valid_raw(new_raw).groupBy("account").agg(F.min("epoch").alias("first")).join(states, "account").where("first <= last_epoch")
        extended = materialize(maybe.join(early.select("account"), "account", "left_anti"), "extended")
        more = identify(new_raw.join(extended, "account", "left_semi"), bases=states).withColumn("bucket", bucket)
    rebuilt = materialize(stale.select("account").join(extended, "account", "left_anti"), "rebuilt")
    gone = rebuilt.unionByName(removed).select("account", bucket.alias("bucket"))
    if gone.isEmpty():
        return rebuilt, extended, materialize(base.parts.where("table = 'txn'").unionByName(_written_parts(more, store, "txn", "bucket")), "parts")

    # rewritten buckets: the other accounts' stored rows, the rebuilt ones and what extends an account beside them
    touched = gone.select("bucket").distinct()
    fresh = identify(rows_of(readable, rebuilt)).withColumn("bucket", bucket)
    held = base.table("txn", touched.select(F.col("bucket").cast("string").alias("part")))
    if held is not None:
        fresh = fresh.unionByName(held.select(*TXN_COLUMNS).join(gone.select("account"), "account", "left_anti").withColumn("bucket", bucket))
    made = []
    if more is not None:
        fresh = fresh.unionByName(more.join(touched, "bucket", "left_semi").select(*fresh.columns))
        made.append(_written_parts(more.join(touched, "bucket", "left_anti"), store, "txn", "bucket"))
    made.append(_written_parts(fresh, store, "txn", "bucket"))
    kept = base.parts.where("table = 'txn'").join(touched.select(F.col("bucket").cast("string").alias("part")), "part", "left_anti")
    out = kept.select("table", "part", "path")
    for m in made:
        out = out.unionByName(m)
    return rebuilt, extended, materialize(out, "parts")


def stored_table(spark: SparkSession, store_root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the newest (or a given) version of a store; an empty frame when that version has no row of it."""
    found = ManifestLog(spark, store_root).snapshot(version).table(table)
    return spark.createDataFrame([], "empty string") if found is None else found
