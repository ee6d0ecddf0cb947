"""Named tables: S10-S16 on the Spark catalog (the reference's JSON/SQLite object store).

Ledger tables are partitioned by account so a refresh can replace one account (dynamic partition
overwrite) without touching the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_stored(spark: SparkSession, name: str) -> bool:
    """S13."""
    return spark.catalog.tableExists(name)


def store(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> bool:
    """Create a new table; False when it exists already or the write fails."""
    if is_stored(df.sparkSession, name):
        return False
    try:
        w = df.write.mode("errorifexists").format("parquet")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.saveAsTable(name)
        return True
    except Exception:  # noqa: BLE001 - the reference reports failure as False
        return False


def update(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table if present, else store it.  The new data must not be read from
    the same table (write a new table or version instead)."""
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def replace_partitions(df: DataFrame, name: str, partition_by: Sequence[str]) -> None:
    """S11 for one or a few accounts: dynamic partition overwrite replaces only the partitions
    present in ``df`` (columns must be in table order, partition columns last)."""
    spark = df.sparkSession
    if not is_stored(spark, name):
        update(df, name, partition_by)
        return
    cols = spark.table(name).columns
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*cols).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def drop_partitions(spark: SparkSession, name: str, column: str, values: Sequence[str]) -> None:
    """Delete accounts that became empty or left the configuration (dynamic overwrite keeps
    partitions absent from the new data, so removal is explicit)."""
    for v in values:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({column} = :v)", args={"v": v})


def retrieve(spark: SparkSession, name: str) -> DataFrame | None:
    """The whole table; None when it cannot be read."""
    try:
        return spark.table(name)
    except Exception:  # noqa: BLE001
        return None


def drop(spark: SparkSession, name: str) -> bool:
    """True only if the table existed."""
    if not is_stored(spark, name):
        return False
    spark.sql(f"DROP TABLE {name}")
    return True


def stored_names(spark: SparkSession, database: str | None = None) -> list[str]:
    """S15 over the catalog: sorted table names."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL over the stored tables, values passed as parameters."""
    return spark.sql(sql, args=args or {})


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """An order- and partitioning-free fingerprint of a frame: row count and two sums of
    per-row 64-bit hashes (exact as DECIMAL(38,0)); one pre-aggregated row, no sort."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("xx_sum"),
        F.sum(F.hash(row).cast("decimal(38,0)")).alias("mm_sum"),
    ).select(F.sha2(F.concat_ws("|", "n_rows", F.coalesce(F.col("xx_sum").cast("string"), F.lit("0")),
                                F.coalesce(F.col("mm_sum").cast("string"), F.lit("0"))), 256).alias("fingerprint"))
