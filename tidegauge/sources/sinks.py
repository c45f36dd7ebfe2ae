"""Writers: products, month partitions, write-once slots, publish-if-changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage


def land_readings(readings: DataFrame, path: str) -> None:
    """Keep the archive as a table partitioned by snapshot date, so products prune by day; landing a day again replaces it."""
    (readings.hint("rebalance", "snap_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snap_date").parquet(path))


def write_product(df: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """One product, one table."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_months(df: DataFrame, path: str, *, month: str = "month") -> None:
    """Replace only the months present in `df`; adaptive rebalancing gathers small months and splits big ones."""
    (df.hint("rebalance", month).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path))


def append_new_slots(df: DataFrame, path: str, *, slot: list[str]) -> None:
    """Write-once: rows of slots already on record are left out.

    A slot is a partition under ``data`` and, once it is written, a row of the record under ``slots``. An append
    looks up its slots in the record and reads no data. A slot that was written but never recorded, as after a
    failure, is written again in full.
    """
    spark = df.sparkSession
    fresh = df
    if table_exists(spark, f"{path}/slots"):
        fresh = df.join(spark.read.parquet(f"{path}/slots"), slot, "left_anti")
    new = cut_lineage(fresh.select(*slot).distinct())
    if new.isEmpty():
        return
    (df.join(new, slot, "left_semi").hint("rebalance", *slot).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*slot).parquet(f"{path}/data"))
    new.coalesce(1).write.mode("append").parquet(f"{path}/slots")


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """All recorded slots; partitions without a record are not read."""
    record = spark.read.parquet(f"{path}/slots")
    return spark.read.parquet(f"{path}/data").join(record, record.columns, "left_semi")


def fingerprint(df: DataFrame, *, ignore: tuple[str, ...] = ("generated",)) -> DataFrame:
    """Order-free digest of a table without its stamp columns: row count and two hash sums."""
    cols = sorted(c for c in df.columns if c not in ignore)
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                  F.sum(h.cast("decimal(38,0)")).alias("s"))


def publish_if_changed(df: DataFrame, path: str, *, ignore: tuple[str, ...] = ("generated",)) -> bool:
    """Overwrite the published table only if something besides the stamp moved."""
    spark = df.sparkSession
    if table_exists(spark, path):
        old, new = (fingerprint(x, ignore=ignore).first() for x in (spark.read.parquet(path), df))
        if old == new:
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def table_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False
