"""Checksums and differences of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(table: DataFrame, key: str, column: str) -> DataFrame:
    """Rows, sum of the key, and sum of the first 32 bits of the MD5 of a column's text.

    Sums are exact decimals, so the result doesn't depend on order or partitions.
    """
    part = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("decimal(20,0)")
    return table.agg(F.count("*").alias("n_rows"), F.sum(F.col(f"`{key}`").cast("decimal(38,0)")).cast("string").alias("sum_key"), F.sum(part).cast("string").alias("sum_hash"))


def crc_checksum(table: DataFrame, key: str, column: str) -> DataFrame:
    """The same with CRC32, null texts passed over."""
    return table.agg(F.count("*").alias("n_rows"), F.sum(F.col(f"`{key}`").cast("decimal(38,0)")).alias("sum_key"), F.sum(F.crc32(F.col(f"`{column}`").cast("string").cast("binary")).cast("decimal(38,0)")).alias("sum_crc"))


def differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose rows differ, with ``side``: ``left_only``, ``right_only`` or ``changed``."""
    others = [c for c in left.columns if c not in keys]
    a, b = (t.select(*keys, F.struct(*others).alias(x), F.lit(True).alias(f"in_{x}")) for t, x in ((left, "a"), (right.select(*left.columns), "b")))
    both = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, side.alias("side")).where("side is not null")
