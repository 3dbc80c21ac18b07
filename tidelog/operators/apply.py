"""Current state: the last write of each key wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changelog import image_type

#: Place of a merged log's source table, if the log has it.
RANK = "rank"


def key_changed(keys: tuple[str, ...]) -> Column:
    """Whether an update moves its row to another key."""
    return reduce(lambda a, b: a | b, (~F.col(f"before.`{k}`").eqNullSafe(F.col(f"after.`{k}`")) for k in keys))


def split_key_changes(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Writes: ``row, deleted, seq, sub_seq`` (and ``rank``, if the log has it).  A changed key is a delete of the old, then a write of the new."""
    kind = image_type(log)
    write = lambda row, deleted, sub: F.struct(row.cast(kind).alias("row"), F.lit(deleted).alias("deleted"), F.lit(sub).alias("sub_seq"))
    after, before = write(F.col("after"), False, 1), write(F.col("before"), True, 0)
    writes = F.when(F.col("op") == "d", F.array(before)).when((F.col("op") == "u") & key_changed(keys), F.array(before, after)).otherwise(F.array(after))
    rank = [c for c in log.columns if c == RANK]
    return log.where("op in ('r', 'c', 'u', 'd')").select("seq", *rank, F.explode(writes).alias("w")).select("w.row", "w.deleted", "seq", "w.sub_seq", *rank)


def any_null(row: str, keys: tuple[str, ...]) -> Column:
    """Whether a key of the struct ``row`` is null."""
    return reduce(lambda a, b: a | b, (F.col(f"{row}.`{k}`").isNull() for k in keys))


def last_writes(writes: DataFrame, keys: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    """The last write of each key: one aggregation, combined before the shuffle.

    So a key with very many changes sends one row per task, and no key's changes are ever sorted.
    Sequence numbers lie below 2^62.  Where tables are merged, the one of the higher ``rank`` wins a tie.  A null key raises
    here, for batches, streams and writers alike: it would never meet its row again.  Where no key has many writes, ``tasks`` deals
    them out uncombined to so many tasks, whatever ``spark.sql.shuffle.partitions`` says.
    """
    writes = writes.where(F.when(any_null("row", keys), F.raise_error(F.lit("a key is null"))).otherwise(F.lit(True)))
    order = F.col("seq") * 2 + F.col("sub_seq")
    if RANK in writes.columns:
        order = F.struct(order, F.col(RANK))
    by = {f"__k{i}": F.col(f"row.`{k}`") for i, k in enumerate(keys)}
    writes = writes.withColumns(by)
    if tasks:
        writes = writes.repartition(tasks, *by)
    return writes.groupBy(*by).agg(F.max_by(F.struct("row", "deleted"), order).alias("w")).select("w.row", "w.deleted")


def null_keys(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events that write or delete by a key that is null."""
    return log.where((F.col("op").isin("r", "c", "u") & any_null("after", keys)) | (F.col("op").isin("d", "u") & any_null("before", keys) & F.col("before").isNotNull()))


def current_state(log: DataFrame, keys: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    """The table that the log leaves behind; ``tasks`` as in ``last_writes``.

    Without keys rows are appended, replays twice, and deletes can't be carried out.  A row that
    only has key columns needs nothing special.  A null key raises.
    """
    if not keys:
        bad = F.when(F.col("op") == "d", F.raise_error(F.lit("a table without keys has no key for delete")))
        return log.where(F.col("op").isin("r", "c", "u") | bad.isNotNull()).select("after.*")
    return last_writes(split_key_changes(log, keys), keys, tasks).where("not deleted").select("row.*")


def merge_state(base: DataFrame, log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``base`` after the log: rows of untouched keys, and what the log leaves of the touched ones.

    Only the log is aggregated; the base takes part in one anti-join by key.  Columns that the base
    lacks are null in its rows.
    """
    last = last_writes(split_key_changes(log, keys), keys)
    touched = last.select(*(F.col(f"row.`{k}`").alias(k) for k in keys))
    kept = base.join(touched, list(keys), "left_anti")
    return kept.unionByName(last.where("not deleted").select("row.*"), allowMissingColumns=True)


def coalesce_batches(log: DataFrame, keys: tuple[str, ...], batch: Column) -> DataFrame:
    """The last event of each key in each batch, with ``first_seq``, the place of the key's first."""
    by = [batch.alias("batch"), *(F.col(f"after.`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))]
    grouped = log.groupBy(*by).agg(F.max_by(F.struct(*log.columns), "seq").alias("e"), F.min("seq").alias("first_seq"))
    return grouped.select("batch", "first_seq", "e.*")


def doris_violations(log: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Events that a target without deletes and key changes refuses, each with a ``reason``."""
    missing = any_null("after", keys) if keys else F.lit(False)
    unknown = sorted(set(image_type(log).fieldNames()) - set(columns))
    reason = F.when(F.col("op") == "d", "delete is not supported").when(F.col("after").isNull(), "no after image")
    if not keys:
        reason = reason.otherwise("no key")
    else:
        reason = reason.when(missing, "key is missing or null")
        if unknown:
            reason = reason.otherwise(f"unknown column {unknown[0]}")
        else:
            reason = reason.when((F.col("op") == "u") & F.col("before").isNotNull() & key_changed(keys), "key changed")
    return log.withColumn("reason", reason).where("reason is not null")
