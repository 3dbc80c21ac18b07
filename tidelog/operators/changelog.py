"""The change log: snapshot rows and row changes as one DataFrame.

Columns: ``op`` (``r`` snapshot, ``c`` insert, ``u`` update, ``d`` delete), ``before`` and ``after``
(structs of the table's columns), ``seq`` (total order of the changes of a table; snapshot rows are
0), ``source_ts_ms``, ``source_db``, ``source_table``.  Rows carry no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("r", "c", "u", "d")
META = ("op", "before", "after", "seq", "source_ts_ms", "source_db", "source_table")


def image_type(log: DataFrame, image: str = "after") -> T.StructType:
    return log.schema[image].dataType


def image(columns: list[str], values: dict[str, Column] | None = None) -> Column:
    """A struct of columns, some of them replaced."""
    values = values or {}
    return F.struct(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in columns))


def snapshot(table: DataFrame, database: str, name: str) -> DataFrame:
    """A table's rows as ``r`` events with seq 0: any change wins over them."""
    after = image(table.columns)
    return table.select(
        F.lit("r").alias("op"), F.lit(None).cast(after_type(table)).alias("before"), after.alias("after"), F.lit(0).cast("long").alias("seq"),
        F.lit(None).cast("long").alias("source_ts_ms"), F.lit(database).alias("source_db"), F.lit(name).alias("source_table"),
    )


def after_type(table: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])


def changes(rows: DataFrame, op: Column, before: Column | None, after: Column | None, seq: Column, database: str, name: str, kind: T.StructType, source_ts_ms: Column | None = None) -> DataFrame:
    """Rows as change events; ``before`` and ``after`` are structs, or None."""
    null = F.lit(None).cast(kind)
    return rows.select(
        op.alias("op"), (null if before is None else before.cast(kind)).alias("before"), (null if after is None else after.cast(kind)).alias("after"), seq.cast("long").alias("seq"),
        (F.lit(None) if source_ts_ms is None else source_ts_ms).cast("long").alias("source_ts_ms"), F.lit(database).alias("source_db"), F.lit(name).alias("source_table"),
    )


def read_changes(log: DataFrame, columns: T.StructType) -> DataFrame:
    """JSON change records (``op, before, after, seq, source``) as a change log.

    ``log`` has one text column ``value``, from files or a stream; this is stateless and
    works on both.  Event time 0 means unknown and becomes null.
    """
    source = T.StructType([T.StructField("db", T.StringType()), T.StructField("table", T.StringType()), T.StructField("ts_ms", T.LongType())])
    record = T.StructType([T.StructField("op", T.StringType()), T.StructField("before", columns), T.StructField("after", columns), T.StructField("seq", T.LongType()), T.StructField("ddl", T.StringType()), T.StructField("source", source)])
    r = log.select(F.from_json("value", record).alias("r"))
    return r.select(
        "r.op", "r.before", "r.after", "r.seq", F.when(F.col("r.source.ts_ms") != 0, F.col("r.source.ts_ms")).alias("source_ts_ms"),
        F.col("r.source.db").alias("source_db"), F.col("r.source.table").alias("source_table"), "r.ddl",
    )
