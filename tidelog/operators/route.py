"""Fan-out of a change log to sink tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selector import Route, resolve_routes


def route_table(log: DataFrame, routes: list[Route], database: str, table: str, first_only: bool = False) -> DataFrame:
    """One table's log with ``sink_db, sink_table, routed``: a copy of each row per matching rule.

    The targets are literals that the driver worked out; without a rule the source's names stay.
    """
    targets = resolve_routes(routes, database, table, first_only)
    column = F.array(*(F.struct(F.lit(d).alias("sink_db"), F.lit(t).alias("sink_table"), F.lit(r).alias("routed")) for d, t, r in targets))
    if len(targets) == 1:
        d, t, r = targets[0]
        return log.withColumns({"sink_db": F.lit(d), "sink_table": F.lit(t), "routed": F.lit(r)})
    return log.withColumn("__to", F.explode(column)).select(*log.columns, "__to.*")


def route_mixed(log: DataFrame, routes: list[Route], tables: list[tuple[str, str]], first_only: bool = False) -> DataFrame:
    """A log of many tables.  ``tables`` are those it may hold (the catalog's, so few and known);
    their targets are looked up in a map literal, with no join and no regex per row."""
    kind = "array<struct<sink_db:string,sink_table:string,routed:boolean>>"
    pairs: list[Column] = []
    for database, table in sorted(set(tables)):
        targets = resolve_routes(routes, database, table, first_only)
        if targets[0][2]:
            pairs += [F.lit(f"{database}.{table}"), F.array(*(F.struct(F.lit(d).alias("sink_db"), F.lit(t).alias("sink_table"), F.lit(r).alias("routed")) for d, t, r in targets))]
    own = F.array(F.struct(F.col("source_db").alias("sink_db"), F.col("source_table").alias("sink_table"), F.lit(False).alias("routed"))).cast(kind)
    known = F.create_map(*pairs)[F.concat_ws(".", "source_db", "source_table")].cast(kind) if pairs else F.lit(None).cast(kind)
    return log.withColumn("__to", F.explode(F.coalesce(known, own))).select(*log.columns, "__to.*")
