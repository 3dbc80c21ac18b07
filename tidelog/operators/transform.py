"""Filter, projection and keys of one table's change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import compile_filter, parse_filter, struct_lookup
from ..plans.schema import SchemaError
from ..plans.selector import ConfigError, Rule, compile_pattern, split_list
from .changelog import image_type


def compile_rule(source: str, projection: str = "", filter_text: str = "", primary_keys: str = "") -> Rule:
    """A rule from its texts; ``*`` or nothing keeps all columns, and ``*`` stands alone."""
    columns = split_list(projection)
    if "*" in columns:
        if len(columns) > 1:
            raise ConfigError("transform.projection", "* can't be mixed with names")
        columns = []
    return Rule(compile_pattern("transform.source-table", source), tuple(columns), parse_filter(filter_text) if filter_text.strip() else None, tuple(split_list(primary_keys)))


def rewrite_ops(log: DataFrame, rule_filter: object) -> DataFrame:
    """The log under a filter that both images are held against.

    An update that leaves the filter becomes a delete of its before image, one that enters it a create
    of its after image; what is outside on both sides goes.  Stateless: the same in batch and
    stream, and one codegen stage without a shuffle.
    """
    if rule_filter is None:
        return log
    kind = image_type(log)
    hit = {x: F.col(x).isNotNull() & compile_filter(rule_filter, struct_lookup(kind, x)) for x in ("before", "after")}
    op = F.col("op")
    new = (
        F.when(op.isin("r", "c") & F.col("__a"), op)
        .when((op == "d") & F.col("__b"), op)
        .when((op == "u") & F.col("__b"), F.when(F.col("__a"), F.lit("u")).otherwise(F.lit("d")))
        .when((op == "u") & F.col("__a"), F.lit("c"))
        .when(op == "ddl", op)
    )
    marked = log.withColumns({"__b": hit["before"], "__a": hit["after"]}).withColumn("__op", new).where("__op is not null")
    turned = (op == "u") & (F.col("__op") != "u")
    out = {"before": F.when(~(turned & (F.col("__op") == "c")), F.col("before")), "after": F.when(~(turned & (F.col("__op") == "d")), F.col("after")), "op": F.col("__op")}
    return marked.select(*(out[c].alias(c) if c in out else F.col(c) for c in log.columns))


def project(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Both images reduced to the named columns, in that order and spelling."""
    if not columns:
        return log
    kind = image_type(log)
    missing = [c for c in columns if struct_lookup(kind)(c) is None]
    if missing:
        raise SchemaError(f"projected column {missing[0]} does not exist")

    def reduced(side: str):
        find = struct_lookup(kind, side)
        return F.when(F.col(side).isNotNull(), F.struct(*(find(c)[0].alias(c) for c in columns)))

    return log.withColumns({"before": reduced("before"), "after": reduced("after")})


def apply_rule(log: DataFrame, rule: Rule | None) -> DataFrame:
    """Filter on whole images first, then projection; no rule keeps everything."""
    return log if rule is None else project(rewrite_ops(log, rule.filter), rule.columns)


def snapshot_table(table: DataFrame, rule: Rule | None) -> DataFrame:
    """The rule on a plain table: rows inside the filter, projected.  Both reach the scan."""
    if rule is None:
        return table
    if rule.filter is not None:
        table = table.where(compile_filter(rule.filter, struct_lookup(table.schema)))
    if not rule.columns:
        return table
    find = struct_lookup(T.StructType(list(table.schema)))
    missing = [c for c in rule.columns if find(c) is None]
    if missing:
        raise SchemaError(f"projected column {missing[0]} does not exist")
    return table.select(*(find(c)[0].alias(c) for c in rule.columns))
