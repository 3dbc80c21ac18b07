"""Snapshots: splits of a table by key, start positions, and tables added later."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that one task orders when splits are planned: about 130 MB of its memory.
BLOCK_KEYS = 1_000_000


def plan_splits(table: DataFrame, key: str, chunk_size: int, unique: bool = False, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``split_id, low, high``: ranges ``[low, high)`` of the key, the last without ``high``.

    The lows are the keys at every (``chunk_size`` - 1)th place; an empty table has no split.  Only
    the key column is read.  Only the lows (one in ``chunk_size``) meet, each with the one before.  ``unique`` keys (a
    primary key of one column) need no distinct.
    """
    step = chunk_size - 1
    keys = table.select(F.col(f"`{key}`").alias("k")).where("k is not null")
    if step < 1:
        if keys.isEmpty():
            return keys.select(F.lit(0).alias("split_id"), F.col("k").alias("low"), F.col("k").alias("high")).limit(0)
        raise ValueError("chunk size 1 cannot advance over a table")
    lows = _places(keys, unique, block_keys).where(F.col("place") % step == 0).select((F.col("place") / step).cast("long").alias("split_id"), "k")
    ends = lows.select("k", "split_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    of = lambda back: F.max(F.when(F.col("back") == back, F.col("k")))
    return ends.groupBy((F.col("split_id") - F.col("back")).alias("split_id")).agg(of(0).alias("low"), of(1).alias("high")).where("split_id >= 0")


def _places(keys: DataFrame, unique: bool, block_keys: int) -> DataFrame:
    """``k, place``: the distinct keys with their places in order, from 0.

    Ranges of the keys, as many as their number asks for, get a task each, which sorts about ``block_keys`` and counts on from the
    ranges before.  A range's edges are found once, so a lost executor numbers its keys as before.
    """
    edges = _edges(keys, n) if (n := math.ceil(keys.count() / block_keys)) > 1 else []
    block = _block(edges)
    keys = keys if unique else keys.distinct()
    sizes = {r["b"]: r["n"] for r in keys.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}
    starts = [0, *accumulate(sizes.get(b, 0) for b in range(len(edges)))]
    sorted_keys = keys.withColumn("block", block).repartitionById(len(starts), "block").sortWithinPartitions("k")
    # the id's lower 33 bits count the rows of a task
    in_block = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_keys.select("k", (in_block + F.get(F.lit(starts).cast("array<bigint>"), F.col("block"))).alias("place"))


def _block(edges: list) -> Column:
    """The number of edges at or below the key ``k``: a look at every so-manieth edge, then at those between."""
    below = lambda some: F.size(F.filter(some, lambda e: e <= F.col("k")))
    if len(edges) <= 64:
        return below(F.array(*map(F.lit, edges))) if edges else F.lit(0)
    step = math.isqrt(len(edges))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    coarse = below(F.array(*(F.lit(g[0]) for g in groups)))
    fine = below(F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(coarse, F.lit(1))))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def _edges(keys: DataFrame, blocks: int) -> list:
    """Keys that part the others into about equal ranges, from a sketch (numbers) or a sample (other types)."""
    kind = keys.schema["k"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        found = keys.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    else:
        some = sorted(r["k"] for r in keys.where(F.rand(7) < min(1.0, 100 * blocks / max(1, keys.count()))).collect() if r["k"] == r["k"])
        found = some[:: max(1, len(some) // blocks)][1:]
    return sorted(set(found))


def split_predicate(key: str, low: object, high: object) -> Column:
    """One split as a condition that the scan prunes by; null bounds are open."""
    k = F.col(f"`{key}`")
    out = F.lit(True) if low is None else k >= F.lit(low)
    return out if high is None else out & (k < F.lit(high))


def jdbc_predicates(key: str, splits: Iterable[tuple[object, object]], quote: str = "`") -> list[str]:
    """Splits as texts for ``spark.read.jdbc(predicates=...)``, one partition each."""

    def literal(x: object) -> str:
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    name = f"{quote}{key.replace(quote, quote * 2)}{quote}"
    out = []
    for low, high in splits:
        parts = ([] if low in (None, "") else [f"{name} >= {literal(low)}"]) + ([] if high is None else [f"{name} < {literal(high)}"])
        out.append(" AND ".join(parts) or "1 = 1")
    return out


def unfinished(splits: DataFrame, finished: list[tuple[object, object]]) -> DataFrame:
    """Splits that aren't done yet, by exact equality of both bounds.  ``finished`` is the state's list."""
    if not finished:
        return splits
    done = splits.sparkSession.createDataFrame(finished, splits.select("low", "high").schema)
    return splits.alias("s").join(done.alias("d"), F.col("s.low").eqNullSafe(F.col("d.low")) & F.col("s.high").eqNullSafe(F.col("d.high")), "left_anti")


@dataclass(frozen=True)
class Startup:
    """Where a change log is read from."""

    mode: str = "initial"  # initial, snapshot, earliest, latest, specific-offset, timestamp
    seq: int | None = None
    timestamp_ms: int | None = None
    skip_rows: int = 0
    skip_events: int = 0

    @property
    def reads_snapshot(self) -> bool:
        return self.mode in ("initial", "snapshot")

    @property
    def reads_changes(self) -> bool:
        return self.mode != "snapshot"


def from_start(changes: DataFrame, start: Startup, low_watermark: int = 0) -> DataFrame:
    """The changes a start mode reads.

    ``initial`` replays from the position noted before the snapshot, so what both hold
    converges by key; ``latest`` starts behind it.  A timestamp counts whole seconds; events of
    unknown time are before it.  ``skip_events`` passes over the first events by ``seq``, ``skip_rows`` over
    the first row changes: the bound is found by a top-n, which each task cuts down by itself.
    """
    if not start.reads_changes:
        return changes.limit(0)
    if start.mode == "initial":
        changes = changes.where(F.col("seq") > low_watermark)
    elif start.mode == "latest":
        changes = changes.where(F.col("seq") > low_watermark)
    elif start.mode == "specific-offset":
        changes = changes.where(F.col("seq") >= start.seq)
    elif start.mode == "timestamp":
        changes = changes.where(F.col("source_ts_ms") >= start.timestamp_ms // 1000 * 1000)
    changes = _behind_first(changes, changes, start.skip_events)
    return _behind_first(changes, changes.where("op != 'ddl'"), start.skip_rows)


def _behind_first(changes: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """Changes behind the first n of ``counted``; the bound is one row, so it can be broadcast."""
    if not n:
        return changes
    bound = counted.select("seq").orderBy("seq").limit(n).agg(F.max("seq").alias("bound"))
    return changes.join(F.broadcast(bound)).where(F.col("bound").isNull() | (F.col("seq") > F.col("bound"))).select(*changes.columns)


def without_replays(changes: DataFrame) -> DataFrame:
    """Each change once, though a source sent it again after a restart."""
    return changes.dropDuplicates(["source_db", "source_table", "seq"])


def without_ddl(changes: DataFrame, schema_change: bool) -> DataFrame:
    """The source's switch: statements are dropped where schema changes are off."""
    return changes if schema_change else changes.where("op != 'ddl'")


@dataclass(frozen=True)
class NewTables:
    """What happens to tables that match the selector but aren't in the saved state."""

    enabled: bool = False
    snapshot: bool = True
    follow_runtime: bool = False


def on_resume(selected: set[str], captured: set[str], excluded: set[str], flags: NewTables, mode: str = "initial", has_position: bool = True) -> dict[str, str]:
    """table -> ``live``, ``snapshot``, ``changes_only`` or ``ignored``."""
    out = {}
    for t in sorted(selected | captured):
        if t in captured:
            out[t] = "live"
        elif not has_position or mode != "initial":
            out[t] = "snapshot" if mode in ("initial", "snapshot") else "changes_only"
        elif not flags.enabled:
            out[t] = "ignored"
        else:
            out[t] = "snapshot" if flags.snapshot else "changes_only"
    return {t: "ignored" if t in excluded and t not in captured else x for t, x in out.items()}


def on_create(flags: NewTables) -> str:
    """What a CREATE TABLE seen at run time leads to: rows are followed without a backfill, or not."""
    return "follow" if flags.follow_runtime else "drop"


def backfill(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot rows under the changes that arrived meanwhile: their seq of 0 loses to any change."""
    return snapshots.unionByName(changes, allowMissingColumns=True)


def captured_only(changes: DataFrame, tables: Iterable[tuple[str, str]]) -> DataFrame:
    """Changes of captured tables."""
    names = [f"{d}.{t}" for d, t in tables]
    return changes.where(F.concat_ws(".", "source_db", "source_table").isin(names))
