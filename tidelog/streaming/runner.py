"""Micro-batches: transform, route, cut at schema changes, apply, record.

Delivery is at least once and the effect is once: a table's version carries the batch that made
it, and writes go by key.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import last_writes, split_key_changes
from ..operators.changelog import read_changes
from ..operators.transform import apply_rule
from ..plans import ddl
from ..plans.evolve import Applied, Policy, Refused, SchemaChangeError, evolve_state, plan_change, sink_outcome
from ..plans.schema import Column, Table
from ..plans.selector import Rule
from .tables import DELETED, Draft, VersionedTable

log = logging.getLogger("tidelog")


@dataclass
class Stats:
    """Totals, and what changed since the last report."""

    batches: int = 0
    rows: int = 0
    skipped: int = 0
    started: float = field(default_factory=time.time)
    _last: tuple[float, int] = (0.0, 0)

    def add(self, rows: int) -> None:
        self.batches += 1
        self.rows += rows

    def report(self) -> dict:
        now = time.time()
        then, before = self._last if self._last[0] else (self.started, 0)
        self._last = (now, self.rows)
        seconds = max(now - then, 1e-9)
        return {"batches": self.batches, "skipped": self.skipped, "rows": self.rows, "delta": self.rows - before, "rows_per_s": (self.rows - before) / seconds}


def segments(batch: DataFrame) -> Iterator[tuple[DataFrame, dict | None]]:
    """The batch cut at its schema changes: rows before each one, then its statement (``seq, ddl, source_db, source_table, source_ts_ms``).

    Only the statements, which are few, reach the driver.
    """
    statements = batch.where("op = 'ddl'").select("seq", "ddl", *(c for c in ("source_db", "source_table", "source_ts_ms") if c in batch.columns)).orderBy("seq").collect()
    low = None
    for row in statements:
        part = batch.where((F.col("op") != "ddl") & (F.col("seq") < row["seq"]))
        yield (part if low is None else part.where(F.col("seq") > low)), row.asDict()
        low = row["seq"]
    rest = batch.where("op != 'ddl'")
    yield (rest if low is None else rest.where(F.col("seq") > low)), None


@dataclass
class TableApplier:
    """One captured table: its rule, keys and state, and what schema changes may do."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    rule: Rule | None = None
    table: Table | None = None
    policy: Policy = field(default_factory=lambda: Policy("mysql"))
    definitions: Callable[[ddl.Change], dict[str, Column]] = lambda change: {}
    stats: Stats = field(default_factory=Stats)

    def __post_init__(self) -> None:
        self.state = VersionedTable(self.spark, self.path, self.keys)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch; a batch that was applied before is passed over."""
        done = self.state.batch()
        if done is not None and batch_id <= done:
            self.stats.skipped += 1
            return
        batch = batch.persist()
        try:
            draft = self.state.begin(batch_id)
            for rows, statement in segments(batch):
                out = apply_rule(rows, self.rule)
                if self.keys:
                    last = last_writes(split_key_changes(out.select("op", "before", "after", "seq"), self.keys), self.keys).select("row.*", F.col("deleted").alias(DELETED))
                else:
                    last = out.where("op in ('r', 'c', 'u')").select("after.*", F.lit(False).alias(DELETED))
                draft.append(last)
                if statement is not None:
                    self._change(draft, statement["ddl"])
            draft.publish()
            self.stats.add(batch.count())
            log.info("batch %s: %s", batch_id, self.stats.report())
        finally:
            batch.unpersist()

    def _change(self, draft: Draft, statement: str) -> None:
        change = ddl.classify(statement)
        outcome = sink_outcome(change, self.policy, self.rule.columns if self.rule else ())
        if outcome.verb == "fail":
            raise SchemaChangeError(f"{statement}: {outcome.reason}")
        if outcome.verb != "execute":
            return
        if change.action in (ddl.TRUNCATE, ddl.DROP_TABLE):
            draft.truncate()
            return
        plan = plan_change(self.table, change, self.definitions(change))
        if isinstance(plan, Refused):
            raise SchemaChangeError(f"{statement}: {plan.reason}")
        if isinstance(plan, Applied):
            draft.replace(evolve_state(draft.read(), change, plan.table))
            self.table = plan.table


def change_stream(spark: SparkSession, folder: str, columns: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Change records that arrive as JSON-lines files; ``columns`` are the images'."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return read_changes(lines, columns)


def start(changes: DataFrame, applier: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run the changes through the applier: all that is there now, or on and on every ``interval``.

    Stopping ends after the current batch; a restart goes on from the checkpoint.
    """
    writer = changes.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
