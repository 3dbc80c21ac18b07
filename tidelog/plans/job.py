"""A pipeline from its settings: captured tables through rules and routes into their sink tables.

A run reads snapshots of tables that have none yet, then the changes behind the saved positions, and writes each sink
table once: the logs of all source tables that are routed into it are one log.  Positions are saved after the writes, so a
run that fails is repeated from where the last one ended, and writes go by key.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import RANK
from ..operators.changelog import image_type, read_changes, snapshot
from ..operators.transform import apply_rule
from ..sinks.targets import SinkTable, Target, Transports, open_target
from ..sources.snapshot import NewTables, Startup, backfill, captured_only, from_start, on_create, on_resume, plan_splits, without_ddl, without_replays
from ..sources.tables import Source, selected
from ..streaming.runner import Stats, segments, start
from ..streaming.state import State, StateFile
from . import ddl
from .config import Pipeline
from .evolve import Policy, SchemaChangeError, sink_outcome
from .schema import Column, SchemaError, Table, chunk_column, project_table
from .selector import Rule, colliding_targets, match_rule, resolve_routes

log = logging.getLogger("tidelog")

#: Splits of a snapshot that are read and written at once; after each such wave they count as finished.
WAVE = 1024
LOG_COLUMNS = ("op", "before", "after", "seq", "source_ts_ms", "source_db", "source_table")


@dataclass(frozen=True)
class Captured:
    """A source table, its rule, and what the rule leaves of it."""

    database: str
    name: str
    rule: Rule | None
    table: Table

    @property
    def id(self) -> str:
        return f"{self.database}.{self.name}"


WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds values of both as they are; None if there is none."""
    if a == b:
        return a
    if a in WIDER and b in WIDER:
        return max(a, b, key=WIDER.index)
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else None
    if {type(a), type(b)} == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    return None


def common_image(sink: str, kinds: list[T.StructType]) -> T.StructType:
    """Columns of all images, by name without case, in order of appearance; a column that a table lacks is null."""
    out: dict[str, T.StructField] = {}
    for kind in kinds:
        for f in kind:
            known = out.get(f.name.casefold())
            wide = f.dataType if known is None else common_type(known.dataType, f.dataType)
            if wide is None:
                raise SchemaError(f"{sink}: column {f.name} is {known.dataType.simpleString()} in one table and {f.dataType.simpleString()} in another")
            out[f.name.casefold()] = T.StructField(known.name if known else f.name, wide)
    return T.StructType(list(out.values()))


def as_image(side: str, have: T.StructType, want: T.StructType) -> F.Column:
    names = {n.casefold(): n for n in have.names}
    fields = [(F.col(f"{side}.`{names[f.name.casefold()]}`") if f.name.casefold() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    return F.when(F.col(side).isNotNull(), F.struct(*fields))


def one_log(own: SinkTable, logs: list[DataFrame]) -> DataFrame:
    """The logs of a sink table's sources as one, under its name.  Rows of one key and ``seq`` go to the later source."""
    want = common_image(own.id, [image_type(x) for x in logs])
    parts = []
    for rank, part in enumerate(logs):
        have = image_type(part)
        images = {s: as_image(s, have, want) for s in ("before", "after")} if len(logs) > 1 else {}
        more = [] if "ddl" in part.columns else [F.lit(None).cast("string").alias("ddl")]
        out = part.select(*(images.get(c, F.col(c)).alias(c) for c in LOG_COLUMNS), *(["ddl"] if not more else more))
        parts.append(out.withColumn(RANK, F.lit(rank)) if len(logs) > 1 else out)
    merged = reduce(DataFrame.unionByName, parts)
    return merged.withColumns({"sink_db": F.lit(own.database), "sink_table": F.lit(own.name), "routed": F.lit(own.routed)})


def merged_table(database: str, name: str, tables: list[Table]) -> Table:
    """What a sink table holds; its sources must agree on the keys."""
    first = tables[0]
    keys = {tuple(k.casefold() for k in t.primary_keys) for t in tables}
    if len(keys) > 1:
        raise SchemaError(f"{database}.{name}: its source tables have different keys")
    columns: dict[str, Column] = {}
    for t in tables:
        for c in t.columns:
            columns.setdefault(c.name.casefold(), c)
    lacking = {n for n in columns for t in tables if t.column(n) is None}
    own = tuple(replace(c, nullable=True) if n in lacking else c for n, c in columns.items())
    return replace(first, database=database, table=name, columns=own)


class Job:
    def __init__(self, spark: SparkSession, pipeline: Pipeline, source: Source, folder: str = "", transports: Transports | None = None, wave: int = WAVE):
        self.spark, self.pipeline, self.source, self.wave = spark, pipeline, source, wave
        self.target: Target = open_target(spark, pipeline.sink, folder, transports)
        self.state_file = StateFile(pipeline.checkpoint.file_path, spark)
        self.state: State = self.state_file.load()
        s, k = pipeline.source, pipeline.sink
        self.first_only = pipeline.runtime.route_mode == "FIRST_MATCH"
        self.start = Startup(s.mode, seq=s.offset_pos, timestamp_ms=s.timestamp_ms, skip_rows=s.skip_rows, skip_events=s.skip_events)
        self.flags = NewTables(s.new_tables, s.new_tables_snapshot, s.follow_runtime)
        self.policy = Policy(k.type, bool(k.get("schema_change")), tuple(k.get("include") or ()), k.drop_truncate, bool(k.get("emit_ddl")))
        self.stats = Stats()
        self.captured: dict[str, Captured] = {}
        self.sinks: dict[tuple[str, str], SinkTable] = {}
        self.prepared: set[str] = set()
        self.floor: dict[str, int] = {}
        names = [n for n in selected(source, s.selector)]
        for target, sources in colliding_targets(pipeline.routes, names, self.first_only).items():
            log.info("%s is written from %s", ".".join(target), sources)
        for database, name in names:
            self.capture(database, name)
        self.arrange()

    def capture(self, database: str, name: str) -> None:
        rule = match_rule(self.pipeline.rules, database, name)
        table = project_table(self.source.describe(database, name), rule.columns if rule else (), rule.keys if rule else ())
        self.captured[f"{database}.{name}"] = Captured(database, name, rule, table)

    def arrange(self) -> None:
        """Sink tables and the source tables that go into each; all on the driver, as tables are few."""
        parts: dict[tuple[str, str], list[tuple[Captured, bool]]] = {}
        for own in self.captured.values():
            for database, name, routed in resolve_routes(self.pipeline.routes, own.database, own.name, self.first_only):
                if (own, routed) not in parts.setdefault((database, name), []):
                    parts[database, name].append((own, routed))
        for (database, name), own in parts.items():
            known = self.sinks.get((database, name))
            sources = [(c.database, c.name) for c, _ in own]
            if known is None or known.sources != sources:
                self.sinks[database, name] = SinkTable(database, name, merged_table(database, name, [c.table for c, _ in own]), sources, own[0][1])

    # --- logs -----------------------------------------------------------------------------

    def changes(self, own: Captured) -> DataFrame | None:
        """All changes of a table; statements only where schema changes are on.

        Writes by key take a change that was sent twice as one; only without keys does that need a look at all of them.
        """
        found = self.source.changes(own.database, own.name)
        if found is None:
            return None
        found = captured_only(found, [(own.database, own.name)])
        return without_ddl(found if own.table.primary_keys else without_replays(found), self.pipeline.source.schema_change)

    def ruled(self, own: Captured, events: DataFrame) -> DataFrame:
        return apply_rule(events, own.rule)

    def plan(self) -> dict[str, str]:
        """table -> ``live``, ``snapshot``, ``changes_only`` or ``ignored``; the first run notes where it began."""
        has_position = self.state.resume_from is not None
        out = on_resume(set(self.captured), set(self.state.captured), set(self.state.excluded), self.flags, self.start.mode, has_position)
        out |= {t: "snapshot" for t in self.state.snapshotting if out.get(t) != "live"}  # begun, but not finished
        return {t: x for t, x in out.items() if t in self.captured}

    # --- runs -----------------------------------------------------------------------------

    def run(self) -> dict[str, int | None]:
        """One batch: snapshots, and the changes that are there now.  Returns the position of each sink table's last event."""
        verdicts, has_position = self.plan(), self.state.resume_from is not None
        if self.state.low_watermark is None and self.start.mode in ("initial", "snapshot"):
            self.state.low_watermark = self.source.position()
            self.state.snapshotting = sorted(t for t, x in verdicts.items() if x == "snapshot")
            self.state_file.save(self.state)
        logs: dict[str, DataFrame] = {}
        ends: dict[str, int | None] = {}
        split: set[str] = set()
        for id_, own in self.captured.items():
            verdict = verdicts[id_]
            if verdict == "ignored":
                log.info("%s is new and not captured", id_)
                continue
            changed = self.changes(own) if self.start.reads_changes else None
            ends[id_] = None if changed is None else self.source.end(changed)
            parts = []
            if verdict == "snapshot":
                if self.source.by_split and own.table.primary_keys:
                    split.add(id_)
                else:
                    parts.append(snapshot(self.source.read(own.database, own.name), own.database, own.name))
            if changed is not None and ends[id_] is not None:
                seen = self.state.positions.get(id_)
                if verdict == "live" and seen is not None:
                    if ends[id_] > seen:
                        parts.append(changed.where(F.col("seq") > seen))
                elif verdict == "changes_only" and has_position:
                    parts.append(changed.where(F.col("seq") > self.state.resume_from))
                elif verdict == "snapshot" or self.start.mode == "initial":
                    parts.append(changed.where(F.col("seq") > self.source.position()))
                elif self.start.mode == "latest":
                    pass  # begins behind what is there; the position is noted below
                else:
                    parts.append(from_start(changed, self.start))
            if parts:
                logs[id_] = reduce(backfill, parts)
        for id_ in split:
            self.snapshot_by_split(self.captured[id_])
        self.apply(logs)
        for id_, end in ends.items():
            self.state.ack(id_, -1 if end is None and self.start.mode == "latest" else end)
            self.state.capture(id_)
        self.state.stream_base = None
        self.state_file.save(self.state)
        return {own.id: max((ends[".".join(s)] or 0 for s in own.sources if ".".join(s) in ends), default=None) for own in self.sinks.values()}

    def snapshot_by_split(self, own: Captured) -> None:
        """A table's rows in waves of splits; what a run before has finished isn't read again."""
        whole = self.source.describe(own.database, own.name)
        key = chunk_column(whole, self.pipeline.source.chunk_key)
        found = plan_splits(self.source.read(own.database, own.name), key, self.pipeline.source.chunk_size, unique=whole.primary_keys == (key,)).orderBy("split_id").collect()
        splits = [(r["low"], r["high"]) for r in found]
        if splits:
            splits[0] = (None, splits[0][1])  # what came in below the first key meanwhile is read too
        done = {repr(tuple(x)) for x in self.state.finished_splits.get(own.id, [])}
        left = [s for s in splits if repr(tuple(map(plain, s))) not in done]
        for at in range(0, len(left), self.wave):
            some = left[at : at + self.wave]
            rows = snapshot(self.source.read(own.database, own.name, key, some), own.database, own.name)
            self.apply({own.id: rows})
            for low, high in some:
                self.state.finish_split(own.id, plain(low), plain(high))
            self.state_file.save(self.state)

    def apply(self, logs: dict[str, DataFrame], batch: int | None = None) -> None:
        """Write each sink table's events, in one log over its sources, cut at schema changes."""
        for own in self.sinks.values():
            mine = [".".join(s) for s in own.sources if ".".join(s) in logs]
            if not mine:
                continue
            if own.id not in self.prepared:
                self.target.prepare(own)
                self.prepared.add(own.id)
            applied = self.target.applied(own)
            number = batch if batch is not None else max(applied if applied is not None else -1, self.state.applied_batches.get(own.id, -1)) + 1
            handle = self.target.begin(own, number)
            if handle is None:
                self.stats.skipped += 1
                continue
            whole = one_log(own, [self.ruled(self.captured[t], logs[t]) for t in mine])
            for rows, statement in self.cut(own, handle, whole, any("ddl" in logs[t].columns for t in mine)):
                self.target.write(own, handle, rows, number)
                if statement is not None:
                    self.change(own, handle, statement)
            self.target.commit(own, handle)
            self.state.applied_batches[own.id] = number

    def cut(self, own: SinkTable, handle: object, whole: DataFrame, may_change: bool) -> Iterator[tuple[DataFrame, dict | None]]:
        """Rows before each statement, with the columns that the target has by then, and the statement."""
        pieces = list(segments(whole)) if may_change else [(whole, None)]
        later = [{c.casefold() for _, s in pieces[i:] if s is not None for c in ddl.classify(s["ddl"]).add_columns} for i in range(len(pieces))]
        for (rows, statement), coming in zip(pieces, later):
            there = self.target.columns(own, handle)
            kind = image_type(rows)
            gone = [] if there is None else [n for n in kind.names if n.casefold() in coming and n.casefold() not in there]
            if gone:
                want = T.StructType([f for f in kind if f.name not in gone])
                rows = rows.withColumns({s: as_image(s, kind, want) for s in ("before", "after")})
            yield rows.drop("ddl"), statement

    def change(self, own: SinkTable, handle: object, statement: dict) -> None:
        """A statement of one of the sink table's sources: carried out, shown, passed over or refused."""
        source = self.captured[f"{statement['source_db']}.{statement['source_table']}"]
        change = ddl.classify(statement["ddl"])
        outcome = sink_outcome(change, self.policy, source.rule.columns if source.rule else ())
        if outcome.verb == "fail":
            raise SchemaChangeError(f"{statement['ddl']}: {outcome.reason}")
        if outcome.verb == "skip":
            log.info("%s: %s", statement["ddl"], outcome.reason or "passed over")
            return
        definitions = {c.name: c for c in self.source.describe(source.database, source.name).columns}
        self.target.change(own, handle, statement, change, definitions)

    # --- streams --------------------------------------------------------------------------

    def batch(self, lines: DataFrame, batch_id: int) -> None:
        """One micro-batch of change lines of all tables.  A replay of it writes the same again, or nothing."""
        lines = lines.persist()
        try:
            field = lambda path: F.get_json_object("value", path)
            found = lines.groupBy(field("$.source.db").alias("d"), field("$.source.table").alias("t")).agg(F.max(field("$.seq").cast("long")).alias("end"), F.count("*").alias("n")).collect()
            for r in found:
                if f"{r['d']}.{r['t']}" not in self.captured and r["d"] and self.pipeline.source.selector.matches(r["d"], r["t"]) and on_create(self.flags) == "follow":
                    self.capture(r["d"], r["t"])
                    self.arrange()
            mine = {f"{r['d']}.{r['t']}": r for r in found if f"{r['d']}.{r['t']}" in self.captured and r["end"] is not None}
            logs = {}
            for id_, r in mine.items():
                own, floor = self.captured[id_], self.floor.get(id_)
                if floor is None or r["end"] > floor:
                    changed = captured_only(read_changes(lines, self.source.image_type(own.database, own.name)), [(own.database, own.name)])
                    changed = changed if floor is None else changed.where(F.col("seq") > floor)
                    logs[id_] = without_ddl(changed, self.pipeline.source.schema_change)
            if self.state.stream_base is None:
                last = [self.target.applied(x) for x in self.sinks.values()]
                self.state.stream_base = max([x for x in last if x is not None], default=-1) + 1 - batch_id
            self.apply(logs, self.state.stream_base + batch_id)
            for id_, r in mine.items():
                self.state.ack(id_, r["end"])
                self.state.capture(id_)
            self.state_file.save(self.state)
            self.stats.add(sum(r["n"] for r in mine.values()))
            log.info("batch %s: %s", batch_id, self.stats.report())
        finally:
            lines.unpersist()

    def follow(self, checkpoint: str, interval: str | None = None, files_per_batch: int = 64) -> StreamingQuery:
        """A batch run, then changes as they arrive.  ``interval`` None ends with what is there.

        The first run takes care of snapshots and of where to begin; the stream passes over what it has taken.
        """
        self.run()
        self.floor = dict(self.state.positions)
        return start(self.source.stream(files_per_batch), self.batch, checkpoint, interval)


def plain(x: object) -> object:
    """A split's bound as the state's JSON gives it back."""
    return x if x is None or isinstance(x, (int, float, str)) and not isinstance(x, bool) else str(x)


def run_batch(spark: SparkSession, pipeline: Pipeline, source: Source, folder: str = "", transports: Transports | None = None) -> dict[str, int | None]:
    """One batch run; see ``Job.run``."""
    return Job(spark, pipeline, source, folder, transports).run()

