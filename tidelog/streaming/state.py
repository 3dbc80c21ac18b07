"""The state of a pipeline: a small JSON document that is replaced in one step."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass
class State:
    """What is done: positions, splits, and tables by how they are captured.

    ``low_watermark`` is the position from before the first snapshot row, ``acked`` the last
    one whose changes a sink has taken, ``positions`` the same for each table.
    """

    low_watermark: int | None = None
    acked: int | None = None
    positions: dict[str, int] = field(default_factory=dict)
    finished_splits: dict[str, list[tuple]] = field(default_factory=dict)
    captured: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    snapshotting: list[str] = field(default_factory=list)
    applied_batches: dict[str, int] = field(default_factory=dict)
    #: What a stream's batch numbers are counted from.
    stream_base: int | None = None

    @property
    def resume_from(self) -> int | None:
        return self.acked if self.acked is not None else self.low_watermark

    def position(self, table: str) -> int | None:
        """Where a table's changes go on."""
        return self.positions.get(table, self.low_watermark)

    def ack(self, table: str, seq: int | None) -> None:
        """A sink has taken a table's changes up to ``seq``."""
        if seq is not None:
            self.positions[table] = max(seq, self.positions.get(table, seq))
            self.acked = max(seq, self.acked if self.acked is not None else seq)

    def finish_split(self, table: str, low: object, high: object) -> None:
        done = self.finished_splits.setdefault(table, [])
        if (low, high) not in done:
            done.append((low, high))

    def is_finished(self, table: str, low: object, high: object) -> bool:
        return (low, high) in self.finished_splits.get(table, [])

    def capture(self, table: str) -> None:
        """A table whose snapshot is complete: its splits need no memory any more."""
        if table not in self.captured:
            self.captured.append(table)
        self.snapshotting = [t for t in self.snapshotting if t != table]
        self.finished_splits.pop(table, None)


class StateFile:
    """Loads and saves a state through Spark's file system layer, so it can lie in any store that outlives the driver.

    A document is written aside and moved over the old one; a reader that finds none between both steps takes the
    one aside, so it sees the old document or the new one, never a part.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path = path
        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("a state file needs a session")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self, path: str) -> State | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            raw = json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        raw["finished_splits"] = {t: [tuple(s) for s in x] for t, x in raw.get("finished_splits", {}).items()}
        return State(**raw)

    def load(self) -> State:
        return self._load(self.path) or self._load(f"{self.path}.new") or State()

    def save(self, state: State) -> None:
        aside, there = self._path(f"{self.path}.new"), self._path(self.path)
        if self._fs.exists(aside) and not self._fs.exists(there):  # the only document, left by a crash
            self._fs.rename(aside, there)
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(asdict(state)).encode()))
            out.hsync()
        finally:
            out.close()
        if self._fs.exists(there):
            self._fs.delete(there, False)
        if not self._fs.rename(aside, there):
            raise RuntimeError(f"the state {self.path} could not be replaced")
