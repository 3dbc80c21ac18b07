"""Versioned tables: a base and deltas of Parquet, and a pointer that names the current ones.

All files go through Spark's file system layer, so a table can lie in any store that
Spark writes.  Folders are numbered by the pointer that a batch started from: a batch that is replayed after a failure writes the
same folders again, and one that is known as applied is passed over.

A micro-batch adds only its last writes, as a delta; the base is rewritten once in ``compact_every`` deltas, so the cost of
a batch goes by the batch and not by the table.  A reader merges: the latest delta row of a key wins over the base.
Columns that are added or dropped, and TRUNCATE, change the pointer only: rows from before a column get its default when read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETED, BATCH = "__deleted", "__batch"


class Draft:
    """The next version of a table, not yet seen by readers."""

    def __init__(self, table: VersionedTable, batch: int, pointer: dict):
        self.table, self.batch, self.pointer = table, batch, pointer

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(self.pointer["schema"]) if self.pointer["schema"] else None

    def _next(self) -> int:
        self.pointer["files"] += 1
        return self.pointer["files"]

    def append(self, writes: DataFrame) -> None:
        """Last writes, one row a key: columns of the table and ``__deleted``.

        Columns that the table lacks are added to it; those that the rows lack are null; a changed type rewrites the base.
        """
        own = T.StructType([T.StructField(f.name, f.dataType) for f in writes.schema if f.name != DELETED])
        known = {f.name: f.dataType for f in self.schema or []}
        if any(f.name in known and known[f.name] != f.dataType for f in own):
            kinds = known | {f.name: f.dataType for f in own}
            rows = self.read()
            self.replace(rows.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in rows.columns)))
        elif new := [f for f in own if f.name not in known]:
            self.evolve(T.StructType([*(self.schema or []), *new]), {})
        at = self._next()
        writes.withColumn(BATCH, F.lit(at).cast("long")).write.mode("overwrite").parquet(f"{self.table.path}/d{at}")
        self.pointer["deltas"].append(at)

    def replace(self, rows: DataFrame) -> None:
        """These rows as the whole table."""
        at = self._next()
        rows.write.mode("overwrite").parquet(f"{self.table.path}/v{at}")
        self.pointer |= {"base": at, "deltas": [], "defaults": {}, "schema": rows.schema.jsonValue()}

    def evolve(self, schema: T.StructType, defaults: dict[str, str | None]) -> None:
        """Columns added, with a default for the rows that are there, or dropped.  Nothing is rewritten."""
        old = set(self.schema.names) if self.schema else set()
        since = self._next()
        marks = {c: x for c, x in self.pointer["defaults"].items() if c in schema.names}
        marks |= {f.name: [defaults.get(f.name), since] for f in schema if f.name not in old and old}
        self.pointer |= {"schema": schema.jsonValue(), "defaults": marks}

    def truncate(self) -> None:
        self.pointer |= {"base": None, "deltas": [], "defaults": {}}

    def read(self) -> DataFrame | None:
        return self.table.rows_of(self.pointer)

    def publish(self) -> None:
        self.table.publish(self.pointer, self.batch)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), keep: int = 2, compact_every: int = 16):
        self.spark, self.path, self.keys, self.keep, self.compact_every = spark, path.rstrip("/"), keys, keep, compact_every
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _pointers(self) -> list[tuple[int, int]]:
        """(batch, generation) of each pointer; a compaction is a new generation of its batch."""
        return sorted(tuple(map(int, n.split("-"))) for n in self._names("_current") if n.replace("-", "").isdigit())

    def batch(self) -> int | None:
        """The last batch that is part of the table."""
        found = self._pointers()
        return found[-1][0] if found else None

    def _pointer(self, at: tuple[int, int]) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_current/{at[0]}-{at[1]}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self) -> dict:
        found = self._pointers()
        return self._pointer(found[-1]) if found else {"base": None, "deltas": [], "files": 0, "schema": None, "defaults": {}}

    def schema(self) -> T.StructType | None:
        pointer = self._last()
        return T.StructType.fromJson(pointer["schema"]) if pointer["schema"] else None

    def read(self) -> DataFrame | None:
        """The table as of the last batch; None before the first."""
        return self.rows_of(self._last())

    def rows_of(self, pointer: dict) -> DataFrame | None:
        if not pointer["schema"]:
            return None
        schema = T.StructType.fromJson(pointer["schema"])
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

        def filled(rows: DataFrame, older) -> DataFrame:
            """Rows from before a column was added get its default."""
            new = {c: F.when(older(since), F.lit(value).cast(plain[c].dataType)).otherwise(F.col(f"`{c}`")) for c, (value, since) in pointer["defaults"].items()}
            return rows.withColumns(new) if new else rows

        if pointer["base"] is None:
            base = self.spark.createDataFrame([], plain)
        else:
            base = filled(self.spark.read.schema(plain).parquet(f"{self.path}/v{pointer['base']}"), lambda since: F.lit(pointer["base"] < since))
        if not pointer["deltas"]:
            return base
        stored = T.StructType([*plain.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(BATCH, T.LongType())])
        deltas = filled(self.spark.read.schema(stored).parquet(*(f"{self.path}/d{d}" for d in pointer["deltas"])), lambda since: F.col(BATCH) < since)
        if not self.keys:
            return base.unionByName(deltas.select(*plain.names))
        last = deltas.groupBy(*(f"`{k}`" for k in self.keys)).agg(F.max_by(F.struct(*(f"`{c}`" for c in stored.names)), BATCH).alias("w")).select("w.*")
        kept = base.join(last.select(*(f"`{k}`" for k in self.keys)), list(self.keys), "left_anti")
        columns = [f"`{c}`" for c in plain.names]
        return kept.select(*columns).unionByName(last.where(~F.col(DELETED)).select(*columns))

    def begin(self, batch: int) -> Draft | None:
        """A draft of the table as of ``batch``; None if the batch was applied before."""
        current = self.batch()
        return None if current is not None and batch <= current else Draft(self, batch, self._last())

    def append(self, writes: DataFrame, batch: int) -> bool:
        """Add the last writes of a batch.  False if the batch was applied before."""
        draft = self.begin(batch)
        if draft is not None:
            draft.append(writes)
            draft.publish()
        return draft is not None

    def replace(self, rows: DataFrame, batch: int) -> bool:
        """Make ``rows`` the table as of ``batch``; False if the batch was applied before."""
        draft = self.begin(batch)
        if draft is not None:
            draft.replace(rows)
            draft.publish()
        return draft is not None

    def compact(self) -> None:
        """Write base and deltas as one base, under the batch that the table has."""
        pointer = self._last()
        if pointer["deltas"]:
            draft = Draft(self, self.batch(), pointer)
            draft.replace(draft.read())
            draft.publish()

    def publish(self, pointer: dict, batch: int) -> None:
        """The pointer is written aside and renamed: it is there in full or not at all, and the one before stays until then."""
        generation = max((g for b, g in self._pointers() if b == batch), default=-1) + 1
        name = f"{batch}-{generation}"
        aside, there = self._path(f"{self.path}/_aside/{name}"), self._path(f"{self.path}/_current/{name}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.path}/_current"))
        if not self._fs.rename(aside, there):
            raise RuntimeError(f"batch {batch} of {self.path} could not be published")
        self._clean()
        if len(pointer["deltas"]) >= self.compact_every:
            self.compact()

    def _clean(self) -> None:
        """Remove what none of the last pointers names."""
        kept = self._pointers()[-self.keep :]
        for b, g in self._pointers()[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/_current/{b}-{g}"), False)
        pointers = [self._pointer(p) for p in kept]
        used = {f"v{p['base']}" for p in pointers} | {f"d{d}" for p in pointers for d in p["deltas"]}
        for name in self._names(""):
            if name not in used and name[:1] in "vd" and name[1:].isdigit() and int(name[1:]) <= pointers[-1]["files"]:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
