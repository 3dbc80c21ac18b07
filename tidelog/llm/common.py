"""Shared pieces: the shared folder, materialisation, byte-level word splitting."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper case A-Z to lower case, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte outside 0-9, A-Z, a-z turned into a space:
#: ``bytes.split`` then yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)

#: Folders that ``materialise`` has written.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only a local session that names none
    (a test) gets a temporary folder, which is then set as its checkpoint folder.  Elsewhere executors would write to
    disks of their own, so a session without a folder is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidelog-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of the files, never a
    recomputation, and numbers drawn from partition ids stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Remove what ``materialise`` has written in this process, or only ``paths`` of it; results that read it must be done.

    Returns the number of folders.
    """
    jvm, n = spark.sparkContext._jvm, 0
    for name in list(WRITTEN) if paths is None else paths:
        WRITTEN.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def utf8(column: str = "text") -> F.Column:
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[F.Column]:
    """The frame's columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once by a Python worker and kept for its later tasks.

    A worker keeps one such thing only, the last, so memory doesn't add up over operators.  It is kept in a module
    of its own, as functions that are shipped by value bring new globals to each task.
    """
    store = sys.modules.setdefault("_tidelog_worker", types.ModuleType("_tidelog_worker")).__dict__
    if store.get("key") != key:
        store.pop("value", None)
        store["value"], store["key"] = make(), key
    return store["value"]


def place(df: DataFrame, name: str) -> int:
    """Where a column stands; names don't tell upper from lower case."""
    return [c.lower() for c in df.columns].index(name)


def map_whole(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over all columns, to the same columns; ``f`` goes by place, as names may hold anything."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(f, plain.schema).toDF(*df.columns)


def rows(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
