"""Sharding by histogram sort.

Keys are hashes of the text, then of the id, then a row number, so that equal texts lie
side by side.  Candidate boundaries are edges of key prefixes: a pass counts the exact bytes and rows
under each prefix that a splitter is still in, the splitter moves to the edge
nearest its target or is refined twelve bits further, and once all splitters are within tolerance the
rows are exchanged once.  A group of equal texts is cut only where no edge between groups
is within tolerance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 8
#: Allowed distance of a boundary from its target, in parts of a shard.
TOLERANCE = 0.002
#: Rows that one task of the exchange is meant to order, and the most ranges that a shard is dealt into.
#: With these, ranges inside a shard end at edges of the first probes, and only shards' own boundaries (and large groups) are refined.
TASK_ROWS = 1_000_000
MOST_RANGES = 128
BITS, PER_KEY, KEYS = 12, 6, 3
SIGN = 1 << 63


def _shift(level: int) -> int:
    return max(0, 64 - BITS * (level % PER_KEY + 1))


def _width(level: int) -> int:
    """Bits that a level adds: twelve, and the last four of each key."""
    return BITS if level % PER_KEY < PER_KEY - 1 else 64 - BITS * (PER_KEY - 1)


def _unsigned(k: int) -> F.Column:
    return F.col(f"k{k}").bitwiseXOR(F.lit(-SIGN))


def _prefix(level: int) -> F.Column:
    """The bits of the level's key down to this level, in unsigned order."""
    return F.shiftrightunsigned(_unsigned(level // PER_KEY), _shift(level))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= SIGN else x


def _count(keys: DataFrame, level: int, open_at: set[tuple[int, int, int]]) -> dict:
    """(fixed key 0, fixed key 1, prefix above) -> {prefix: (bytes, rows, least, greatest of the level's key)}.

    ``open_at`` has at most one entry a splitter; the answer at most 4096 rows for each.
    """
    key = level // PER_KEY
    chosen = [F.col(f"k{i}") if i < key else F.lit(0).cast("long") for i in range(KEYS - 1)]
    above = F.lit(0).cast("long") if level % PER_KEY == 0 else _prefix(level - 1)
    counted = keys.select(*(c.alias(f"f{i}") for i, c in enumerate(chosen)), above.alias("above"), _prefix(level).alias("prefix"), F.col(f"k{key}").alias("key"), "size")
    if level:
        at = keys.sparkSession.createDataFrame(sorted(open_at), "f0 long, f1 long, above long")
        counted = counted.join(F.broadcast(at), ["f0", "f1", "above"], "left_semi")
    out: dict = {}
    for r in counted.groupBy("f0", "f1", "above", "prefix").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")).collect():
        # shiftrightunsigned by nothing keeps the sign of the widest prefix
        prefix, above_ = r["prefix"] % (1 << 64), r["above"] % (1 << 64)
        out.setdefault((r["f0"], r["f1"], above_), {})[prefix] = (r["bytes"], r["rows"], r["least"], r["most"])
    return out


Key = tuple[int, ...]


def _padded(head: list[int]) -> Key:
    """The least key that starts so."""
    return tuple(head + [-SIGN] * (KEYS - len(head)))


def _lower(place: Key, level: int, prefix: int) -> Key:
    """The least key under a prefix of a place."""
    return _padded([*place[: level // PER_KEY], (prefix << _shift(level)) - SIGN])


def _upper(place: Key, level: int) -> Key:
    """The least key above a whole place: behind its prefix, or else behind the key that is fixed last."""
    head = list(place[: level // PER_KEY])
    if level % PER_KEY and (bound := ((place[-1] + 1) << _shift(level - 1)) - SIGN) < SIGN:
        return _padded([*head, bound])
    while head:
        if (last := head.pop()) < SIGN - 1:
            return _padded([*head, last + 1])
    return (SIGN - 1,) * KEYS


def find_splitters(keys: DataFrame, targets: list[int], slack: list[float]) -> list[tuple[Key, int, int]]:
    """(boundary key, bytes below, rows below) for each target number of bytes.

    ``keys`` has ``k0, k1, k2, size``; a row is below a boundary if its key is less.  ``slack``
    is how far from its target each boundary may lie.  A place is two fixed keys (0 where not yet fixed)
    and the prefix of the next; a splitter in it knows the bytes and rows before the place.
    """
    found: dict[int, tuple[Key, int, int]] = {}
    state = {i: (0, (0, 0, 0), 0, 0) for i in range(len(targets))}
    while state:
        level = min(s[0] for s in state.values())
        here = {i: s for i, s in state.items() if s[0] == level}
        key, last = level // PER_KEY, KEYS * PER_KEY - 1
        histogram = _count(keys, level, {(p[0], p[1], _signed(p[2])) for _, p, _, _ in here.values()})
        for i, (_, place, size, rows) in here.items():
            for prefix, (more, n, least, most) in sorted(histogram[place].items()):
                if targets[i] <= size + slack[i]:
                    found[i] = (_lower(place, level, prefix), size, rows)
                    break
                if targets[i] + slack[i] < size + more:  # inside this prefix
                    if level == last or (key == KEYS - 1 and least == most):
                        found[i] = (_lower(place, level, prefix), size, rows)  # equal keys can't be cut
                        break
                    if least == most:  # one key holds it all: on to the next
                        fixed = [*place[:key], least, 0][: KEYS - 1]
                        state[i] = ((key + 1) * PER_KEY, (*fixed, *[0] * (KEYS - 1 - len(fixed)), 0), size, rows)
                    else:
                        state[i] = (level + 1, (*place[:-1], prefix), size, rows)
                    break
                size, rows = size + more, rows + n
            else:
                found[i] = (_upper(place, level), size, rows)
        state = {i: s for i, s in state.items() if i not in found}
    return [found[i] for i in range(len(targets))]


def shard(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``.

    Size is the text's UTF-8 bytes plus one; a null text has none and lies with the empty
    ones.  Every row gets a place, repeated rows and null ids too; shards differ by
    ``tolerance`` of a shard or one row; slots count from 0 in each.  The exchange runs in finer ranges than
    shards (boundaries of shards are among them), so no task orders a whole shard of a large
    corpus.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = materialise(
        documents.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k0"), F.xxhash64("doc_id").alias("k1"), F.monotonically_increasing_id().alias("k2"),
        )
    )
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(8, math.ceil(n_rows / (shards * task_rows))))
    parts = shards * ranges
    targets = [total * i // parts for i in range(1, parts)]
    slack = [tolerance * total / shards / 2 if i % ranges == 0 else total / parts / 4 for i in range(1, parts)]
    splitters = find_splitters(keys, targets, slack) if n_rows else []
    edges = sorted({s[0]: s for s in splitters}.values())
    # The part of a row: the edges at or below its key.  Looked up by the first twelve bits.
    first_row = [0, *(s[2] for s in edges)]
    cuts = {i // ranges: splitters[i - 1] for i in range(ranges, parts, ranges)} if splitters else {}
    shard_edges = [cuts[i][0] for i in sorted(cuts)]
    table, per = [], {}
    for e, _, _ in edges:
        per.setdefault((e[0] + SIGN) >> 52, []).append(e)
    below = 0
    for d in range(1 << BITS):
        own = per.get(d, [])
        table.append((d, below, [tuple(e) for e in own]))
        below += len(own)
    of_part = [sum(e <= x for e in shard_edges) for x in ([(-SIGN,) * KEYS] + [s[0] for s in edges])]
    start = {}
    for p, s in enumerate(of_part):
        start.setdefault(s, first_row[p])
    spark = documents.sparkSession
    lookup = spark.createDataFrame(table, "digit long, base int, own array<struct<k0:long,k1:long,k2:long>>")
    parts_table = spark.createDataFrame([(p, s, first_row[p] - start[s]) for p, s in enumerate(of_part)], "part int, shard int, first long")
    at_or_below = F.filter("own", lambda e: e <= F.struct("k0", "k1", "k2"))
    placed = keys.withColumn("digit", _prefix(0)).join(F.broadcast(lookup), "digit").withColumn("part", (F.col("base") + F.size(at_or_below)).cast("int"))
    ordered = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("k0", "k1", "k2")).cast("long") - 1)
    return ordered.join(F.broadcast(parts_table), "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
