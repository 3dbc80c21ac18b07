import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidelog.llm import sharding as s
from tidelog.llm.queries import QUERIES


def check(rows, expected, shards=8, slack=0.01, most=0):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in expected)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = sum(r["size"] for r in rows)
    sizes = [sum(r["size"] for r in by[i]) for i in range(shards)]
    assert all(abs(x - total / shards) <= slack * total / shards + most for x in sizes), sizes
    return by


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op10_sharding"](spark, sf).collect(), texts, most=2 * max(len(t.encode()) for _, t in texts))


def test_hot_group_is_cut_and_others_are_whole(spark):
    rng = random.Random(5)
    texts = [(i, "copy " * 20) for i in range(2000)] + [(i, f"{rng.random()}" * rng.randint(1, 9)) for i in range(2000, 5000)] + [(i, f"pair {i // 2}") for i in range(5000, 5400)]
    by = check(s.shard(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, slack=0.02, most=200)
    where = defaultdict(set)
    for shard, own in by.items():
        for r in own:
            where[r["text_crc32"], r["size"]].add(shard)
    cut = [k for k, v in where.items() if len(v) > 1]
    assert (zlib.crc32(("copy " * 20).encode()), 101) in cut and len(cut) <= 2


@pytest.mark.parametrize("copies", [0, 3000])
def test_places_against_a_sort(spark, copies):
    """Shards and slots are those of one sort of all rows; each boundary is within tolerance, at the edge of a group if there is one."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    if copies:
        frame = frame.unionByName(spark.range(-copies, 0).select(F.col("id").alias("doc_id"), F.lit("one text over and over").alias("text")))
    got = {r["doc_id"]: r for r in s.shard(frame).collect()}
    order = sorted(tuple(r) for r in frame.select(F.xxhash64("text"), F.xxhash64("doc_id"), "doc_id").collect())
    assert len(got) == len(order)
    counts = defaultdict(int)
    for _, _, i in order:
        assert got[i]["slot"] == counts[got[i]["shard"]]
        counts[got[i]["shard"]] += 1
    shards = [got[i]["shard"] for _, _, i in order]
    assert shards == sorted(shards)
    edges = [0, *accumulate(got[i]["size"] for _, _, i in order)]
    slack = s.TOLERANCE * edges[-1] / s.SHARDS / 2
    for shard in range(1, s.SHARDS):
        target, at = edges[-1] * shard // s.SHARDS, sum(x < shard for x in shards)
        assert abs(edges[at] - target) <= slack or any(edges[j] < target < edges[j + 1] for j in (at - 1, at))
        if any(abs(edges[j] - target) <= slack and order[j - 1][0] != order[j][0] for j in range(1, len(order))):
            assert order[at - 1][0] != order[at][0]


def test_equal_rows_are_cut_too(spark):
    texts = [(1, "x" * 9)] * 4000
    check(s.shard(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, most=20)


def test_order_is_the_same_whatever_the_tasks(spark):
    texts = [(i, f"t{i % 300}") for i in range(900)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    key = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    coarse, fine = s.shard(frame).collect(), s.shard(frame.repartition(7)).collect()
    assert key(coarse) == key(fine)


def test_awkward(spark, awkward, nothing):
    rows = s.shard(awkward).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert s.shard(nothing).count() == 0
    assert s.shard(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["slot"] == 0
