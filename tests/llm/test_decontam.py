import hashlib
import random

import pytest

from tidelog.llm import decontam as d
from tidelog.llm.common import ALNUM
from tidelog.llm.queries import ORACLE_SQL, QUERIES

from .conftest import unchanged


def plain(text, items, window):
    words = (text or "").encode().translate(ALNUM).split()
    hit, who = set(), set()
    for item, body in items:
        own = (body or "").encode().translate(ALNUM).split()
        size = min(window, len(own))
        for a in range(len(own) - size + 1) if own else ():
            w = own[a : a + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w:
                    hit |= set(range(i, i + size))
                    who.add(item)
    return len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [10**9, 3])
def test_against_brute_force(spark, block_words):
    rng = random.Random(block_words)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é,", "d-e"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(9)] + [(20, None), (100, "a b C")]
    documents = [(i, text(rng.randrange(60))) for i in range(60)] + [(60, None), (60, ""), (None, "a b c d e")]
    frames = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hits = d.find_hits(*frames, window=4, block_words=block_words).collect()
    got = sorted((str(r["doc_id"]), r["__n_words"], sum(r["__spans"][1::2]) - sum(r["__spans"][::2]), len(r["__items"]), hashlib.sha256(",".join(map(str, r["__items"])).encode()).hexdigest()) for r in hits)
    assert got == sorted((str(i), *plain(t, items, 4)[:4]) for i, t in documents)


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = QUERIES["op8_decontamination"](spark, sf)
    expected = c.execute(f"select {', '.join(out.columns)} from ({ORACLE_SQL['op8_decontamination']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert any(r[-1] for r in expected)


def test_search_finds_overlaps():
    words = "a a a b a a".encode().split()
    tables = d.build_tables([(1, b"a a"), (2, b"a"), (3, b"a b a"), (4, b"a a"), (5, b"a z b")])
    got = sorted((i, tables.items_of(end)) for i, length, end in d.search(words, tables))
    patterns = {1: b"a a", 2: b"a", 3: b"a b a", 4: b"a a"}
    assert got == sorted((i, k) for k, p in patterns.items() for i in range(6) if words[i : i + len(p.split())] == p.split())


def test_search_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        some = lambda n: " ".join(rng.choices("abcd", k=n)).encode()
        items = [(i, some(rng.randrange(9))) for i in range(6)]
        window = rng.choice([1, 2, 3, 5])
        tables = d.build_tables(items, window)
        words = some(rng.randrange(40)).split()
        got = {(i, n, tables.items_of(end)) for i, n, end in d.search(words, tables)}
        assert got == {(i, len(w), item) for item, text in items for w in d.item_windows(text, window) for i in range(len(words)) if tuple(words[i : i + len(w)]) == w}


def test_ids_of_any_type_and_clashing_names(spark):
    documents = spark.createDataFrame([("x", "A b c", 1), (None, "b", 2)], "doc_id string, text string, __items int")
    items = spark.createDataFrame([("b-1", "a B"), ("b-0", "b c")], "item_id string, text string")
    out = {r["doc_id"]: r for r in d.contamination(documents, items).collect()}
    assert out["x"]["n_hit"] == 3 and out["x"]["items_sha256"] == hashlib.sha256(b"b-0,b-1").hexdigest() and not out[None]["contaminated"]
    assert d.drop_contaminated(documents, items).collect() == [(None, "b", 2)]


def test_a_large_benchmark_stays_small():
    """Ten bytes and more a word would be the words' own; the tables take about 25 a word."""
    rng = random.Random(1)
    vocabulary = [b"w%d" % i for i in range(20_000)]
    tables = d.build_tables([(i, b" ".join(rng.choices(vocabulary, k=2_000))) for i in range(100)])
    size = len(tables.words) * 4 + sum(len(g.shift) + 16 * len(g.keys) for g in tables.groups)
    assert len(tables.words) == 200_000 and size <= 32 * 200_000


def test_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "same text here"), (None, "word"), (2, None)], "item_id long, text string")
    out = d.contamination(awkward, items).collect()
    assert len(out) == 9 and sorted(r["doc_id"] for r in out if r["contaminated"]) == [5, 5]
    kept = d.drop_contaminated(awkward, items)
    assert unchanged(kept, awkward) and kept.count() == 7
    assert d.contamination(nothing, items).count() == 0 and d.contamination(awkward, items.limit(0)).where("contaminated").count() == 0
