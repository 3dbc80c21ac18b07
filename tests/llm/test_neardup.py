import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import neardup as n
from tidelog.llm.queries import QUERIES

from .conftest import unchanged


def weighted(text):
    words = (text or "").encode().translate(n.ALNUM).split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return {g: 1 + math.log2(grams.count(g)) for g in set(grams)}


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    every = a.keys() | b.keys()
    jp = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())
    return max(plain, jp)


def packed(text):
    owner, element, count = n.shingles([text.encode()], n.WordHashes())
    return element.view(np.int64).tobytes() + count.astype(np.int64).tobytes()


def test_similarity_is_exact():
    rng = random.Random(1)
    for _ in range(80):
        base = [rng.choice("abcdef") for _ in range(rng.randint(1, 40))]
        other = [w if rng.random() > 0.1 else "z" for w in base * rng.choice([1, 2])]
        a, b = " ".join(base), " ".join(other)
        assert max(n.similarity(packed(a), packed(b))) == pytest.approx(brute_similarity(weighted(a), weighted(b)))


def test_registers_estimate_probability_jaccard():
    rng = random.Random(2)
    words = [f"w{rng.randrange(60)}" for _ in range(400)]
    a, b = " ".join(words), " ".join(words[:330] + [f"v{i}" for i in range(90)])
    owner, element, count = n.shingles([a.encode(), b.encode()], n.WordHashes())
    signature = n.prob_minhash(owner, element, n.weigh(count), 2, 4000)
    assert (signature[0] == signature[1]).mean() == pytest.approx(n.similarity(packed(a), packed(b))[0], abs=0.03)


def test_signature_does_not_depend_on_the_batch():
    texts = [b"one two three four five six", b"x", b"", b"one two three four five six"]
    sign = lambda few: (lambda o, e, c: n.prob_minhash(o, e, n.weigh(c), len(few), 96))(*n.shingles(few, n.WordHashes()))
    together, alone = sign(texts), sign(texts[:1])
    assert (together[0] == alone[0]).all() and (together[3] == alone[0]).all()


def brute_classes(texts):
    """Least id of each class, by all pairs."""
    ids = [i for i, t in texts if t is not None]
    sets = {i: weighted(t) for i, t in texts}
    by = dict(texts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if by[a] == by[b] or (sets[a].keys() & sets[b].keys() and brute_similarity(sets[a], sets[b]) >= 0.8):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert got == brute_classes(texts) and len(set(got.values())) < len(got)


def family(rng, size, n_words=120, edits=9):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_families_around_the_threshold(spark):
    rng = random.Random(7)
    texts = list(enumerate(t for _ in range(4) for t in family(rng, 18)))
    got = {r["doc_id"]: r["class_id"] for r in n.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_texts_of_large_buckets_are_signed_again(spark, monkeypatch):
    seen = []
    fine = n.fine_keys
    monkeypatch.setattr(n, "fine_keys", lambda sets: seen.append(sets.count()) or fine(sets))
    rng = random.Random(17)
    texts = list(enumerate(t for _ in range(3) for t in family(rng, 16, 100, 14)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in n.classes(frame, large=3).collect()} == brute_classes(texts) and seen and seen[0] > 6


def test_recall_against_all_pairs(spark):
    """Links by either similarity, probability Jaccard too, of all texts of sf0.01 that share a shingle."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    sets = [packed(t) for _, t in rows]
    holders = {}
    for i, p in enumerate(sets):
        for x in np.frombuffer(p, np.int64).reshape(2, -1)[0].tolist():
            holders.setdefault(x, []).append(i)
    pairs = {pair for own in holders.values() if len(own) > 1 for pair in combinations(own, 2)}
    links = [(rows[i][0], rows[j][0]) for i, j in pairs if max(n.similarity(sets[i], sets[j])) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert len(links) > 30 and all(got[a] == got[b] for a, b in links)


def test_a_hot_key_is_dealt_by_salt(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("key"), F.unhex(F.md5(F.col("id").cast("string"))).alias("node"))
    out = n.buckets_of(rows)
    assert out.count() == 4000 and out.select("leader").distinct().count() == 1 and out.select("salt").distinct().count() > 900


@pytest.mark.parametrize("members", [3, 1024])
def test_blocks_lose_no_link(spark, monkeypatch, members):
    monkeypatch.setattr(n, "BLOCK_MEMBERS", members)
    rng = random.Random(9)
    texts = family(rng, 14, 60, 7)
    rows = [(1, f"{i:032x}", f"{i:032x}", packed(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(k, bytes.fromhex(a), bytes.fromhex(b)) for k, a, b, _ in rows], "key long, node binary, root binary").transform(n.salted)
    sets = spark.createDataFrame([(bytes.fromhex(a), p) for _, a, _, p in rows], "node binary, packed binary")
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if max(n.similarity(rows[i][3], rows[j][3])) >= 0.8]
    got = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in n.across(frame, sets).collect()]

    def groups(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            root = [root[a] if x == root[b] else x for x in root]
        return sorted(map(tuple, {frozenset(i for i in range(len(texts)) if root[i] == x) for x in root}))

    assert groups(got) == groups(links) and 1 < len(groups(links)) < len(texts)


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 150), (150, 120), (120, 100)]
    rng.shuffle(edges)
    name = lambda i: bytes([i])
    got = {bytes(r["node"])[0]: bytes(r["root"])[0] for r in n.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 120, 150), 100)


def test_awkward(spark, awkward, nothing):
    out = n.classes(awkward).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r for r in out}
    assert by[1]["class_id"] == 1 and by[2]["class_id"] == 2 and by[3]["class_id"] == 3 and by[5]["class_id"] == 5
    assert n.classes(nothing).count() == 0
    kept = n.keep_one(awkward)
    assert unchanged(kept, awkward) and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert n.keep_one(nothing).count() == 0
    rows = [(None, "a b c d e f"), (9, "a b c d e f"), (3, "A b, c d e f"), (3, "p q r s t u")]
    got = n.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, "A b, c d e f"), (3, "p q r s t u")]


def test_one_line_over_and_over_is_no_copy(spark):
    rng = random.Random(8)
    line = " again and again the same old line"
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + line * 90) for i in range(12)]
    got = {r["doc_id"]: r["class_id"] for r in n.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(12)}


def test_a_copy_with_a_repeated_line_is_found(spark):
    # near by plain Jaccard only: the line's weight keeps the weighted signatures apart
    rng = random.Random(11)
    some = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    texts = []
    for i in range(16):
        base = some(104)
        texts += [(2 * i, base), (2 * i + 1, base + f" {some(15)}" * 100)]
    for (_, a), (_, b) in zip(texts[::2], texts[1::2]):
        by_weight, plain = n.similarity(packed(a), packed(b))
        assert by_weight < 0.6 and plain >= 0.8
    got = {r["doc_id"]: r["class_id"] for r in n.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in texts}


def test_texts_without_repeats_have_one_signature():
    texts = [b"a b c d e f g h", b"", b"a b c d e a b c d e a b c d e", b"p q r s t u v"]
    owner, element, count = n.shingles(texts, n.WordHashes())
    keys = n.keys_of_texts(owner, element, count, len(texts), n.BANDS, n.ROWS)
    assert [len(keys[i]) for i in (0, 1, 3)] == [n.BANDS, 0, n.BANDS] and n.BANDS <= len(keys[2]) <= 2 * n.BANDS
