import itertools
import math
import random
import zlib

import pytest

from tidelog.llm import toxicity as x
from tidelog.llm.queries import QUERIES

from .conftest import unchanged


def brute_marginals(model, words):
    """All labellings of a short chain."""
    extra = [sum(model.weights.get(f, 0.0) for f in x.features(w)) for w in words]
    extra = [e + sum(model.weights.get(f, 0.0) for f in x.beside(words, i)) if e else 0.0 for i, e in enumerate(extra)]
    trans = [model.trans[:2], model.trans[2:]]
    total, hit = 0.0, [0.0] * len(words)
    for path in itertools.product((0, 1), repeat=len(words)):
        s = sum((model.bias + e) * y for e, y in zip(extra, path)) + sum(trans[a][b] for a, b in zip(path, path[1:]))
        total += math.exp(s)
        for i, y in enumerate(path):
            hit[i] += y * math.exp(s)
    return [h / total for h in hit]


def test_marginals_against_all_labellings():
    rng = random.Random(2)
    for _ in range(60):
        model = x.Model({b"=bad": rng.uniform(-3, 6), b"^wors": rng.uniform(-3, 6)}, rng.uniform(-5, 1), tuple(rng.uniform(-2, 2) for _ in range(4)))
        words = [rng.choice([b"bad", b"worse", b"ok", b"fine", b"so"]) for _ in range(rng.randint(1, 11))]
        got, expected = x.Scorer(model).marginals(words), brute_marginals(model, words)
        assert all(got[i] == pytest.approx(expected[i]) for i in got)
        assert set(got) >= {i for i, w in enumerate(words) if w in (b"bad", b"worse")}


def test_gradient_finds_the_labels():
    chains = {(((b"=bad",), 1), ((), 0)): 20, (((), 0), ((), 0)): 200, (((b"=odd",), 0), ((b"=bad",), 1)): 5}
    weights, bias, trans = x.train_field(chains)
    scorer = x.Scorer(x.Model(weights, bias, trans))
    found = scorer.marginals([b"x", b"bad", b"x", b"odd"])
    assert found[1] > 0.8 and found[0] < 0.3 and found[3] < 0.3


def test_spans_are_code_points():
    text = "Śó bad bad. ok – bad!"
    words = text.encode().translate(x.ALNUM).split()
    marginals = {i: 0.9 for i, w in enumerate(words) if w == b"bad"}
    got = [(text[s["start"] : s["stop"]]) for s in x.spans(text.encode(), marginals)]
    assert got == ["bad bad", "bad"]


def test_neighbours_count():
    """The same marker is worth more beside a word that goes with toxic documents."""
    rng = random.Random(4)
    filler = [f"w{i:03}".encode() for i in range(300)]
    sample = []
    for i in range(400):
        words = rng.choices(filler, k=30)
        toxic = i % 4 == 0
        words[rng.randrange(1, 29)] = b"slur" if toxic or i % 16 == 1 else words[0]
        at = words.index(b"slur") if b"slur" in words else None
        if at:
            words[at - 1] = b"vile" if toxic and rng.random() < 0.8 else b"mild" if not toxic else words[at - 1]
        sample.append((words, int(toxic)))
    strong = x.pick_features(sample)
    weights, bias, trans = x.train_field(x._chains(sample, strong))
    assert b"=slur" in strong and weights[b"<vile"] > weights[b"<mild"]
    scorer = x.Scorer(x.Model(weights, bias, trans))
    text = [b"w001"] * 5
    assert scorer.marginals([*text, b"vile", b"slur", *text])[6] > scorer.marginals([*text, b"mild", b"slur", *text])[6]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == 10_000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == t for p, t, _ in held) >= 0.97 * len(held)
    toxic = [p for p, t, _ in held if t]
    assert sum(toxic) >= 0.9 * len(toxic)


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(x.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert x.fit(documents, labels) == x.fit(documents, flipped)


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 0), (7, 1), (7, 1)], "doc_id long, toxic int")
    model = x.fit(awkward, labels)
    out = x.score(awkward, model).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out)
    assert x.score(nothing, x.fit(nothing, labels.limit(0))).count() == 0
    kept = x.drop_toxic(awkward, x.Model())
    assert unchanged(kept, awkward) and kept.count() == 9 and x.drop_toxic(nothing, model).count() == 0


def test_labels_of_one_kind_drop_nothing(spark, awkward):
    kind = "doc_id long, toxic int"
    for labels in ([], [(99, 1)], [(5, None)], [(5, 1), (8, 1)], [(5, 0), (8, 0)]):
        model = x.fit(awkward, spark.createDataFrame(labels, kind))
        kept = x.drop_toxic(awkward, model)
        assert unchanged(kept, awkward) and kept.count() == 9, labels
        assert all(r["score"] < 0.5 and r["predicted"] == 0 for r in x.score(awkward, model).collect())
