import hashlib
import math

import duckdb
import numpy as np

import corpus_pipeline as pipeline
from tests.llm.conftest import PLAIN
from tests.llm.test_neardup import brute_classes
from tidelog.llm import decontam, toxicity
from tidelog.llm.common import materialise, table
from tidelog.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def plain_probability(model, text):
    """The score of a text by forward and backward sums over each of its words."""
    words = text.encode().translate(decontam.ALNUM).split()
    extra = [sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]
    extra = [e + sum(model.weights.get(f, 0.0) for f in toxicity.beside(words, i)) if e else 0.0 for i, e in enumerate(extra)]
    logit, expected = -8.0, 0.0
    if any(extra):
        psi = np.array([[1.0, math.exp(min(60, max(-60, model.bias + e)))] for e in extra])
        trans = np.exp(np.array(model.trans)).reshape(2, 2)
        forward, backward = psi / psi.sum(1, keepdims=True), np.ones_like(psi)
        for i in range(1, len(words)):
            forward[i] = forward[i - 1] @ trans * psi[i]
            forward[i] /= forward[i].sum()
        for i in range(len(words) - 2, -1, -1):
            backward[i] = trans @ (psi[i + 1] * backward[i + 1])
            backward[i] /= backward[i].sum()
        both = forward * backward
        toxic = (both / both.sum(1, keepdims=True))[:, 1]
        near = [toxic[i] for i in range(len(words)) if any(extra[max(0, i - 1) : i + 2])]
        top = min(1 - 1e-9, max(1e-9, max(near)))
        logit, expected = max(-8.0, min(8.0, math.log(top / (1 - top)))), math.log1p(sum(near))
    a, b, c = model.calibration
    return 1 / (1 + math.exp(-(a + b * logit + c * expected)))


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = docs
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = {i for (i,) in c.execute(f"select doc_id from ({ORACLE_SQL['op3_distribution_divergence']}) where kept").fetchall()}
    model = None
    for (name, stage), step in zip(pipeline.STAGES, ("quality", "toxic", "near", "leaks", "pack")):
        previous = out
        out = materialise(stage(spark, previous, SF))
        if step == "toxic":
            model = toxicity.fit(previous, table(spark, SF, "labels"))
            expected = {i for i in expected if plain_probability(model, rows[i]["text"]) < 0.5}
        elif step == "near":
            roots = brute_classes([(i, rows[i]["text"]) for i in sorted(expected)])
            expected = set(roots.values())
        elif step == "leaks":
            patterns = set()
            for r in table(spark, SF, "benchmark").collect():
                patterns |= set(decontam.item_windows(r["text"].encode()))
            words = {i: rows[i]["text"].encode().translate(decontam.ALNUM).split() for i in expected}
            expected = {i for i in expected if not any(tuple(words[i][a : a + 10]) in patterns for a in range(len(words[i]) - 9))}
        if step != "pack":
            assert out.columns == docs.columns
            got = out.collect()
            assert {r["doc_id"] for r in got} == expected and len(got) == len(expected)
            assert all(r == rows[r["doc_id"]] for r in got)
    assert {r["doc_id"] for r in out.collect()} == expected
    assert pipeline.run(spark, SF).count() == out.count()


def test_awkward_rows_pass_every_stage(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in pipeline.STAGES:
            materialise(stage(spark, docs, SF))
    plain = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)], PLAIN)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, plain, SF)
        assert out.columns == plain.columns and out.count() <= 2


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "best_fit_packing"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
