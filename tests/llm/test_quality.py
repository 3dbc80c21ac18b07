import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import quality as q
from tidelog.llm.queries import ORACLE_SQL, QUERIES

from .conftest import unchanged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_columns_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_distribution_divergence"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_repeats_with_any_spaces():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", " ", "\t", "\n", "\x0b", "\x85", "#", "🐢"]) for _ in range(rng.randrange(80)))
        judged = q._judge({}, q.Rules())(text.encode(), "en")
        assert judged[:6] == plain(text)
    ids = np.array([5_000_000, 1, 2, 5_000_000, 1, 2, 7])
    assert q.repeated_words(ids) == 6


def test_distance():
    p = np.array([1.0, 0, 0])
    assert q.js_distance(p, p) == 0 and q.js_distance(p, np.array([0, 2.0, 0])) == pytest.approx(1)
    assert q.js_distance(p, np.zeros(3)) == 0
    a, b = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (a + b) / 2
    assert q.js_distance(a, b) ** 2 == pytest.approx(0.5 * (a * np.log2(a / m)).sum() + 0.5 * (b * np.log2(b / m)).sum())


def test_references_count_every_word(spark):
    rows = [(1, "The the cat sat", "EN"), (2, "the dog | |", "en-GB"), (3, "le chat", "fr"), (4, None, "fr"), (5, "x y", None)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = q.fit_references(rows, q.Rules(common_words=2, min_documents=1, min_reference_words=1))
    assert out["en"].words == {b"the": 3.0, b"|": 2.0} and out["en"].total == 8 and out["en"].documents == 2 and set(out) == {"en", "fr"}
    assert out["en"].classes[q.CLASSES.index("symbol")] == 2 and out["fr"].documents == 2
    assert set(q.fit_references(rows, q.Rules(min_documents=2, min_reference_words=3))) == {"en"}


def plain_js(p, q_):
    p, q_ = [x / sum(p) for x in p], [x / sum(q_) for x in q_]
    m = [(x + y) / 2 for x, y in zip(p, q_)]
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0.0, (part(p) + part(q_)) / 2))


def test_distances_against_brute_force(spark):
    """Small tables: a document is compared with the others of its language, or with the nearest reference."""
    rng = random.Random(2)
    words = {"en": ["the", "of", "and", "cat", "Dog", "sea"], "fr": ["le", "la", "été", "chat", "mer"], "xx": ["q1", "#", "z!"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(2, 60))), lang) for i, lang in enumerate(rng.choices(["en", "fr", "xx"], [5, 5, 1], k=40))]
    rules = q.Rules(min_chars=30, min_common=10, common_words=3, min_documents=10, min_reference_words=20, min_words=5, max_repeat_percent=100)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lower = {i: text.lower().split() for i, text, _ in rows}
    top = {x: [w for w, _ in sorted(Counter(w for i, _, k in rows if k == x for w in lower[i]).items(), key=lambda c: (-c[1], c[0].encode()))[:3]] for x in ("en", "fr")}
    kinds = [str.islower, str.isupper, str.isdigit, str.isspace, lambda c: c in "#*$%&|<>"]

    def classes(text):
        out = [sum(c.isascii() and f(c) for c in text) for f in kinds]
        beyond = sum(not c.isascii() for c in text)
        return [*out, len(text) - sum(out) - beyond, 0, beyond]

    def histogram(own, x):
        said = [sum(w == t for w in own) for t in top[x]]
        return [len(own) - sum(said), *said]

    for r in q.score(frame, q.fit_references(frame, rules), rules).collect():
        _, text, lang = rows[r["doc_id"]]
        found = []
        for x in [lang] if lang in top else ["en", "fr"]:
            others = [(t, lower[i]) for i, t, k in rows if k == x and i != r["doc_id"]]
            found.append((plain_js(classes(text), [sum(c) for c in zip(*(classes(t) for t, _ in others))]), plain_js(histogram(lower[r["doc_id"]], x), [sum(c) for c in zip(*(histogram(w, x) for _, w in others))])))
        far = [min(d) for d in zip(*found)]
        n = len(lower[r["doc_id"]])
        assert r["class_distance"] == (pytest.approx(far[0]) if len(text) >= 30 else None) and r["word_distance"] == (pytest.approx(far[1]) if n >= 10 else None)
        assert r["kept"] == (n >= 5 and (len(text) < 30 or far[0] <= 0.3) and (n < 10 or far[1] <= 0.36 + 2.5 / n))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = c.execute(ORACLE_SQL["op3_distribution_divergence"])
    names = [d[0] for d in cursor.description]
    got = QUERIES["op3_distribution_divergence"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cursor.fetchall())


def test_junk_under_a_code_of_its_own(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(9)
    junk = " ".join("".join(rng.choices("bcdfgklmnprstvz", k=7)) for _ in range(400))
    more = spark.createDataFrame([(-1, junk, "zy"), (-2, junk, None), (-3, junk, "en")], documents.schema)
    by = {r["doc_id"]: r for r in q.score(documents.union(more), q.fit_references(documents.union(more))).where("doc_id < 0").collect()}
    assert not any(r["kept"] for r in by.values()) and all(r["word_distance"] > 0.4 for r in by.values())


def test_keeps_good_rejects_divergent(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_distribution_divergence"](spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in got if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in got if labels[r["doc_id"]] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_awkward(spark, awkward, nothing):
    out = {r["doc_id"]: r for r in q.score(awkward, q.fit_references(awkward)).collect()}
    assert out[1]["n_words"] == out[2]["n_words"] == out[3]["n_words"] == 0 and out[1]["base_failed"]
    assert out[4]["n_words"] == 40_000 and out[4]["n_repeat_words"] == 40_000
    assert q.score(awkward, {}).count() == 9 and q.score(nothing, q.fit_references(nothing)).count() == 0
    kept = q.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == 0 and q.keep_good(nothing).count() == 0
    varied = awkward.limit(1).withColumn("text", F.lit(" ".join(f"w{i}" for i in range(120))))
    kept = q.keep_good(varied)
    assert unchanged(kept, varied) and kept.count() == 1
