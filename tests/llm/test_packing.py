import random
import zlib

import numpy as np
import pytest

from tidelog.llm import packing as p


def check_plan(histogram, capacity):
    used = {}
    sequences = 0
    plan = p.plan(histogram, capacity)
    assert plan.bound <= plan.sequences
    for n, pattern in plan.all:
        assert n > 0 and 0 < sum(k * a for k, a in pattern.items()) <= capacity
        sequences += n
        for k, a in pattern.items():
            used[k] = used.get(k, 0) + n * a
    assert used == {k: n for k, n in histogram.items() if n}
    return sequences


def test_plans_hold_every_piece_once():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([1, 2, 7, 50, 200])
        histogram = {}
        for _ in range(rng.randrange(120)):
            k = rng.randint(1, capacity)
            histogram[k] = histogram.get(k, 0) + rng.choice([1, 1, 3, 40])
        total = sum(k * n for k, n in histogram.items())
        best = -(-total // capacity)
        assert best <= check_plan(histogram, capacity) <= 1.5 * best + 2
    assert p.plan({}).all == []
    with pytest.raises(ValueError):
        p.plan({p.CAPACITY + 1: 1})


def test_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.6, 1, 20_000).astype(int), 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    bound = -(-int(lengths.sum()) // 4096)
    assert check_plan(histogram, 4096) <= 1.001 * bound + 1


def test_awkward_shapes():
    # thirds and halves that only go together one way
    assert check_plan({6: 10, 5: 10, 4: 10}, 10) == 15
    assert check_plan({2049: 9}, 4096) == 9 and check_plan({1: 4097}, 4096) == 2


def test_lengths_that_cannot_fill_a_sequence():
    # the fullest configuration leaves six tokens free
    assert check_plan({2000: 1000, 1400: 1000, 690: 1000}, 4096) == 1000
    # two of 2040, and two each of 1200 and 800; or one of each
    assert check_plan({2040: 500, 1200: 500, 800: 500}, 4096) == 500
    assert check_plan({2000: 1000, 1400: 1000, 690: 1000, 4096: 7}, 4096) == 1007


def brute_price(lengths, values, capacity):
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(best[c - k] + v for k, v in zip(lengths, values) if k <= c)])
    return best[capacity]


def test_pricing_is_the_best_knapsack():
    rng = random.Random(1)
    for _ in range(40):
        lengths = rng.sample(range(1, 40), rng.randint(1, 12))
        values = [rng.random() for _ in lengths]
        dense = np.full(61, -np.inf)
        dense[lengths] = values
        assert p.price(dense)[60] == pytest.approx(brute_price(lengths, values, 60))


def test_a_round_covers_within_the_tolerance_of_the_best_price():
    rng = np.random.default_rng(4)
    counts = np.zeros(201)
    counts[rng.choice(np.arange(1, 200), 60, replace=False)] = 50
    values = np.where(counts > 0, np.arange(201) * rng.uniform(0.8, 1, 201), -np.inf)
    best = p.price(values)
    uses = p.cover(counts, values, best, 0.01)
    held = np.zeros(201)
    for key, x in uses.items():
        assert x > 0 and sum(k * a for k, a in key) <= 200
        first = max(k for k, _ in key)
        worth = sum(values[k] * a for k, a in key)
        assert any(worth >= values[k] + best[200 - k] - 0.01 * best[200] - 1e-9 for k, _ in key), (first, worth)
        for k, a in key:
            held[k] += x * a
    assert (held >= counts - 1e-6).all()


def test_solution_is_a_cover_and_the_bound_below_it():
    for histogram in ({2500: 1000, 1000: 1500}, {2000: 1000, 1400: 1000, 690: 1000}, {1500: 900, 1300: 900, 1200: 300, 2600: 400}):
        solution = p.solve(histogram)
        for k, n in histogram.items():
            assert sum(x * pattern.get(k, 0) for x, pattern in solution.uses) >= n * (1 - 1e-9)
        assert solution.bound <= solution.sequences + 1e-6
    assert p.plan({2500: 1000, 1000: 1500}).sequences == 1125


@pytest.mark.parametrize("times", [1, 100])
def test_sequences_come_from_the_program(times):
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6.2, 1.1, 8_000).astype(int), 1, 4096)
    histogram = {int(k): int(n) * times for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = p.plan(histogram)
    n = {x: sum(n for n, _ in getattr(plan, x)) for x in ("program", "residue")}
    assert n["program"] > 0.9 * (n["program"] + n["residue"]) and plan.sequences <= 1.01 * plan.bound
    rest = {k: v for k, v in histogram.items() if k < 4096}
    assert plan.sequences - histogram.get(4096, 0) <= sum(n for n, _ in p.best_fit(rest))


def expected_pieces(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(p.tokenizer_path())
    out = []
    for i, t in texts:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            out.append((i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_pieces_and_places(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [(-1, "Don't WE'LL <|endoftext|> x<|ENDOFTEXT|>y áé, É. 12,3.5 foo_bar's 'tis —. \t\x1c\x85z"), (-2, ""), (-4, "Plain UPPER Words <|x with a special look ABC"), (-3, "a,b  c\n\nd")]
    out = p.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr)
    assert got == expected_pieces(texts)
    total = sum(r["length"] for r in out)
    assert check_places(out) <= -(-total // 4096) + 1


def test_capitals_with_marks(spark):
    # pairs that compose in lower case only, alone, with a mark between, and among others
    pairs = ["J\u030c", "T\u0308", "W\u030a", "H\u0331", "Y\u030a"]
    texts = list(enumerate([*pairs, *(f"Some {x}abc, WORD {x}! {x.lower()}" for x in pairs), "J\u0323\u030cA", "J\u0591\u030cA", "E\u0301T\u00c9 A\u0308", "=\u0338 A \u030c"]))
    out = p.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == expected_pieces(texts)


def test_awkward(spark, awkward, nothing):
    out = p.pack(awkward).collect()
    check_places(out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["length"])
    assert by[1] == by[2] == by[3] == [1] and sum(by[4]) == 40_001 and len(by[5]) == 2 and by[None]
    assert p.pack(nothing).count() == 0
