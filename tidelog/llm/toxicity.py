"""Toxic spans by a linear-chain conditional random field.

The labels mark whole documents, so the field's labelled tokens are made first: a word is
toxic if its document is marked and it has a marker (the word, or its first four to
eight letters) that is found with many different neighbours in toxic documents and much less in others.
The field learns weights of markers, of the words beside a marker and of transitions from these by maximum
likelihood, so what a marker is worth depends on where else it and its neighbours are found.  Scoring runs forward-backward over every whole text: words without a known feature share one
potential, so a run of them is a power of one 2 x 2 matrix, exact and independent of its length.
The marginals of a document's words aggregate to its score and its offending offsets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, map_whole, place, rows, utf8

#: The training sample: at most so many labelled documents, none longer than so many characters.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 30_000
MIN_CONTEXTS = 4
CHANCE = 0.5
#: The share of toxic documents among those with a marker; its likelihood is held against the share among all.
MARKED = 0.8
#: Training documents in which a neighbour must stand beside a marker.
MIN_BESIDE = 3
#: Words of a training chain.
CHAIN = 24
REMEMBERED = 300_000
SPAN_AT = 0.5


@dataclass
class Model:
    """Weights: features to log potentials of the toxic state, transitions, calibration."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 00, 01, 10, 11
    calibration: tuple[float, float, float] = (-3.0, 0.0, 0.0)


def features(word: bytes) -> list[bytes]:
    """The word itself and its prefixes of four to eight letters."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + text[:n].encode() for n in (4, 5, 6, 7, 8) if len(text) >= n)]


def beside(words: list[bytes], i: int) -> tuple[bytes, bytes]:
    """Features of the words before and after a word with a marker: their first four letters, nothing at an end of the text."""
    short = lambda w: w.decode("utf-8", "replace")[:4].encode()
    return b"<" + (short(words[i - 1]) if i else b""), b">" + (short(words[i + 1]) if i + 1 < len(words) else b"")


def held_out(column: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """(text, toxic) of at most ``most`` labelled documents, chosen by a hash of the id.

    The bound makes both the broadcast and what the driver gets at most
    ``most`` rows.  Rows of null id or label, and of the held-out fold, are not used.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    texts = documents.select(F.col("doc_id"), utf8().alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    return sorted({(bytes(r["text"]), int(r["toxic"] > 0)) for r in texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()})


def pick_features(sample: list[tuple[list[bytes], int]]) -> set[bytes]:
    """Features that mark toxic words.

    The documents with a marker must speak for a share of ``MARKED`` toxic ones against the share among all, so strongly that, over
    all features tried, ``CHANCE`` such features are expected if toxicity fell at random.  It must also stand between enough different
    neighbours, so that copies of one document are no evidence.
    """
    toxic, other = defaultdict(int), defaultdict(int)
    n, features_of = [0, 0], FeaturesOf()
    for words, label in sample:
        n[label] += 1
        count = toxic if label else other
        for f in {f for w in set(words) for f in features_of[w]}:
            count[f] += 1
    share = min(max(n[1] / max(1, sum(n)), 1e-3), 0.5)
    needed = math.log(max(1, len(toxic))) - math.log(CHANCE)
    gain, loss = math.log(MARKED / share), math.log((1 - MARKED) / (1 - share))
    likely = {f for f, c in toxic.items() if c * gain + other[f] * loss >= needed}
    enough = max(MIN_CONTEXTS, math.ceil(needed / gain / 2))
    contexts: dict[bytes, set] = defaultdict(set)
    for words, label in sample:
        for i, w in enumerate(words) if label else ():
            for f in features_of[w]:
                if f in likely and len(contexts[f]) < enough:
                    contexts[f].add((words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""))
    return {f for f in likely if len(contexts[f]) >= enough}


def _chains(sample: list[tuple[list[bytes], int]], strong: set[bytes]) -> dict[tuple, int]:
    """Distinct chains of (features, label) with how often they occur; words with a marker have features of those beside them."""
    counts: dict[tuple, int] = defaultdict(int)
    markers = FeaturesOf()
    documents: dict[bytes, int] = defaultdict(int)
    near = []
    for words, _ in sample:
        for w in words:
            if w not in markers:
                markers[w] = tuple(f for f in features(w) if f in strong)
        at = {i: beside(words, i) for i, w in enumerate(words) if markers[w]}
        for f in {f for fs in at.values() for f in fs}:
            documents[f] += 1
        near.append(at)
    for (words, label), at in zip(sample, near):
        own = [markers[w] + tuple(f for f in at[i] if documents[f] >= MIN_BESIDE) if i in at else () for i, w in enumerate(words)]
        marks = [int(bool(label) and bool(fs)) for fs in own]
        for a in range(0, len(words), CHAIN):
            counts[tuple(zip(own[a : a + CHAIN], marks[a : a + CHAIN]))] += 1
    return counts


def train_field(chains: dict[tuple, int], rounds: int = 120, rate: float = 0.3, l2: float = 1e-4) -> tuple[dict[bytes, float], float, tuple]:
    """Maximum likelihood by Adam steps on exact forward-backward gradients."""
    items = list(chains.items())
    names = sorted({f for chain, _ in items for fs, _ in chain for f in fs})
    index = {f: i for i, f in enumerate(names)}
    n, size = len(items), CHAIN
    weight = np.array([math.log1p(c) if not any(y or fs for fs, y in chain) else c for chain, c in items], float)
    mask, gold = np.zeros((n, size), bool), np.zeros((n, size), int)
    at, what = [], []
    for i, (chain, _) in enumerate(items):
        for t, (fs, y) in enumerate(chain):
            mask[i, t], gold[i, t] = True, y
            for f in fs:
                at.append(i * size + t)
                what.append(index[f])
    at, what = np.array(at, int), np.array(what, int)
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pairs = mask[:, 1:] & mask[:, :-1]
    gold_pair = np.zeros(4)
    np.add.at(gold_pair, (2 * gold[:, :-1] + gold[:, 1:])[pairs], np.broadcast_to(weight[:, None], pairs.shape)[pairs])
    total = weight.sum()
    for step in range(1, rounds + 1):
        emit = theta[len(names)] + np.bincount(at, theta[what], n * size).reshape(n, size) if len(at) else np.full((n, size), theta[len(names)])
        psi = np.where(mask[..., None], np.stack([np.ones((n, size)), np.exp(np.clip(emit, -30, 30))], -1), 1.0)
        T = np.exp(np.clip(theta[-4:], -10, 10)).reshape(2, 2)
        forward, backward = np.ones((n, size, 2)), np.ones((n, size, 2))
        forward[:, 0] = psi[:, 0] / psi[:, 0].sum(-1, keepdims=True)
        for t in range(1, size):
            a = (forward[:, t - 1] @ T) * psi[:, t]
            forward[:, t] = np.where(mask[:, t, None], a / a.sum(-1, keepdims=True), forward[:, t - 1])
        for t in range(size - 2, -1, -1):
            b = (psi[:, t + 1] * backward[:, t + 1]) @ T.T
            backward[:, t] = np.where(mask[:, t + 1, None], b / b.sum(-1, keepdims=True), 1.0)
        node = forward * backward
        node /= node.sum(-1, keepdims=True)
        grad = np.zeros_like(theta)
        error = np.where(mask, (gold - node[..., 1]) * weight[:, None], 0.0)
        if len(at):
            grad[: len(names)] = np.bincount(what, error.ravel()[at], len(names))
        grad[len(names)] = error.sum()
        joint = forward[:, :-1, :, None] * T * (psi * backward)[:, 1:, None, :]
        joint /= joint.sum((-1, -2), keepdims=True)
        grad[-4:] = gold_pair - (joint * (pairs * weight[:, None])[..., None, None]).sum((0, 1)).ravel()
        grad = grad / total * 100 - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return dict(zip(names, theta.tolist())), float(theta[len(names)]), tuple(theta[-4:].tolist())


class FeaturesOf(dict):
    """Features by word, made once."""

    def __missing__(self, word: bytes) -> list[bytes]:
        self[word] = out = features(word)
        return out


class Scorer:
    """Marginals of whole texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.T = np.exp(np.array(model.trans)).reshape(2, 2)
        self.neutral = math.exp(model.bias)
        step = self.T * np.array([1.0, self.neutral])  # into a word without features
        self.powers = [np.eye(2)]
        for _ in range(40):  # step ** (2 ** k), scaled
            self.powers.append(step if len(self.powers) == 1 else self.powers[-1] @ self.powers[-1])
            self.powers[-1] = self.powers[-1] / self.powers[-1].sum()
        self.runs: dict[int, np.ndarray] = {0: np.eye(2)}

        weights, remembered = model.weights, REMEMBERED

        class Known(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) >= remembered:
                    self.clear()
                self[word] = x = sum(weights.get(f, 0.0) for f in features(word))
                return x

        self.known = Known()

    def run(self, n: int) -> np.ndarray:
        """The scaled matrix of n words without features."""
        got = self.runs.get(n)
        if got is None:
            got = np.eye(2)
            for k in range(n.bit_length()):
                if n >> k & 1:
                    got = got @ self.powers[k + 1]
                    got = got / got.sum()
            if len(self.runs) < 10_000:
                self.runs[n] = got
        return got

    def marginals(self, words: list[bytes]) -> dict[int, float]:
        """Word -> marginal of the toxic state, for words with features and their neighbours."""
        extra = list(map(self.known.__getitem__, words))
        if not any(extra):
            return {}
        weights = self.model.weights
        for i, x in enumerate(extra):
            if x:
                extra[i] = x + sum(weights.get(f, 0.0) for f in beside(words, i)) or 1e-300
        active = sorted({j for i, x in enumerate(extra) if x for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        psi = [np.array([1.0, math.exp(min(60.0, max(-60.0, self.model.bias + extra[i])))]) for i in active]
        gaps = [active[0], *(b - a - 1 for a, b in zip(active, active[1:])), len(words) - active[-1] - 1]
        start = np.array([1.0, 1.0])
        if gaps[0]:  # the first word has no transition into it
            start = np.array([1.0, self.neutral]) @ self.run(gaps[0] - 1) @ self.T
        forward = []
        a = start
        for k, p in enumerate(psi):
            if k:
                a = a @ self.run(gaps[k]) @ self.T
            a = a * p
            a = a / a.sum()
            forward.append(a)
        b = self.run(gaps[-1]) @ np.ones(2)
        out = {}
        for k in range(len(active) - 1, -1, -1):
            both = forward[k] * b
            out[active[k]] = float(both[1] / both.sum())
            if k:
                b = self.run(gaps[k]) @ (self.T @ (psi[k] * b))
                b = b / b.sum()
        return out

    def document(self, text: bytes) -> tuple[float, float, dict[int, float]]:
        """(logit of the greatest marginal, log of 1 + the expected toxic words, marginals)."""
        found = self.marginals(text.translate(ALNUM).split())
        if not found:
            return -8.0, 0.0, found
        top = min(1 - 1e-9, max(1e-9, max(found.values())))
        return max(-8.0, min(8.0, math.log(top / (1 - top)))), math.log1p(sum(found.values())), found

    def probability(self, logit: float, expected: float) -> float:
        a, b, c = self.model.calibration
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * logit + c * expected))))


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Train on the bounded sample.  Without toxic or without other rows the model knows no
    feature: without toxic ones it gives every text their smoothed share, and without any
    others, as when nothing is labelled, the low prior of ``Model``, so no document is dropped."""
    once: dict[bytes, bytes] = {}  # a word of the sample is one object
    sample = [([once.setdefault(w, w) for w in text.translate(ALNUM).split()], label) for text, label in training_sample(documents, labels, most)]
    n_toxic = sum(y for _, y in sample)
    share = (n_toxic + 0.5) / (len(sample) + 1)
    prior = math.log(share / (1 - share))
    if not 0 < n_toxic < len(sample):
        return Model() if n_toxic == len(sample) else Model(calibration=(prior, 0.0, 0.0))
    weights, bias, trans = train_field(_chains(sample, pick_features(sample)))
    scorer = Scorer(Model(weights, bias, trans))
    x = np.array([[1.0, *_signals(scorer, words)] for words, _ in sample])
    y = np.array([label for _, label in sample], float)
    beta = np.array([prior, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
    return Model(weights, bias, trans, tuple(beta.tolist()))


def _signals(scorer: Scorer, words: list[bytes]) -> tuple[float, float]:
    return scorer.document(b" ".join(words))[:2]


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Code-point offsets of the words."""
    out, at, chars = [], 0, 0
    spaced = text.translate(ALNUM)
    for word in spaced.split():
        a = spaced.find(word, at)
        chars += sum(1 for x in text[at:a] if not 0x80 <= x < 0xC0)
        length = sum(1 for x in word if not 0x80 <= x < 0xC0)
        out.append((chars, chars + length))
        at, chars = a + len(word), chars + length
    return out


def spans(text: bytes, marginals: dict[int, float], at_least: float = SPAN_AT) -> list[dict]:
    """Runs of words whose marginal reaches ``at_least``, with offsets in code points."""
    hit = sorted(i for i, p in marginals.items() if p >= at_least)
    if not hit:
        return []
    offsets, out = word_offsets(text), []
    last = -2
    for i in hit:
        if i == last + 1:
            out[-1] |= {"stop": offsets[i][1], "marginal": max(out[-1]["marginal"], marginals[i])}
        else:
            out.append({"start": offsets[i][0], "stop": offsets[i][1], "marginal": marginals[i]})
        last = i
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted, n_spans, spans``: one per document.

    Null and empty texts get the score of a text without features; repeated rows get a row
    each; only ``doc_id`` and ``text`` are read, ``doc_id`` for ``held_out`` alone.
    A map without a shuffle; the model holds what a bounded sample gave it.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows(batches):
            scores, found = [], []
            for text in batch.column(2).to_pylist():
                logit, expected, marginals = scorer.document(text)
                scores.append(scorer.probability(logit, expected))
                found.append(spans(text, marginals))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array([len(x) for x in found], pa.int32()), pa.array(found, SPANS)],
                names=["doc_id", "held_out", "score", "predicted", "n_spans", "spans"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), utf8().alias("text")).mapInArrow(
        apply, f"doc_id {kind}, held_out boolean, score double, predicted int, n_spans int, spans array<struct<start:long,stop:long,marginal:double>>"
    )


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, columns as they came."""
    at = place(documents, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            keep = [scorer.probability(*scorer.document(t or b"")[:2]) < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_whole(documents, apply)
