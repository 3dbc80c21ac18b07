"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles.  One that occurs n times weighs 1 + log2 n: so a
text that says one line over and over is not like every other text that does.
Each shingle is a Poisson process whose rate is its weight: an arrival goes to a
random register and wins it if it is the register's earliest.  Arrivals later than every register's
winner can't matter, so a shingle stops there.  Two texts agree in a register
with the probability of their probability Jaccard similarity.

A text with repeated shingles is signed a second time with all weights 1, whose registers agree with the
probability of plain Jaccard.  Without repeats both signatures are one, so texts of either kind
meet.  Equal bands, of either signature, make candidates.  Members of a bucket are verified against its least member first,
which joins most groups with one pair a member.  Where a bucket then still holds
several classes, its members are compared further: a bucket of at most one block by a product of their
shingle matrices; the texts of larger ones are signed again, with more registers and longer bands that part what
is not alike, and only buckets that are then still large are compared block by block.  What comes out is which classes are joined, so
no group emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, fresh, materialise, own, per_worker, rows

SHINGLE = 5
SIMILAR = 0.8
#: Texts of probability or plain Jaccard 0.8 share no band with a probability of (1 - 0.8 ** 4) ** 24, about 3e-6.
BANDS, ROWS = 24, 4
#: For texts of large buckets: they share no band with a probability of (1 - 0.8 ** 8) ** 64, about 8e-6.
FINE_BANDS, FINE_ROWS = 64, 8
#: A key's rows are dealt into so many parts wherever they meet.
SALTS = 1024
LEADER_SALTS = 32
REMEMBERED = 300_000
#: Words handled at once.
CHUNK_WORDS = 400_000
#: Texts, and bytes of their shingles, of one block of a large bucket; cells of a matrix.
BLOCK_MEMBERS = 1024
BLOCK_BYTES = 16 << 20
MATRIX_CELLS = 4_000_000
GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ELEMENT_BITS = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(texts: list[bytes], known: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle, how often), ordered, each shingle of a text once.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case
    (A-Z).  A text of fewer words, but not none, is one shingle.  Shingles are 48-bit hashes.
    """
    words = [t.translate(ALNUM).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(lengths), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(n)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        inside = place + k < end
        step = flat[np.minimum(place + k, n - 1)]
        h = np.where(inside, mix(h + GOLDEN) ^ (step + np.uint64(k)), h)
    whole = (place + size <= end) | (place == start) & (end - start < size)
    code = (owner[whole].astype(np.uint64) << np.uint64(ELEMENT_BITS)) | (mix(h[whole]) >> np.uint64(64 - ELEMENT_BITS))
    code, count = np.unique(code, return_counts=True)
    return (code >> np.uint64(ELEMENT_BITS)).astype(np.int64), code & np.uint64((1 << ELEMENT_BITS) - 1), count


def weigh(count: np.ndarray) -> np.ndarray:
    """The weight of a shingle by how often it occurs."""
    return 1 + np.log2(count)


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers: the shingle that wins each register (0 for texts without shingles)."""
    time = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    at, e, w, x = owner, element, weight, np.zeros(len(owner))
    last = np.full(n, np.inf)
    k = 0
    while len(at):
        k += 1
        r = mix(e + np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        alive = x < last[at]
        if not alive.all():
            at, e, w, x, r = at[alive], e[alive], w[alive], x[alive], r[alive]
        cell = at * registers + (mix(r + GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, cell, x)
        won = x == time[cell]
        winner[cell[won]] = e[won]
        busy = np.unique(at)
        last[busy] = time.reshape(n, registers)[busy].max(1)
        alive = x < last[at]
        at, e, w, x = at[alive], e[alive], w[alive], x[alive]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """n x bands keys."""
    cut = signature.reshape(len(signature), bands, per_band)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]) * GOLDEN
    for k in range(per_band):
        key = mix(key ^ cut[:, :, k]) + GOLDEN
    return mix(key)


def similarity(a: bytes, b: bytes) -> tuple[float, float]:
    """(probability Jaccard of the weighted sets, Jaccard of the sets) of two packed texts."""
    x, y = np.frombuffer(a, np.int64).reshape(2, -1), np.frombuffer(b, np.int64).reshape(2, -1)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0.0
    plain = len(i) / (x.shape[1] + y.shape[1] - len(i))
    all_u, all_v = weigh(x[1]), weigh(y[1])
    u, v = all_u[i], all_v[j]
    ratio = u / v
    # Sum over all shingles of max(a_j / a_i, b_j / b_i): those with a greater ratio count by a, the others by b.
    order = np.argsort(ratio, kind="stable")
    ratio, u, v = ratio[order], u[order], v[order]
    a_from = np.concatenate([np.cumsum(u[::-1])[::-1], [0.0]])
    b_to = np.concatenate([[0.0], np.cumsum(v)])
    cut = np.searchsorted(ratio, ratio, side="left")
    only_a, only_b = all_u.sum() - u.sum(), all_v.sum() - v.sum()
    return float((1 / ((a_from[cut] + only_a) / u + (b_to[cut] + only_b) / v)).sum()), plain


def keys_of_texts(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, bands: int, per_band: int) -> list[np.ndarray]:
    """Band keys of each of n texts, by the weights of its shingles and, where one repeats, by weights of 1 too.

    None for a text without shingles.
    """
    sign = lambda o, e, w, m: band_keys(prob_minhash(o, e, w, m, bands * per_band), bands, per_band).view(np.int64)
    has = np.bincount(owner, minlength=n) > 0
    keys = [k if h else k[:0] for k, h in zip(sign(owner, element, weigh(count), n), has)]
    repeats = np.unique(owner[count > 1])
    at = np.isin(owner, repeats)
    plain = sign(np.searchsorted(repeats, owner[at]), element[at], np.ones(int(at.sum())), len(repeats))
    for i, k in zip(repeats.tolist(), plain):
        keys[i] = np.union1d(keys[i], k)
    return keys


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 5
        if size >= CHUNK_WORDS or i - start >= 4096:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signatures(documents: DataFrame, bands: int = BANDS, per_band: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Rows ``doc_id, node, bands``: ``node`` is the text's MD5, null for null texts.

    ``bands`` is empty for texts without words.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("words", WordHashes)
        for batch in rows(batches, 4096):
            keys: list = []
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for cut in _chunks(texts):
                few = texts[cut]
                owner, element, count = shingles(few, known, size)
                keys += keys_of_texts(owner, element, count, len(few), bands, per_band)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(sign, f"doc_id {kind}, node binary, bands array<long>")


def verify(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar: probability or plain Jaccard of ``similar``.  Other columns go along.

    A leader of very many pairs meets them in ``LEADER_SALTS`` parts.
    """
    more = [c for c in pairs.columns if c not in ("a", "b")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            last = batch.num_columns - 1
            keep = [max(similarity(a, b)) >= similar for a, b in zip(batch.column(last - 1).to_pylist(), batch.column(last).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[: last - 1], names=["a", "b", *more]).filter(pa.array(keep, pa.bool_()))

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(LEADER_SALTS)).cast("int"))
    leaders = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b").join(leaders, ["a", "salt"])
    return both.select("a", "b", *more, "x", "y").mapInArrow(check, ", ".join(f"{c} binary" for c in ("a", "b", *more)))


def class_links(first: list[tuple[bytes, bytes, bytes]], second: list[tuple[bytes, bytes, bytes]] | None, similar: float) -> list[tuple[bytes, bytes]]:
    """Classes that links join, within ``first`` or between it and ``second``: each with the least of them.

    Members are (node, root, packed).  Shared shingles of all pairs are a matrix product over the shingles
    that more than one member has; texts with repeated shingles are compared exactly where
    the shared part of their weight allows a link.
    """
    members = first + (second or [])
    n, split = len(members), len(first)
    sets = [np.frombuffer(p, np.int64).reshape(2, -1) for _, _, p in members]
    sizes = np.array([x.shape[1] for x in sets], float)
    names, roots = np.unique(np.array([r.hex() for _, r, _ in members]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    _, column, count = np.unique(np.concatenate([x[0] for x in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([weigh(x[1]) / max(1, weigh(x[1]).sum()) for x in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    at = shared[column]
    owner, column, weight = owner[at], number[column[at]], weight[at]
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    repeated = np.array([bool((x[1] > 1).any()) for x in sets])
    both, mass = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    width = max(1, MATRIX_CELLS // n)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((n, width), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        both += has @ has.T
        if repeated.any():
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - low] = weight[a:b]
            mass += part @ has.T
    same = roots[:, None] == roots[None, :]
    other = ~same
    if second is not None:
        other[:split, :split] = False
        other[split:, split:] = False
    exact = both.astype(float)
    near = other & (exact >= similar * (sizes[:, None] + sizes[None, :] - exact))
    maybe = np.triu(other & ~near & (repeated[:, None] | repeated[None, :]) & (np.minimum(mass, mass.T) >= similar - 1e-4))
    # The least member that each is joined to, by way of links and of classes.
    joined, least = near | same, np.arange(n)
    while True:
        lower = np.where(joined, least[None, :], n).min(1)
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    for i, j in np.argwhere(maybe):
        if least[i] != least[j] and max(similarity(members[i][2], members[j][2])) >= similar:
            least = np.where(least == max(least[i], least[j]), min(least[i], least[j]), least)
    head = {}
    for i in np.lexsort((roots, least)):
        head.setdefault(least[i], roots[i])
    out = {(head[x], r) for x, r in zip(least.tolist(), roots.tolist()) if head[x] != r}
    return [(bytes.fromhex(str(names[a])), bytes.fromhex(str(names[b]))) for a, b in sorted(out)]


def _keyed(rows_: DataFrame, *sums) -> DataFrame:
    """``key, salt`` and, for each of them, the key's totals of ``sums``: a hot key's rows never meet in one task.

    Each sum is (name, partial aggregate, how parts are put together).  Parts are aggregated first, so a key brings at most ``SALTS`` rows.
    """
    parts = rows_.groupBy("key", "salt").agg(*(part.alias(name) for name, part, _ in sums))
    every = Window.partitionBy("key")
    return parts.select("key", "salt", *(put(name).over(every).alias(name) for name, _, put in sums))


def salted(rows_: DataFrame) -> DataFrame:
    return rows_.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def buckets_of(spread: DataFrame) -> DataFrame:
    """``key, salt, leader, node`` for keys of two texts or more; the leader is the least."""
    spread = salted(spread)
    tops = _keyed(spread, ("leader", F.min("node"), F.min), ("most", F.max("node"), F.max)).where("leader != most").select("key", "salt", "leader")
    return materialise(spread.join(tops, ["key", "salt"]).select("key", "salt", "leader", "node"))


def still_open(buckets: DataFrame, state: DataFrame) -> DataFrame:
    """``key, salt, node, root, n``: members of buckets of three or more that hold several classes."""
    labelled = buckets.join(state, "node", "left").select("key", "salt", "node", F.coalesce("root", "node").alias("root"))
    found = _keyed(labelled, ("least", F.min("root"), F.min), ("most", F.max("root"), F.max), ("n", F.count("*"), F.sum)).where("least != most and n > 2").select("key", "salt", "n")
    return materialise(labelled.join(found, ["key", "salt"]))


def across(members: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Classes ``a, b`` that meet in a bucket and are joined there; members are ``key, salt, node, root``.

    A bucket is one group of at most ``BLOCK_MEMBERS`` texts and ``BLOCK_BYTES``; a larger one is dealt into blocks
    that are compared two at a time, so a task's memory doesn't grow with the bucket.
    No pair of members is emitted, only each joined class with the least it is joined to.
    """
    full = members.join(sets, "node")
    sizes = _keyed(full, ("n", F.count("*"), F.sum), ("bytes", F.sum(F.octet_length("packed")), F.sum))
    blocks = sizes.select("key", "salt", F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = full.join(blocks, ["key", "salt"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "node", "root", "packed")

    def link(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        rows_ = list(zip(*(group.column(x).to_pylist() for x in ("own", "node", "root", "packed"))))
        first = [r[1:] for r in rows_ if r[0] == low]
        found = class_links(first, None if low == high else [r[1:] for r in rows_ if r[0] == high], similar)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return paired.groupBy("key", "low", "high").applyInArrow(link, "a binary, b binary").distinct()


def fine_keys(sets: DataFrame, bands: int = FINE_BANDS, per_band: int = FINE_ROWS) -> DataFrame:
    """``node, key`` of packed texts by longer bands of more registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            texts = [np.frombuffer(p, np.int64).reshape(2, -1) for p in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(texts)), [x.shape[1] for x in texts])
            element, count = (np.concatenate([x[i] for x in texts]) for i in (0, 1))
            keys = keys_of_texts(owner, element.view(np.uint64), count, len(texts), bands, per_band)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "bands"])

    return sets.select("node", "packed").mapInArrow(sign, "node binary, bands array<long>").select("node", F.explode("bands").alias("key"))


def _sets(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, packed`` for the given texts (``node, doc``): shingles and their counts as int64."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("words", WordHashes)
        for batch in rows(batches, 4096):
            packed: list[bytes] = []
            texts = batch.column(1).to_pylist()
            for cut in _chunks(texts):
                few = texts[cut]
                owner, element, count = shingles(few, known, size)
                bounds = np.searchsorted(owner, np.arange(len(few) + 1))
                packed += [element[a:b].view(np.int64).tobytes() + count[a:b].astype(np.int64).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "packed"])

    texts = documents.where("text is not null").select(F.col("doc_id").alias("__doc"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.col("text").cast("binary").alias("text"))
    chosen = nodes.select("node", F.col("doc").alias("__other"))
    one = texts.join(chosen, "node").where(F.col("__doc").eqNullSafe(F.col("__other"))).select("node", "text")
    return materialise(one.mapInArrow(make, "node binary, packed binary").dropDuplicates(["node"]))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the least node it is joined to.

    Each round a node takes the least root among its neighbours', and then its root's root;
    every round is materialised.  Rounds grow with the logarithm of a chain's length.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    state = labels if labels is not None else materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        offers = both.join(state.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        # A root hears of the least root that any of its nodes was offered.
        hooked = state.join(offers, "node", "left").select("node", "root", F.coalesce(F.least("root", "offer"), "root").alias("offer"))
        hooked = materialise(hooked)
        moved = hooked.where("offer < root").groupBy(F.col("root").alias("node")).agg(F.min("offer").alias("hook"))
        raised = materialise(hooked.join(moved, "node", "left").select("node", F.least("offer", F.coalesce("hook", "offer")).alias("root"), F.col("root").alias("was")))
        up = raised.select(F.col("node").alias("root"), F.col("root").alias("top"))
        state = materialise(raised.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was"))
        if state.where("root != was").isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")


def _stars(buckets: DataFrame) -> DataFrame:
    """Each member with its bucket's leader."""
    return buckets.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def _joined(state: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after links between classes; members (``node, root``) of classes of one text are in no state yet."""
    links = materialise(links)
    if links.isEmpty():
        return state
    tops = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = state.select("node", "root").union(members.select("node", "root")).distinct()
    return materialise(every.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def classes(documents: DataFrame, similar: float = SIMILAR, bands: int = BANDS, per_band: int = ROWS, size: int = SHINGLE, large: int = BLOCK_MEMBERS) -> DataFrame:
    """Rows ``doc_id, class_id, is_kept, node`` (the text's MD5): one per document.

    Documents are in one class if verified links join their texts, equal texts always;
    ``class_id`` is the class's least doc_id.  A null text is a class with no other (its own doc_id);
    texts without words are one class with equal ones only.  Of a class one text under one id
    is kept; repeated rows of it all say so.  Texts of buckets of more than ``large`` that one leader doesn't join are signed again.  No links, classes or signatures reach the driver.
    """
    signed = materialise(signatures(documents, bands, per_band, size))
    # Distinct texts; copies of one text meet as counts, not as rows.
    nodes = materialise(signed.where("node is not null").groupBy("node", "bands").agg(F.min("doc_id").alias("doc")))
    buckets = buckets_of(nodes.select("node", F.explode("bands").alias("key")))
    sets = _sets(documents, nodes.join(buckets.select("node").distinct(), "node").select("node", "doc"), size)
    state = components(materialise(verify(_stars(buckets), sets, similar)))
    members = still_open(buckets, state)
    state = _joined(state, members, across(members.where(F.col("n") <= large), sets, similar))
    crowd = members.where(F.col("n") > large)
    if not crowd.isEmpty():
        few = sets.join(crowd.select("node").distinct(), "node")
        spread = fine_keys(few).join(state, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        spread = materialise(salted(spread))
        tops = _keyed(spread, ("lead", F.min(F.struct("node", "root")), F.min), ("most", F.max("node"), F.max)).where("lead.node != most")
        buckets = materialise(spread.join(tops, ["key", "salt"]).select("key", "salt", "node", "root", "lead"))
        apart = buckets.where("root != lead.root").select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.root").alias("a_root"), F.col("root").alias("b_root")).distinct()
        links = verify(apart, sets, similar).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
        state = _joined(state, buckets, links)
        members = still_open(buckets.select("key", "salt", "node"), state)
        state = _joined(state, members, across(members, sets, similar))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node"))
    # Written apart, so that rows of a large class can be split in the join; a lone text goes by its own name, not by null.
    ids = materialise(nodes.join(state, "node").groupBy("root").agg(first.alias("keeper")))
    keeper = lambda x: F.when(F.col("keeper").isNotNull(), F.col(f"keeper.{x}")).otherwise(F.col("doc" if x == "doc" else "node"))
    rooted = nodes.join(state, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(ids, "root", "left").select("node", keeper("doc").alias("class_id"), keeper("node").alias("keeper_node"))
    out = signed.select("doc_id", "node").where("node is not null").join(named, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper_node"))
    # Null texts stay where they are: as keys of the join they would meet in one task.
    lone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_kept"), "node")
    return out.select("doc_id", "class_id", F.coalesce(kept, F.lit(False)).alias("is_kept"), "node").union(lone)


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each class, the one of the least id, columns as they came.

    Null texts all stay; equal rows of one id fall together.
    """
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    doc, text, times = (fresh(x, documents) for x in ("__kept", "__node", "__times"))
    kept = classes(documents, **options).where("is_kept and node is not null").groupBy(F.col("doc_id").alias(doc), F.col("node").alias(text)).agg(F.count("*").alias(times))
    kept = materialise(kept)
    found = documents.where("text is not null").join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (node == F.col(text)))
    once = found.where(F.col(times) == 1).select(*own(documents))
    again = found.where(F.col(times) > 1).dropDuplicates(["doc_id", text]).select(*own(documents))
    return once.union(again).union(documents.where("text is null").select(*own(documents)))
