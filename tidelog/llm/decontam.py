"""Benchmark decontamination by Wu-Manber search over words.

The symbols are whole words, as numbers.  Patterns of one length form a group with a shift
table over the hashes of blocks of two words (one word for patterns of one word): a block that no
pattern holds moves the search on by almost a pattern's length; where a block may end
a pattern, the hash of its last three words names a bucket, and direct comparison
of all words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, fresh, map_whole, materialise, own, per_worker, place, rows, utf8

WINDOW = 10
HIT_COLUMNS = ("__n_words", "__spans", "__items")
#: Words and bytes of benchmark text searched for in one pass; a larger benchmark takes several.  A word costs a worker
#: about 25 bytes, and each different word 150 more: at most about 300 MB.
BLOCK_WORDS = 4_000_000
BLOCK_BYTES = 32 << 20
MIX = (0x9E3779B1, 0x85EBCA77)
FOLD = 0x27D4EB2F165667C5
FULL = 0xFFFFFFFFFFFFFFFF


def item_windows(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """An item's windows of consecutive words; a shorter item is one window."""
    words = text.translate(ALNUM).split()
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


@dataclass
class Group:
    """Patterns of one length: shifts by block hash, and bucket hashes in order with where each pattern ends."""

    length: int
    mask: int
    shift: bytes
    keys: array
    ends: array


@dataclass
class Tables:
    """A block of the benchmark: numbers of its words, all its words in a row, where items begin, and its groups."""

    ids: list
    numbers: dict[bytes, int]
    words: array
    starts: array
    groups: list[Group]

    def items_of(self, end: int) -> object:
        return self.ids[bisect_right(self.starts, end - 1) - 1]


def build_tables(items: Iterable[tuple[object, bytes]], window: int = WINDOW) -> Tables:
    """Tables of the items' windows.  Numbers start at 1; 0 is any word that no item has."""
    numbers: dict[bytes, int] = {}
    words, starts, ids = array("I"), array("Q"), []
    ends_of: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        found = text.translate(ALNUM).split()
        if not found:
            continue
        ids.append(item)
        starts.append(len(words))
        length = min(window, len(found))
        ends_of.setdefault(length, []).append(np.arange(len(words) + length, len(words) + len(found) + 1))
        for w in found:
            words.append(numbers.setdefault(w, len(numbers) + 1))
    flat = np.frombuffer(words, np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    groups = []
    for length, parts in sorted(ends_of.items()):
        ends = np.concatenate(parts)
        block, tail = min(2, length), min(3, length)
        size = 1 << max(10, min(28, int(4 * len(ends)).bit_length()))
        most = min(length - block + 1, 255)
        shift = np.full(size, most, np.uint8)
        for back in range(most - 1, -1, -1):  # the least shift of a hash is written last
            shift[_block_hash(flat, ends - back, block) & np.uint64(size - 1)] = back
        keys = np.zeros(len(ends), np.uint64)
        for k in range(tail, 0, -1):
            keys = (keys * np.uint64(FOLD)) ^ flat[ends - k]
        order = np.lexsort((ends, keys))
        groups.append(Group(length, size - 1, shift.tobytes(), array("Q", keys[order].tobytes()), array("Q", ends[order].astype(np.uint64).tobytes())))
    return Tables(ids, numbers, words, starts, groups)


def _block_hash(flat: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    out = flat[ends - 1] * np.uint64(MIX[1])
    return out if block == 1 else out ^ (flat[ends - 2] * np.uint64(MIX[0]))


def search(text_words: list[bytes], tables: Tables) -> Iterator[tuple[int, int, int]]:
    """(start, length, end of the pattern in the tables) of each occurrence."""
    get = tables.numbers.get
    found = array("I", [get(w, 0) for w in text_words])
    n, words = len(found), tables.words
    first, second = MIX
    for group in tables.groups:
        length, mask, shift, keys, ends = group.length, group.mask, group.shift, group.keys, group.ends
        end = length
        tail = min(3, length)
        while end <= n:
            h = found[end - 1] * second
            if length > 1:
                h ^= found[end - 2] * first
            move = shift[h & mask]
            if move:
                end += move
                continue
            key = 0
            for w in found[end - tail : end]:
                key = (key * FOLD & FULL) ^ w
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                own_words = found[end - length : end]
                while at < len(keys) and keys[at] == key:
                    e = ends[at]
                    if words[e - length : e] == own_words:
                        yield end - length, length, e
                    at += 1
            end += 1


def _blocks(benchmark: DataFrame, block_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks of bounded size, read one partition at a time; the driver holds one block."""
    block, size, n_words = [], 0, 0
    for row in benchmark.where("item_id is not null").select("item_id", utf8().alias("text")).toLocalIterator():
        text = bytes(row.text)
        block.append((row.item_id, text))
        size += len(text)
        n_words += len(text.translate(ALNUM).split())
        if n_words >= block_words or size >= block_bytes:
            yield block
            block, size, n_words = [], 0, 0
    yield block


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``documents`` and, last, the number of words, the spans (merged hit words,
    flat start and end) and the ids of occurring items, under ``HIT_COLUMNS`` or names like them.

    A benchmark of any size is searched in blocks of at most ``block_words`` (an item is never parted), each a map over the documents that
    carries on what the blocks before it found; there is no shuffle.  A block's tables are broadcast, at most about 300 MB, and
    held once by a worker; between blocks the documents are written.  Null and empty
    texts have no words.  Items without words or id match nothing; equal items
    all count; input columns may have any names, ids any type.
    """
    counts, spans_, items_ = (fresh(x, documents) for x in HIT_COLUMNS)
    kind = benchmark.schema["item_id"].dataType
    out = documents.withColumns({counts: F.lit(0).cast("long"), spans_: F.lit(None).cast("array<long>"), items_: F.lit(None).cast(T.ArrayType(kind))})
    at = place(documents, "text")
    context = documents.sparkSession.sparkContext
    before = None
    for block in _blocks(benchmark, block_words):
        if before is not None:
            out = materialise(out)
            before.unpersist()
        made = build_tables(block, window)
        # Plain values, as workers needn't have this package.
        before = shared = context.broadcast((made.ids, made.numbers, made.words, made.starts, [(g.length, g.mask, g.shift, g.keys, g.ends) for g in made.groups]))
        del made
        name = ("wu-manber", uuid.uuid4().hex)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            tables = per_worker(name, lambda: Tables(*shared.value[:4], [Group(*g) for g in shared.value[4]]))
            for batch in rows(batches):
                names = batch.schema.names
                n_words, spans, items = [], [], []
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                for text, old_spans, old_items in zip(texts, batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist()):
                    words = (text or b"").translate(ALNUM).split()
                    n_words.append(len(words))
                    found = set(zip((old_spans or [])[::2], (old_spans or [])[1::2]))
                    who = set(old_items or ())
                    for start, length, end in search(words, tables):
                        found.add((start, start + length))
                        who.add(tables.items_of(end))
                    merged: list[int] = []
                    for a, b in sorted(found):
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += [a, b]
                    spans.append(merged)
                    items.append(sorted(who, key=str))
                new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, batch.schema.field(len(names) - 1).type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=names)

        out = map_whole(out, scan)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest: one row per document, none dropped or merged."""
    hits = find_hits(documents.select("doc_id", "text"), benchmark, window)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, sha = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n_hit.append(sum(spans[1::2]) - sum(spans[::2]))
                n_items.append(len(items))
                sha.append(hashlib.sha256(",".join(map(str, items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return hits.select("doc_id", *HIT_COLUMNS).mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, columns as they came."""
    hits = find_hits(documents, benchmark, window)
    return hits.where(F.size(fresh(HIT_COLUMNS[2], documents)) == 0).select(*own(documents))
