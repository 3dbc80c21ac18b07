"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation of a word costs one pass over its bytes: the
vocabulary's trie gets a failure link per node and the number of pieces popped
when that link is taken, so the count needs no piece to be built and no byte to
be read twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_worker, rows, utf8

#: Words whose counts a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000


def build_automaton(initial: Iterable[bytes], inner: Iterable[bytes]) -> dict:
    """Trie with failure links for pieces that open a word and for those inside one.

    ``initial`` pieces match at a word's start, ``inner`` ones after it.  Node 0 is
    the word's start, node 1 the start of an inner piece.  ``link[v]`` is the
    node that stands for the part of v's text left after the longest pieces in it are
    popped, ``pops[v]`` their number; ``link[v]`` is -1 where nothing can be popped.
    """
    go: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
    for root, pieces in ((0, initial), (1, inner)):
        for piece in pieces:
            at = root
            for byte in piece:
                nxt = go[at].get(byte)
                if nxt is None:
                    nxt = len(go)
                    go[at][byte] = nxt
                    go.append({})
                    final.append(False)
                    parent.append((at, byte))
                at = nxt
            if at != root:
                final[at] = True
    link, pops = [-1] * len(go), [0] * len(go)
    queue = [*go[0].values(), *go[1].values()]
    for v in queue:
        queue.extend(go[v].values())
        if final[v]:
            link[v], pops[v] = 1, 1
            continue
        up, byte = parent[v]
        z, n = link[up], pops[up]
        while z >= 0 and byte not in go[z]:
            n += pops[z]
            z = link[z]
        if z >= 0:
            link[v], pops[v] = go[z][byte], n
    return {"go": go, "link": link, "pops": pops}


def count_pieces(automaton: dict, word: bytes) -> int | None:
    """Pieces of the greedy longest-match segmentation; None if there is none."""
    go, link, pops = automaton["go"], automaton["link"], automaton["pops"]
    at, n = 0, 0
    for byte in word:
        nxt = go[at].get(byte)
        while nxt is None:
            if link[at] < 0:
                return None
            n += pops[at]
            at = link[at]
            nxt = go[at].get(byte)
        at = nxt
    while at > 1:
        if link[at] < 0:
            return None
        n += pops[at]
        at = link[at]
    return n


class Counts(dict):
    """Pieces of a word behind a space, -1 where it has no segmentation; made once a word."""

    def __init__(self, automaton: dict):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = count_pieces(self.automaton, b" " + word)
        self[word] = n = -1 if n is None else n
        return n


def piece_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Opening and inner pieces of a byte-level vocabulary file.

    Its marker for a leading space opens a word.  A word without an opening
    piece of its own starts with the marker alone, so each word has a segmentation.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    pieces = [bytes(byte_of[c] for c in piece) for piece in vocab if all(c in byte_of for c in piece)]
    return [p for p in pieces if p.startswith(b" ")], [p for p in pieces if not p.startswith(b" ")]


def count_tokens(documents: DataFrame, vocabulary: tuple[list[bytes], list[bytes]]) -> DataFrame:
    """Rows ``doc_id, n_words, n_tokens, n_unknown``, one per input row.

    Words are runs without ASCII white space; each is counted with a space before
    it.  A word without a segmentation is one unknown token.  Null and
    empty texts have zero of each; repeated rows and null ids are kept; other columns
    are not read, so their names cannot clash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        initial, inner = vocabulary
        known = per_worker(("tokens", hash((tuple(initial), tuple(inner)))), lambda: Counts(build_automaton(initial, inner)))
        for batch in rows(batches):
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(known.__getitem__, text.split()))
                unknown = counts.count(-1)
                n_words.append(len(counts))
                n_tokens.append(sum(counts) + 2 * unknown)
                n_unknown.append(unknown)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_unknown, pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", utf8().alias("text")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
