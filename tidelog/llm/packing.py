"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence.  The covering
program - use the fewest configurations that hold each length as often as it occurs - is
solved approximately by multiplicative weights.  Every length has a price: its tokens times a weight.  A knapsack
dynamic program over all lengths gives the best value of any configuration under these prices; a round covers each length once by
configurations that are read off its table within a tolerance of that best, and lengths that were covered beyond their count lose weight.
The average of the rounds, scaled by the least coverage, is the program's solution, and the prices over the best value are a
bound below it.  Rounding takes whole uses of its configurations while their pieces last; the program is solved again for
the residue, and what then is left is packed by best fit.  All this
works on the histogram (at most ``capacity`` numbers), whatever the corpus holds; the rows
then find their places by rank within their length, without meeting on one machine.
"""

from __future__ import annotations

import math
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, per_worker, rows, utf8

CAPACITY = 4096
#: Rounds of multiplicative weights, their step, and how far below the best value a configuration may lie.
ROUNDS = 12
STEP = 1.0
TOLERANCE = 0.001
#: The program is solved again for a residue, so often at most and while rounding places this share of its tokens.
RESIDUES = 12
LEAST_SHARE = 0.05
#: Chunks of text whose ids a worker remembers; beyond it the memory is emptied.
REMEMBERED = 500_000
#: ASCII punctuation that joins neither a letter nor a digit before it (the apostrophe does).
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# --- the program on the histogram ---------------------------------------------------


def price(values: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: the best value of a configuration of at most c tokens, for each c.

    ``values`` holds the price of each length from 0 on, and less than none where there is no such length.
    """
    best = np.zeros(len(values))
    for c in range(1, len(values)):
        best[c] = max(best[c - 1], (values[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def cover(counts: np.ndarray, values: np.ndarray, best: np.ndarray, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Uses of configurations that hold each length as often as it occurs: a round's answer to the prices.

    A configuration starts with the longest length that is not yet covered, and goes on with lengths that keep it within the
    tolerance of the best one that holds the first; those not yet covered come first, long before short.
    """
    left = counts.astype(float)
    uses: dict[tuple, float] = {}
    slack = tolerance * best[-1]
    for seed in range(len(counts) - 1, 0, -1):
        while left[seed] > 1e-9:
            pattern, room, lost = {seed: 1}, len(counts) - 1 - seed, 0.0
            while room > 0:
                # Never more of a length than there are pieces.
                reach = values[1 : room + 1] + best[room - 1 :: -1]
                for full in [k for k, a in pattern.items() if k <= room and a >= counts[k]]:
                    reach[full - 1] = -np.inf
                near = reach >= best[room] - (slack - lost)
                at = np.flatnonzero(near & (left[1 : room + 1] > 1e-9))
                if not len(at):
                    at = np.flatnonzero(near) if best[room] > 0 else at
                if not len(at):  # the best fill would take more than there is
                    reach = np.where(left[1 : room + 1] > 1e-9, reach, -np.inf)
                    at = np.flatnonzero(reach > -np.inf)[-1:]
                if not len(at):
                    break
                k = int(at[-1]) + 1
                lost += max(0.0, float(best[room] - reach[k - 1]))
                pattern[k] = pattern.get(k, 0) + 1
                room -= k
            x = min(left[k] / a for k, a in pattern.items() if left[k] > 1e-9)
            for k, a in pattern.items():
                left[k] = max(0.0, left[k] - x * a)
            key = tuple(sorted(pattern.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + x
    return uses


@dataclass(frozen=True)
class Solution:
    """A fractional cover of the histogram: uses of configurations, and a bound below any cover."""

    uses: list[tuple[float, dict[int, int]]]
    bound: float

    @property
    def sequences(self) -> float:
        return sum(x for x, _ in self.uses)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP) -> Solution:
    """The configuration program by multiplicative weights, most used configurations first."""
    counts = np.zeros(capacity + 1)
    for k, n in histogram.items():
        counts[k] = n
    there = counts > 0
    covered, total, bound, done = np.zeros(capacity + 1), {}, 0.0, 0
    while done < rounds:
        excess = np.where(there, covered / np.maximum(counts, 1) - done, 0.0)
        values = np.where(there, np.arange(capacity + 1) * np.exp(-step * excess), -np.inf)
        best = price(values)
        bound = max(bound, float((counts[there] * values[there]).sum() / best[-1]))
        uses = cover(counts, values, best)
        done += 1
        for key, x in uses.items():
            total[key] = total.get(key, 0.0) + x
            for k, a in key:
                covered[k] += x * a
        if sum(uses.values()) <= bound * (1 + TOLERANCE):  # as good as it gets: this round alone
            total, covered, done = uses, covered * 0 + counts, 1
            break
    least = float((covered[there] / counts[there]).min()) if there.any() else 1.0
    return Solution(sorted(((x / least, dict(key)) for key, x in total.items()), key=lambda x: (-x[0], sorted(x[1].items(), reverse=True))), bound)


def _fill(rest: dict[int, int], live: np.ndarray, capacity: int) -> dict[int, int]:
    """Best fit on the histogram: the longest pieces that still fit, one after another."""
    pattern: dict[int, int] = {}
    room = capacity
    end = len(live)
    while room > 0 and end > 0:
        end = int(np.searchsorted(live[:end], room, side="right"))
        if not end:
            break
        length = int(live[end - 1])
        n = min(rest[length], room // length)
        pattern[length] = n
        room -= n * length
        end -= 1
    return pattern


Configurations = list[tuple[int, dict[int, int]]]


def _take(rest: dict[int, int], n: int, pattern: dict[int, int], out: Configurations) -> None:
    out.append((n, pattern))
    for k, a in pattern.items():
        rest[k] -= n * a
        if not rest[k]:
            del rest[k]


def rounded(rest: dict[int, int], solution: Solution) -> Configurations:
    """Whole uses of the solution's configurations, rounded up while their pieces last; ``rest`` loses them."""
    out: Configurations = []
    for x, pattern in solution.uses:
        n = min(math.ceil(x - 1e-9), *(rest.get(k, 0) // a for k, a in pattern.items()))
        if n > 0:
            _take(rest, n, pattern, out)
    return out


def best_fit(rest: dict[int, int], capacity: int = CAPACITY) -> Configurations:
    """Best fit, longest pieces first, a configuration at a time; ``rest`` is used up."""
    out: Configurations = []
    while rest:
        pattern = _fill(rest, np.array(sorted(rest), np.int64), capacity)
        _take(rest, max(1, min(rest[k] // a for k, a in pattern.items())), pattern, out)
    return out


@dataclass(frozen=True)
class Plan:
    """Configurations by where they come from; together they hold every piece exactly once."""

    whole: Configurations
    program: Configurations
    residue: Configurations
    bound: int

    @property
    def all(self) -> Configurations:
        return self.whole + self.program + self.residue

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.all)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The program's configurations, rounded, for the histogram and then for each residue, and best fit for the last one.

    Pieces of the full capacity need no packing.  ``bound`` is below the sequences of any packing.  Only if best fit alone
    needs fewer sequences, its plan is taken.  The plan's size depends on the number of distinct lengths, not of pieces.
    """
    rest = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in rest):
        raise ValueError("lengths lie between 1 and the capacity")
    whole = [(rest.pop(capacity), {capacity: 1})] if capacity in rest else []
    n_whole = sum(n for n, _ in whole)
    if not rest:
        return Plan(whole, [], [], n_whole)
    alone = best_fit(dict(rest), capacity)
    program: Configurations = []
    bound = 0.0
    for _ in range(RESIDUES):
        before = _volume(rest)
        if not before:
            break
        solution = solve(rest, capacity, rounds if not program else 1)
        bound = bound or solution.bound
        program += rounded(rest, solution)
        if _volume(rest) > (1 - LEAST_SHARE) * before:
            break
    residue = best_fit(rest, capacity)
    bound = n_whole + math.ceil(bound - 1e-6)
    if sum(n for n, _ in alone) < sum(n for n, _ in program + residue):
        return Plan(whole, [], alone, bound)
    return Plan(whole, program, residue, bound)


def _volume(rest: dict[int, int]) -> int:
    return sum(k * n for k, n in rest.items())


def runs(configurations: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a sequence, first sequence, offset): ranks of a length
    go to a configuration's sequences in turn."""
    table, used, first = [], {}, 0
    for n, pattern in configurations:
        offset = 0
        for length, a in sorted(pattern.items(), reverse=True):
            table.append((length, used.get(length, 0), a, first, offset))
            used[length] = used.get(length, 0) + n * a
            offset += a * length
        first += n
    return sorted(table)


# --- pieces -------------------------------------------------------------------------


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids(dict):
    """Packed token ids of a chunk of text, made once a chunk."""

    def __init__(self, tokenizer: str):
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed as little-endian")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.coder = Tokenizer.from_file(tokenizer)
        self.model = self.coder.model

    def __missing__(self, chunk: bytes) -> bytes:
        body = chunk.rstrip(TAIL)
        if not chunk:
            packed = b""
        elif chunk.isalpha() and chunk.islower():  # one pre-token of letters that stand for themselves
            packed = array("I", [t.id for t in self.model.tokenize(chunk.decode())]).tobytes()
        elif len(body) < len(chunk) and body[-1:].isalnum() and b"<|" not in chunk:
            packed = self[body] + self[chunk[len(body) :]]
        else:
            packed = array("I", self.coder.encode(chunk.decode("utf-8"), add_special_tokens=False).ids).tobytes()
        self[chunk] = packed
        return packed


def chunks(text: bytes) -> list[bytes]:
    """What lies between spaces and line ends, A-Z in lower case where that leaves the ids the same.

    The tokenizer lowers case itself, but for its special tokens, after it has composed: a letter and a mark
    (U+0300 to U+037F, first byte CC or CD) may compose in lower case alone, so chunks with marks stay.
    """
    text = text.replace(b"\n", b" ")
    if b"<|" in text:
        return text.split(b" ")
    lower = text.lower().split(b" ")
    if b"\xcc" in text or b"\xcd" in text:
        return [x if b"\xcc" in x or b"\xcd" in x else y for x, y in zip(text.split(b" "), lower)]
    return lower


def cut_pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, __task, __rank``.

    No token of this tokenizer reaches over a space or a line end, nor from a letter or digit to
    punctuation, so chunks between those are encoded once and remembered.  ``__rank`` counts a task's pieces of one length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(("packing", tokenizer), lambda: Ids(tokenizer))
        ranks, task = {}, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in rows(batches):
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(map(known.__getitem__, chunks(text))) + end
                for p, a in enumerate(range(0, len(ids), width)):
                    own = ids[a : a + width]
                    n = len(own) // 4
                    doc.append(i)
                    piece.append(p)
                    start.append(a // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(ranks.get(n, 0))
                    ranks[n] = rank[-1] + 1
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(doc), pa.int64()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "__task", "__rank"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", utf8().alias("text")).mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, __task long, __rank long")


def pack(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as it can.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Null and empty texts are the one token ``end_id``; only texts of more than ``capacity`` tokens
    are cut; repeated rows are packed each; an empty table gives no rows.  Only the
    histogram (at most ``capacity`` rows) and the plan made of it reach the driver.
    """
    pieces = materialise(cut_pieces(documents, tokenizer or tokenizer_path(), end_id, capacity))
    by_task = pieces.groupBy("__task", "length").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = runs(plan(histogram, capacity, rounds).all)
    columns = [np.array(x, np.int64) for x in zip(*where)] or [np.zeros(0, np.int64)] * 5
    shift = 45

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first_rank, each, first, offset = columns
        keys = (lengths << shift) + first_rank
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            k = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(first[at] + k // each[at]), pa.array(offset[at] + (k % each[at]) * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before.select("__task", "length", "before"), ["__task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.coalesce("before", F.lit(0))).alias("rank"))
    kind = dict(documents.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
