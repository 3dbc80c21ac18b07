"""Quality rules: base counts and divergence from language references.

Two histograms of each document - of character classes and of common words - are held
against those of its language by the Jensen-Shannon distance.  The references are
counts over all documents, less the document's own; a text that is too short for a histogram is not judged by it.  A language
of few documents or words is no reference: its documents are held against the nearest one that is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, fresh, map_whole, own, place, rows, utf8

#: A worker's word ids; beyond it they are dealt anew, between two documents.
VOCABULARY = 300_000
SPACE = [9, 10, 11, 12, 13, 32]
SYMBOLS = list(b"#*$%&|<>")
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "control", "beyond_ascii")
UNKNOWN = "und"
#: Numbers of a language beside its words: classes, words, documents.
TOTALS = len(CLASSES) + 2


def _class_of(byte: int) -> int:
    if byte in SPACE:
        return 3
    if byte in SYMBOLS:
        return 4
    if byte >= 0xC0:
        return 7
    if byte < 32 or byte >= 127:
        return 6
    c = chr(byte)
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Distances are in bits, from 0 to 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 48
    max_class_distance: float = 0.30
    max_word_distance: float = 0.36
    #: The fewer words, the further a text strays from its language by chance: the limit grows by this over their number.
    short_text: float = 2.5
    #: A text with fewer code points isn't judged by classes, with fewer words by words.
    min_chars: int = 200
    min_common: int = 50
    #: A language of fewer documents or words is no reference.
    min_documents: int = 30
    min_reference_words: int = 3000


@dataclass(frozen=True)
class Reference:
    """A language's counts: character classes, its most common words, all words, documents."""

    classes: list[float]
    words: dict[bytes, float]
    total: float
    documents: float

    def supported(self, rules: Rules) -> bool:
        return self.documents >= rules.min_documents and self.total >= rules.min_reference_words


def language(column: str = "lang") -> F.Column:
    """Two or three lower-case letters, or ``und``: at most 18,253 values."""
    code = F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(code == "", UNKNOWN).otherwise(code)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if a side is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, 0.5 * (p[a] * np.log2(p[a] / m[a])).sum() + 0.5 * (q[b] * np.log2(q[b] / m[b])).sum())))


class WordIds(dict):
    """Ids of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def _byte_classes() -> np.ndarray:
    """256 x classes; bytes that go on a code point count for none."""
    m = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        if not 0x80 <= b < 0xC0:
            m[b, _class_of(b)] = 1
    return m


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more; each counts once."""
    if len(ids) < 4:
        return 0
    base = int(ids.max()) + 1
    if base < 2_000_000:
        code = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        code = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    ordered = np.sort(code)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    hit = np.isin(code, ordered[1:][same])
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def fit_references(documents: DataFrame, rules: Rules = Rules()) -> dict[str, Reference]:
    """For each language with enough documents and words: its counts.  Null and unknown languages make no reference.

    A mark that stands alone often enough is a word too: texts that are full of it then stand out.
    Counts cover every whole text.  Each task counts by itself, in one pass (class and word totals
    go along as words with a space, which no text has); only its sums are exchanged, and the most common words are chosen in two steps, so that the words of
    one large language are never ordered in one task.  What reaches the driver is at
    most 18,253 languages times ``common_words`` and the classes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_class, ids, sums, chars, texts = _byte_classes(), WordIds(), {}, {}, Counter()

        def flush() -> pa.RecordBatch:
            names = list(ids)
            lang, word, n = [], [], []
            for k, total in sums.items():
                (at,) = np.nonzero(total)
                lang += [k] * len(at)
                word += [names[i] for i in at]
                n += total[at].tolist()
            for k, total in chars.items():
                lang += [k] * TOTALS
                word += [b" %d" % i for i in range(TOTALS)]
                n += [*(total @ to_class).tolist(), int(sums[k].sum()), texts[k]]
            ids.clear(), sums.clear(), chars.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in rows(batches):
            spoken: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spoken.setdefault(lang, []).extend(text.translate(LOWER).split())
                texts[lang] += 1
                chars[lang] = chars.get(lang, 0) + np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            for lang, words in spoken.items():
                found = np.bincount(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), minlength=1)
                total = sums.get(lang, found[:0])
                if len(total) < len(found):
                    total = np.concatenate([total, np.zeros(max(len(found), 2 * len(total)) - len(total), np.int64)])
                total[: len(found)] += found
                sums[lang] = total
            if len(ids) > VOCABULARY:
                yield flush()
        yield flush()

    counts = documents.select(language().alias("lang"), utf8().alias("text")).where(F.col("lang") != UNKNOWN).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.withColumns({"kind": F.when(F.substring("word", 1, 1) == F.lit(b" "), 1).otherwise(0), "salt": F.pmod(F.hash("word"), F.lit(64))})
    most = F.when(F.col("kind") == 1, TOTALS).otherwise(rules.common_words)
    by_task = Window.partitionBy("lang", "kind", "salt").orderBy(F.desc("n"), "word")
    near = counts.withColumn("place", F.row_number().over(by_task)).where(F.col("place") <= most)
    top = near.withColumn("place", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word"))).where(F.col("place") <= most)
    found: dict = {}
    for row in top.collect():
        totals, words = found.setdefault(row["lang"], ([0.0] * TOTALS, {}))
        word = bytes(row["word"])
        if row["kind"]:
            totals[int(word[1:])] = float(row["n"])
        else:
            words[word] = float(row["n"])
    references = {lang: Reference(totals[:-2], words, *totals[-2:]) for lang, (totals, words) in found.items()}
    return {lang: r for lang, r in references.items() if r.supported(rules)}


def _judge(references: dict[str, Reference], rules: Rules, own: bool = True):
    """text bytes, language -> the columns of ``score``.  ``own``: the references hold the texts that are judged."""
    to_class, ids = _byte_classes(), WordIds()
    space = np.zeros(256, bool)
    space[SPACE] = True
    symbol = np.zeros(256, bool)
    symbol[SYMBOLS] = True
    lead = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
    ready = {lang: (np.array(r.classes), list(r.words), np.array([max(0.0, r.total - sum(r.words.values())), *r.words.values()])) for lang, r in references.items()}
    every = list(ready)

    def judge(text: bytes, lang: str) -> tuple:
        words = text.split()
        if len(ids) > VOCABULARY:
            ids.clear()
        number = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        lines = [x for x in text.split(b"\n") if x.strip()]
        n_repeat = repeated_words(number)
        n = len(words)
        failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
        classes = at @ to_class
        n_chars = int(classes.sum())
        class_distance = word_distance = None
        # A text of a known language is part of that language's counts, and leaves them for the comparison.
        names, mine = ([lang], own) if lang in ready else (every, False)
        if n_chars >= rules.min_chars and names:
            class_distance = min(js_distance(classes.astype(float), np.maximum(0.0, ready[x][0] - mine * classes)) for x in names)
        if n >= rules.min_common and names:
            said = Counter(text.translate(LOWER).split())
            word_distance = 1.0
            for x in names:
                common = [said[w] for w in ready[x][1]]
                counts = np.array([n - sum(common), *common], float)
                word_distance = min(word_distance, js_distance(counts, np.maximum(0.0, ready[x][2] - mine * counts)))
        far = (class_distance is not None and class_distance > rules.max_class_distance) or (word_distance is not None and word_distance > rules.max_word_distance + rules.short_text / n)
        return n, int(at[lead & ~space].sum()), int(at[symbol].sum()), len(lines) - len(set(lines)), n_repeat, failed, not failed and not far, class_distance, word_distance

    return judge


SCORE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def score(documents: DataFrame, references: dict[str, Reference], rules: Rules = Rules(), own: bool = True) -> DataFrame:
    """Counts, distances and verdict for each document; a map without a shuffle.

    Words are runs without ASCII white space.  Null and empty texts have no words and
    fail the base rule.  A distance is null where its guard on length says that the text is too
    short, or there is no reference, and then does not count against it.  A language without a reference is held against
    the nearest one.  ``own`` says that the references were counted from these documents: each leaves its language's counts when it is compared.
    Repeated rows get a row each; only ``doc_id``, ``lang`` and ``text`` are read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(references, rules, own)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for batch in rows(batches):
            found = list(zip(*(judge(t, x) for t, x in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))], names=["doc_id", *re.findall(r"(\w+) (?:long|boolean|double)", SCORE)])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", language().alias("lang"), utf8().alias("text")).mapInArrow(apply, f"doc_id {kind}, {SCORE}")


def keep_good(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with the columns and rows they came with."""
    references = fit_references(documents, rules)
    code = documents.withColumn(fresh("__lang", documents), language())
    at = place(documents, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(references, rules)
        for batch in rows(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            langs = batch.column(batch.num_columns - 1).to_pylist()
            yield batch.filter(pa.array([judge(t or b"", x)[6] for t, x in zip(texts, langs)], pa.bool_()))

    return map_whole(code, apply).select(*own(documents))
