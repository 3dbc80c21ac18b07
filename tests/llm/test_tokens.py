import random

from tidelog.llm import packing, tokens


def greedy(word, initial, inner):
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_against_greedy():
    rng = random.Random(4)
    for _ in range(300):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
        initial, inner = {piece() for _ in range(rng.randint(0, 12))}, {piece() for _ in range(rng.randint(0, 12))}
        automaton = tokens.build_automaton(sorted(initial), sorted(inner))
        for _ in range(40):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 15)))
            assert tokens.count_pieces(automaton, word) == greedy(word, initial, inner), (word, initial, inner)


def test_whole_texts(spark, awkward, nothing):
    vocabulary = tokens.piece_vocabulary(packing.tokenizer_path("byte_bpe_50k.json"))
    initial, inner = map(set, vocabulary)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    memory = {}
    for r in tokens.count_tokens(documents, vocabulary).collect():
        words = texts[r["doc_id"]].encode().split()
        for w in words:
            memory.setdefault(w, greedy(b" " + w, initial, inner))
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(memory[w] for w in words), 0)
    out = tokens.count_tokens(awkward, vocabulary).collect()
    assert len(out) == 9 and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert tokens.count_tokens(nothing, vocabulary).count() == 0
    unknown = tokens.count_tokens(spark.createDataFrame([(1, "ab zz")], "doc_id long, text string"), ([b" a"], [b"b"])).first()
    assert (unknown["n_tokens"], unknown["n_unknown"]) == (3, 1)
