import pytest
from pyspark.sql import functions as F

from tidelog.llm import common


def test_shared_folder_and_tidying(spark):
    frame = common.materialise(spark.range(5))
    assert frame.count() == 5 and common.WRITTEN[-1].startswith(spark.conf.get("spark.checkpoint.dir"))
    other = common.materialise(frame.where("id > 2"))
    assert common.tidy(spark, common.WRITTEN[-2:-1]) == 1 and other.count() == 2
    assert common.tidy(spark) > 0 and common.WRITTEN == []


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="share"):
        common.shared_dir(Session())


def test_ids_may_be_texts(spark):
    from tidelog.llm import licenses, packing, quality, sharding, tokens, toxicity

    rows = spark.createDataFrame([("a", "some text here"), (None, None)], "doc_id string, text string").withColumn("lang", F.lit("en"))
    vocabulary = tokens.piece_vocabulary(packing.tokenizer_path("byte_bpe_50k.json"))
    for out in (tokens.count_tokens(rows, vocabulary), licenses.scan(rows), packing.pack(rows), quality.score(rows, {}), toxicity.score(rows, toxicity.Model()), sharding.shard(rows)):
        assert out.schema["doc_id"].dataType.simpleString() == "string" and out.count() == 2


def test_names(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, `A.b` int")
    assert common.fresh("A", frame) == "A_" and frame.select(*common.own(frame)).columns == frame.columns and common.place(frame, "a.b") == 1


def test_words_are_those_of_the_pattern():
    import re

    text = "".join(chr(c) for c in range(0, 0x250)) + "ßẞ—🐢"
    lower = text.translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    assert [w.decode() for w in text.encode().translate(common.ALNUM).split()] == words
