import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.functions import embedders, identity, text, vector
from gleanworks.operators.chunking import ChunkConfig, split_text


def test_fixed_fingerprints():
    assert identity.chunking_fingerprint() == "f56a1a8ab205a132a4cd26adb7f573e33db5b8eed2cdd2dfab188cda9ebc1ad8"
    assert identity.ingestion_fingerprint("txt") == "15067b7860453f708c8ac589f56242ae7917013239b6af7ff7da1ca8e28bf213"
    assert identity.ingestion_fingerprint("markdown") == "f486b2273aaa821f4fc5bdb4951c7f772600da92e2c41d6a03cb24ec9754a3aa"
    assert identity.ingestion_fingerprint("html") == "80143770633cdb9772e224dd395fe58200eafe1eb68d6cc17b9686fa0228e1f2"


def test_source_id(spark):
    got = spark.range(1).select(identity.source_id(F.lit("/docs/a.md")).alias("x")).first().x
    assert got == "4cf97c17f2e7c09a9649a37e9b8d88404fde6f853502a3186aa3355cffd2da25"


def test_hash_place():
    assert embedders.hash_embedder().place("w:tcp") == (112, -1.0)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("raw", ["  a b\n", "　全角　", "\x1c x \x85", "", "a"])
def test_strip(spark, raw):
    assert one(spark, text.strip(F.lit(raw))) == raw.strip()


def test_text_columns(spark):
    assert one(spark, text.normalize_newlines(F.lit("甲\r\n乙\r丙"))) == "甲\n乙\n丙"
    assert one(spark, text.collapse(F.lit(" a\n\t b\x0bc "))) == "a b c"
    assert one(spark, text.safe_truncate(F.lit("abc def"), F.lit(5))) == "abc…"
    assert one(spark, text.safe_truncate(F.lit("abc"), F.lit(1))) == "a"
    assert tuple(one(spark, text.heading(F.lit("## A b ##")))) == (2, "A b") == text.heading_of("## A b ##")
    assert one(spark, text.heading(F.lit("####### x"))) is None
    assert one(spark, text.ordered_distinct(F.array(*map(F.lit, (" b", "a", "b", " "))))) == ["b", "a"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vector.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert not one(spark, vector.valid(F.array(F.lit(1.0), F.lit(float("nan"))), 2))


def test_embedders():
    h, c = embedders.hash_embedder(96), embedders.chinese_embedder(128)
    for e in (h, c):
        v = np.array(e.embed("滑动窗口 sliding window 3.14"))
        assert np.linalg.norm(v) == pytest.approx(1) and e.embed("") == [0.0] * e.dimension
    a, b = (np.array(c.embed(x)) for x in ("什么是窗口？", "什么是窗口?"))
    assert a @ b > 0.8
    assert embedders.create_embedder("zh").fingerprint == "chinese:chinese-ngram-v1:d512"
    assert embedders.create_embedder("local", 64).fingerprint == "hash:hash-v1:d64"
    for bad in (lambda: embedders.hash_embedder(8), lambda: embedders.chinese_embedder(32), lambda: embedders.create_embedder("no")):
        with pytest.raises(ValueError):
            bad()
    assert dict(embedders.ngram_features("!? ")) == {"symbol:!?": 0.25}
    assert [f for f, _ in embedders.word_features("abc")] == ["w:abc", "c2:ab", "c2:bc", "c3:abc"]
    assert ("b:甲乙", 0.9) in embedders.word_features("甲x乙")


def test_remote_embedder():
    r = embedders.RemoteEmbedder("e", "m", lambda t: [(1, [2.0]), (0, [1.0])])
    assert r.embed_batch(["a", "b"]) == [[1.0], [2.0]] and r.fingerprint == "openai:e:m"
    with pytest.raises(ValueError):
        r.embed_batch(["a"])


def test_split():
    text_ = "x" * 40
    got = split_text(text_, ChunkConfig(12, 3))
    assert all(len(p) <= 12 for p, _, _ in got) and got[0][0][-3:] == got[1][0][:3] and got[-1][2] == 40
    body = "  " + "word. " * 300
    for p, a, b in split_text(body, ChunkConfig(100, 10)):
        assert body[a:b] == p
    slow = "a" * 50 + "." + "b" * 200
    starts = [a for _, a, _ in split_text(slow, ChunkConfig(100, 90))]
    assert all(y > x for x, y in zip(starts, starts[1:]))
    assert split_text(" \n ") == []
    with pytest.raises(ValueError):
        ChunkConfig(10, 10)
