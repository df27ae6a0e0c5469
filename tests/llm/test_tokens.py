"""Token ids: the same as the plain library's, and an exact way back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegraph.llm import tokens


@pytest.fixture(scope="module")
def encoding():
    with open(tokens.RANK_FILE, "rb") as file:
        return tokens._encoding(file.read())


TEXTS = [None, "", " ", "\n\n", "don't stop", "naïve café 42%", "日本語 テキスト", "🙂👩‍💻", "<|endoftext|>", "a" * 9000, " " * 9000 + "x", "word " * 40_000, "x\r\ny\tz", "\x00\x1c​"]


def test_ids_and_way_back(spark, encoding):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id int, text string, ids string")
    out = df.withColumn("ids", tokens.encoder(spark)("text")).withColumn("n", tokens.token_counter(spark)("text")).withColumn("raw", tokens.decoder(spark)("ids"))
    rows = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i].ids == (encoding.encode_ordinary(text) if text else [])
        assert rows[i].n == len(rows[i].ids)
        assert bytes(rows[i].raw) == (text or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert df.select(tokens.encoder(spark)("text").alias("ids")).collect() == []
    assert df.select(F.size(tokens.encoder(spark)("text"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé🙂  \x1c.,-"), max_size=80), st.integers(1, 20))
def test_cuts_change_nothing(text, size):
    with open(tokens.RANK_FILE, "rb") as file:
        encoding = tokens._encoding(file.read())
    parts = tokens.pieces(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
