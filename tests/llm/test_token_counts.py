import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscan.llm import common
from folioscan.llm import token_counts as T

from .conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> <|startoftext|>x", "<|ENDOFTEXT|>", "a  b\n\nc\x1cd", "İstanbul ΑΣ ﬁ", "word's it'll 12345", "é" * 500]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_library_s_and_are_cached(spark, odd, library):
    rows = [r[:2] for r in odd_rows()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cache = common.new_table(spark, "test-cache")
    want = sorted([(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows], key=str)
    for _ in range(2):
        got = [tuple(r) for r in T.count_tokens(docs, PATH, cache).collect()]
        assert sorted(got, key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() < len(rows)


def test_only_misses_are_encoded(spark, monkeypatch):
    cache = common.new_table(spark, "test-cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    T.count_tokens(docs, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    T.count_tokens(docs.union(spark.createDataFrame([(4, "d")], docs.schema)), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 3


def test_empty(spark, empty):
    assert T.count_tokens(empty, PATH, common.new_table(spark, "test-cache")).count() == 0
