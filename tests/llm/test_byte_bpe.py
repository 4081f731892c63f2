import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from folioscan.llm import byte_bpe as B

from .conftest import odd_rows

PATH, PATTERN = B.tokenizer()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(11)
    alphabet = "aé ' st\n\t\x0b\xa0 　1٣.,!$<|endoftext|>\x1c\x85 İΣ😀é"
    return [None, "", " ", "\n\n\n x", "a" * 9000, "  " * 3000, "x  \n" * 2000, "<|endoftext|>", "it's 'll'd"] + ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 60, 3000]))) for _ in range(80)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 700, "overlap": 150}, {"chunk": 64, "overlap": 16}])
def test_ids_and_round_trip(spark, library, sizes):
    rows = [r[:2] for r in odd_rows() if r[0] != 60 and r[0] is not None and (not sizes or len(r[1] or "") < 80_000)] + [(1000 + i, t) for i, t in enumerate(texts())]
    out = {r["doc_id"]: r for r in B.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN, with_ids=True, **sizes).collect()}
    assert len(out) == len(rows)
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        assert out[d]["ids"] == ids and out[d]["n_tokens"] == len(ids)
        assert out[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_rows_that_repeat_are_kept(odd):
    rows = B.encode(odd, PATH, PATTERN).collect()
    assert len(rows) == len(odd_rows()) and sum(r["doc_id"] == 60 for r in rows) == 2


def test_empty(empty):
    assert B.encode(empty, PATH, PATTERN).count() == 0
