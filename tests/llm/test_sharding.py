import zlib

import numpy as np
import pytest

from folioscan.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 1000, 4097])
def test_permutation_is_one_and_inverts(n):
    p = S.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert (S.permute(p, n, back=True) == np.arange(n)).all()
    for i in (0, n // 2, n - 1):
        shard, slot = S.locate(i, n)
        assert S.row_at(shard, slot, n) == i


def test_it_shuffles():
    p = S.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05


def light(df):
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def test_shards_and_slots(odd, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 5)
    rows = S.shard(light(odd), ["doc_id", "size", "text_crc32"]).collect()
    n = odd.count()
    assert sorted(r["row_number"] for r in rows) == list(range(n))
    per = {}
    for r in rows:
        assert (r["shard"], r["slot"]) == S.locate(r["row_number"], n)
        per.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = S.shard(light(odd.repartition(7)), ["doc_id", "size", "text_crc32"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 8} == {zlib.crc32(b"one two")}


def test_empty(empty):
    assert S.shard(light(empty), ["doc_id", "size", "text_crc32"]).count() == 0


def plain_permute(x, n, seed):
    """The Feistel network with cycle walking on Python's integers."""
    mask = (1 << 64) - 1

    def mix(v, key):
        v = (v + key) * 0x9E3779B97F4A7C15 & mask
        v = (v ^ v >> 29) * 0xBF58476D1CE4E5B9 & mask
        return v ^ v >> 32

    half = 1
    while 1 << 2 * half < n:
        half += 1
    keys = [mix(seed + 1 + r, 2 * r + 1) for r in range(S.ROUNDS)]
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for key in keys:
            left, right = right, left ^ (mix(right, key) & (1 << half) - 1)
        x = left << half | right
        if x < n:
            return x


def test_query_rows_match_plain_python(spark, odd, tmp_path):
    """Numbers by sorted keys, the permutation, shards and slots, all anew in plain Python."""
    import zlib

    from .conftest import odd_rows

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    keys = sorted(((d, len(t) + 1, zlib.crc32(t)) for d, t in texts), key=lambda k: (k[0] is not None, k))
    want = []
    for number, (d, size, crc) in enumerate(keys):
        p = plain_permute(number, len(keys), S.SEED)
        want.append((d, size, crc, "rows", p % S.SHARDS, p // S.SHARDS, None, number))
    got = [tuple(r) for r in S.query(spark, str(tmp_path)).collect()]
    light = lambda rows: sorted([r[:3] + r[3:7] for r in rows], key=str)
    assert light(got) == light(want)


def test_many_rows_that_agree_in_all_keys(spark, monkeypatch):
    """They are numbered after the others, by tasks; numbers have no gap and shards differ by one row at most."""
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    rows = [(None, 1, 0, k) for k in range(90)] + [(7, 5, 3, k) for k in range(60)] + [(k, 2, 1, 0) for k in range(100)] + [(200, 2, 1, 0)] * 3
    light = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, other int").repartition(5)
    out = S.shard(light, ["doc_id", "size", "text_crc32"], 4).collect()
    assert sorted(r["row_number"] for r in out) == list(range(len(rows))) and sorted((r["doc_id"], r["other"]) for r in out if r["doc_id"] is not None) == sorted((r[0], r[3]) for r in rows if r[0] is not None)
    assert sorted(r["other"] for r in out if r["doc_id"] is None) == list(range(90)) and {r["row_number"] for r in out if r["size"] != 2} == set(range(103, 253))
    slots = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(4)}
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
