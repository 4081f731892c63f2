import hashlib
import re

import pytest

from folioscan.llm import substring_dedup as S

from .conftest import odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    tokens = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in tokens:
        if d is not None:
            for k in range(len(w) - 49):
                h = tuple(w[k : k + 50])
                first[h] = min(first.get(h, d), d)
    out = []
    for d, w in tokens:
        gone = [False] * len(w)
        if d is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < d:
                    gone[k : k + 50] = [True] * 50
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_matches_brute_force(spark):
    rows = [r[:2] for r in odd_rows()]
    base = words(9, 400).split()
    for i, (lo, n, shift) in enumerate([(0, 49, 3), (5, 50, 0), (7, 51, 17), (100, 90, 30), (100, 60, 31), (0, 400, 1)]):
        rows.append((200 + i, " ".join(words(50 + i, shift).split() + base[lo : lo + n] + words(70 + i, 13).split())))
    rows.append((300, "\n".join(base) + "é 　 x"))
    got = [tuple(r) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_rows_of_one_doc_id_lose_their_own_windows_only(spark):
    """Repeated doc_ids with other texts, and rows that agree in all."""
    passage, unique = words(31, 100), words(32, 100)
    rows = [(1, passage), (5, passage + " " + words(33, 20)), (5, unique), (5, unique), (6, unique + " end"), (None, passage), (5, passage)]
    got = [tuple(r) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_shifts(spark, seed):
    import random

    rng = random.Random(seed)
    pool = words(seed, 600).split()
    rows = []
    for d in range(25):
        lo, n = rng.randrange(500), rng.randrange(40, 140)
        rows.append((d, " ".join(words(1000 * seed + d, rng.randrange(40)).split() + pool[lo : lo + n])))
    got = [tuple(r) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_kept_text_and_empty(odd, empty):
    rows = S.dedup(odd, with_text=True).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    assert S.dedup(empty).count() == 0
