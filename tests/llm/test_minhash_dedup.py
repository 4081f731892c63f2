import itertools
import random
import re

import numpy as np
import pytest

from folioscan.llm import minhash_dedup as M

from .conftest import odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def family(seed, n, size=150):
    """Copies of one text with some words changed: similarities around the threshold."""
    rng = random.Random(seed)
    base = words(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(size), rng.randrange(0, 7)):
            w[i] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_components_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = [r[:2] for r in odd_rows() if r[0] != 60 and r[0] is not None]  # those have a test of their own
    for k in range(6):
        rows += [(1000 * (k + 1) + i, t) for i, t in enumerate(family(k, 25, 60 + 50 * k))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.97):
        n = 4000
        shared = rng.integers(0, 2**63, int(2 * n * j / (1 + j)))
        a, b = (np.concatenate([shared, rng.integers(0, 2**63, n - len(shared))]).astype(np.uint64) for _ in range(2))
        import pyarrow as pa

        assert len(a) == len(b) == n and pa is not None
        samples = [{(int(y >> np.uint64(55)), int(y)) for y in [min(g) for g in _bins(x).values()]} for x in (a, b)]
        cells = [np.zeros(M.CELLS, dtype=int) for _ in range(2)]
        for s, c in zip(samples, cells, strict=True):
            for _, y in s:
                c[int(M.wordhash.mix(np.array([y + 9], dtype=np.uint64))[0] % M.CELLS)] ^= 1
        est = M.estimate(np.array([(cells[0] ^ cells[1]).sum()]), np.array([len(samples[0])]), np.array([len(samples[1])]))[0]
        assert abs(est - j) < M.SLACK


def _bins(x):
    y = M.wordhash.mix(x ^ np.uint64(0x5851F42D4C957F2D))
    out = {}
    for v in y.tolist():
        out.setdefault(v >> 55, []).append(np.uint64(v))
    return out


def test_odd_rows_and_dedup(odd, empty):
    out = M.link(odd).collect()
    assert len(out) == odd.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3, 4)} == {1}
    assert all(r["n_shingles"] == 0 and r["kept"] for r in out if r["doc_id"] in (5, 6, 7))
    kept = M.dedup(odd)
    assert kept.schema.simpleString() == odd.schema.simpleString()
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 4} & set(ids) and {5, 6, 7, 8, 10, 11, 12} <= set(ids)
    assert M.link(empty).count() == 0 and M.dedup(empty).count() == 0


def test_rows_are_judged_not_ids(spark):
    """Repeated and null doc_ids: each row has the component of its own text, and one row of each group stays."""
    base, far = words(78, 200).split(), words(77, 90)
    near = [" ".join(["changed" if i == at else w for i, w in enumerate(base)]) for at in (300, 50, 150)]
    rows = [(5, near[0]), (5, far), (5, far), (7, near[1]), (7, far + " tail"), (None, near[0]), (None, near[0]), (9, near[2]), (9, ""), (9, ""), (3, far)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _row string, key int").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.link(docs).collect()), key=str)
    want = {near[0]: 5, near[1]: 5, near[2]: 5, far: 3, far + " tail": 3}
    assert got == sorted(((d, len(shingle_set(t)), d if d is None or not t else want[t]) for d, t in rows), key=str)
    stays = M.dedup(docs)
    assert stays.schema.simpleString() == docs.schema.simpleString()
    assert sorted(((r["doc_id"], r["text"]) for r in stays.collect()), key=str) == sorted([(5, near[0]), (3, far), (None, near[0]), (None, near[0]), (9, ""), (9, "")], key=str)


def test_recall_on_given_documents(spark):
    """Against brute force over the given table, by an index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = {}
        for x in s:
            for o in holders[x]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, i in shared.items():
            if 100 * i >= 85 * (len(s) + len(sets[o]) - i):
                x, y = root(o), root(d)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["component_id"] for r in M.link(docs).collect()} == {d: root(d) for d in sets}


def test_bands_follow_the_threshold():
    assert M.banding(85) == (6, 30)  # op6's
    for percent in (50, 70, 80, 85, 90, 95):
        r, bands = M.banding(percent)
        assert r * bands <= M.HASHES and (1 - (percent / 100) ** r) ** bands <= 1e-6


def test_components_match_brute_force_at_other_thresholds(spark):
    rows = [(1000 * (k + 1) + i, t) for k in range(4) for i, t in enumerate(family(k, 20, 60 + 50 * k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.link(docs, percent=80).collect()}
    assert got == brute(rows, 80) != brute(rows, 85)
