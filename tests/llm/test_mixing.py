import re
from collections import Counter, defaultdict

import pytest

from folioscan.llm import mixing as M

from .conftest import odd_rows


def water(sizes, share=1.5, cap=2.0):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return target
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return target | got
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            capped.add(s)


def test_decisions(spark, odd):
    rows = M.decide(M._sizes(odd)).collect()
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = water(sizes)
    assert len(rows) == len(odd_rows())
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - t) <= largest
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.decide(M._sizes(odd.repartition(5))).collect()), key=str)


def test_many_documents_come_near_their_target(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), int(rng.lognormvariate(5, 1.2)) + 1) for i in range(6000)]
    out = M.decide(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in out:
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
    assert len(out) == 6000
    for got, target in per.values():
        assert abs(got - target) <= 0.01 * target + 5
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(r[2] for r in rows))


def plain_walk(units, rng):
    """The pairwise rounding of (size, p) in plain Python: copies, and the probability of the one that is left."""
    out, left = [None] * len(units), None
    for i, (size, p) in enumerate(units):
        if left is None:
            left = (i, size, p)
            continue
        j, other, q = left
        up, down = min(other * (1 - q), size * p), min(other * q, size * (1 - p))
        move = up if rng.random() * (up + down) < down else -down
        pairs = [(j, other, q + move / other), (i, size, p - move / size)]
        left = None
        for k, s, x in pairs:
            if x < 1e-9 or x > 1 - 1e-9:
                out[k] = float(round(x))
            else:
                left = (k, s, x)
    if left:
        out[left[0]] = left[2]
    return out


@pytest.mark.parametrize("units", [
    [(900, 0.25), (400, 0.25), (90, 0.25), (60, 0.25), (9, 0.25), (7, 0.25), (3, 0.25), (1, 0.25)],
    [(50, 0.9), (50, 0.1), (50, 0.5), (20, 0.3), (20, 0.7), (1, 0.05)],
    [(5, 0.3)],
    [(5, 0.5), (5, 0.5)],
])
def test_every_documents_mean_is_its_own_probability(spark, units):
    """Over many seeds, by the engine and by plain Python; also where probabilities differ, as they do up the tree."""
    import random

    from pyspark.sql import functions as F

    n = 6000
    made = F.array(*[F.struct(F.lit(s).cast("long").alias("size"), F.lit(i).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("k"), F.lit(p).alias("p")) for i, (s, p) in enumerate(units)])
    rows = spark.range(n).select(M._walk(made, F.col("id")).alias("o")).collect()
    sums, squares, words = [0.0] * len(units), [0.0] * len(units), set()
    for r in rows:
        got = {d["doc_id"]: float(d["up"]) for d in r["o"]["done"]}
        if r["o"]["left"]:
            got[r["o"]["left"]["doc_id"]] = r["o"]["left"]["p"]
        assert len(got) == len(units)
        words.add(round(sum(got[i] * s for i, (s, _) in enumerate(units)), 6))
        for i, x in got.items():
            sums[i] += x
            squares[i] += x * x
    assert words == {round(sum(s * p for s, p in units), 6)}  # mass is moved, never made
    rng = random.Random(1)
    plain = [plain_walk(units, rng) for _ in range(n)]
    for i, (_, p) in enumerate(units):
        for total, square in ((sums[i], squares[i]), (sum(x[i] for x in plain), sum(x[i] ** 2 for x in plain))):
            mean = total / n
            error = (max(square / n - mean * mean, 1e-12) / n) ** 0.5
            assert abs(mean - p) <= 4 * error + 1e-9, (i, mean, p)


def test_size_classes_are_taken_at_one_rate(spark):
    """Through all levels of the tree: small and large documents of a source have the same mean copies."""
    import random

    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], rng.choice([4, 40, 400])) for i in range(20_000)]
    out = M.decide(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    for source in "ab":
        rate = next(r["target"] / r["source_size"] for r in out if r["source"] == source)
        p = rate % 1
        for size in (4, 40, 400):
            copies = [r["copies"] for r in out if r["source"] == source and r["size"] == size]
            assert abs(sum(copies) / len(copies) - rate) <= 4 * (p * (1 - p) / len(copies)) ** 0.5 + 1e-9


def test_repeated_rows_are_decided_one_by_one(spark):
    """Copies of a row get their own numbers of copies; with the null doc_ids of a hot group."""
    rows = [(7, f"text of {i % 3} words", "a", i) for i in range(90)] + [(None, "one two three", None, i) for i in range(150)] + [(i, "some words " * 9, "abc"[i % 3], i) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    decided = M.decide(M._sizes(docs)).collect()
    out = M.mix(docs).collect()
    assert len(decided) == len(rows) and len(out) == sum(r["copies"] for r in decided)
    per, want = Counter((r["doc_id"], r["source"], r["size"]) for r in out), Counter()
    per = Counter()
    for r in out:
        per[r["doc_id"], r["source"], r["size"]] += 1
    for r in decided:
        want[r["doc_id"], r["source"]] += r["copies"]
    got = Counter()
    for (d, s, _), n in per.items():
        got[d, s] += n
    assert got == want and max(per.values()) <= 2  # size is a number of the row here: no row is taken more than twice


def test_mix_repeats_rows(odd):
    copies = {r["doc_id"]: r["copies"] for r in M.decide(M._sizes(odd)).collect()}
    out = M.mix(odd)
    assert out.schema.simpleString() == odd.schema.simpleString()
    seen = Counter(r["doc_id"] for r in out.collect())
    assert all(seen[d] == c for d, c in copies.items() if d not in (60, None))


def test_empty(empty):
    assert M.decide(M._sizes(empty)).count() == 0 and M.mix(empty).count() == 0
