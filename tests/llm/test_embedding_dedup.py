import numpy as np
import pytest

from folioscan.llm import embedding_dedup as E

SCHEMA = "vec_id long, label int, embedding array<float>, n_links string, component string"


def rows():
    rng = np.random.default_rng(3)
    out, centre = [], rng.normal(size=(6, 12))
    for i in range(260):
        v = centre[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.35])
        out.append((i, int(i % 6 == 5), [float(np.float32(x)) for x in v], "x", "y"))
    same = out[0][2]
    out += [(1000 + i, 0, same, None, None) for i in range(40)]
    out += [(2000, None, same, None, None), (2001, 0, None, None, None), (2002, 0, [0.0] * 12, None, None), (2003, 0, [None] + same[1:], None, None), (2004, 0, [float("nan")] + same[1:], None, None), (2005, 0, [float("inf")] + same[1:], None, None)]
    return out + [(2006, 0, same[:4], None, None), (2007, 0, [], None, None), (2008, 0, [x * 1e-30 for x in same], None, None), (2009, 0, [x * 1e30 for x in same], None, None)]


def brute(data, threshold):
    good = {}
    for i, label, v, *_ in data:
        if label is not None and v and None not in v and np.isfinite(np.float64(v)).all() and any(v):
            x = np.float64(np.float32(v))
            x = x / np.abs(x).max()
            good[i] = (label, x / np.linalg.norm(x))
    links = {i: {j for j in good if j != i and good[j][0] == good[i][0] and len(good[j][1]) == len(good[i][1]) and good[i][1] @ good[j][1] >= threshold} if i in good else set() for i, *_ in data}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "sample": 50, "step": 3}])
def test_links_and_components(spark, sizes):
    data = rows()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.dedup(spark.createDataFrame(data, SCHEMA), **sizes).collect()}
    want = brute(data, E.THRESHOLD)
    assert got == want and sum(n for n, *_ in want.values()) > 1000


def test_bounds_drop_nothing():
    rng = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(200, 20)) ** 3, rng.normal(size=(150, 20)) ** 3))
    for t in (0.2, 0.5, 0.8):
        exact = lambda i, j, t=t: (a[i] * b[j]).sum(1) >= t
        assert (E.linked(a, b, t, 4, exact) == (a @ b.T >= t)).mean() > 0.99999


@pytest.mark.parametrize("seed", range(3))
def test_a_pair_at_the_threshold_is_linked_from_both_ends(spark, seed):
    """The cosine of the vectors as given decides, not that of the rotated ones; a label may be a long."""
    x, y = np.random.default_rng(seed).normal(size=(2, 24)) + 2
    t = float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
    data = [(1, 2**40, x.tolist()), (2, 2**40, y.tolist()), (3, 2**40 + 1, x.tolist())]
    for threshold, n in ((t, 1), (float(np.nextafter(t, 1)), 0)):
        out = E.dedup(spark.createDataFrame(data, "vec_id long, label long, embedding array<double>"), threshold=threshold)
        assert {r["vec_id"]: r["n_links"] for r in out.collect()} == {1: n, 2: n, 3: 0}


def test_empty_and_unusable(spark):
    assert E.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    out = E.dedup(spark.createDataFrame([(1, None, None, None, None), (None, 1, [1.0], None, None)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in out) == [(0, 0), (1, 0)]
