import numpy as np
import pyarrow as pa

from folioscan.llm import minhash_dedup, substring_dedup, wordhash

from .conftest import words


def hashed(*texts):
    batch = pa.record_batch([pa.array(list(texts))], ["t"])
    return [(part.num_rows, one, two, before) for part, one, two, before in wordhash.hashed_batches(batch, 0)]


def alternating(n, first="a", second="b"):
    """A word whose letters follow the parity of ones in their places' binary numbers."""
    return "".join(second if i.bit_count() % 2 else first for i in range(n))


def test_equal_words_have_equal_hashes_and_others_differ():
    rng = np.random.default_rng(1)
    made = {"".join(rng.choice(list("ab\u00e9"), rng.integers(1, 40))) for _ in range(3000)}
    made |= {alternating(n, *ab) for n in (8, 16, 17, 64, 1023, 1024, 1025) for ab in ("ab", "ba")} | {"a" * n for n in range(1, 40)}
    made = sorted(made)
    ((_, one, two, _),) = hashed(" ".join(made + made[::-1]))
    n = len(made)
    assert (one[:n] == one[n:][::-1]).all() and (two[:n] == two[n:][::-1]).all()
    assert len(set(one[:n].tolist())) == n == len(set(two[:n].tolist()))


def test_runs_are_equal_where_their_words_are():
    rng = np.random.default_rng(2)
    w = [f"w{x}" for x in rng.integers(0, 3, 4000)]
    ((_, one, two, _),) = hashed(" ".join(w))
    for width in (1, 2, 3, 5, 20, 31, 50):
        seen = {}
        for k, h in enumerate(zip(*(x.tolist() for x in wordhash.run_hashes(width, one, two)), strict=True)):
            assert seen.setdefault(h, tuple(w[k : k + width])) == tuple(w[k : k + width])
        assert len(seen) == len({tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
        single = wordhash.run_hashes(width, one)[0]
        assert len(set(single.tolist())) == len(seen)


def test_blocks_give_the_same(monkeypatch):
    ((_, one, two, _),) = hashed(words(5, 3000) + " " + "x" * 30)
    want = wordhash.run_hashes(50, one, two)
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    ((_, a, b, _),) = hashed(words(5, 3000) + " " + "x" * 30)
    assert (a == one).all() and (b == two).all()
    assert all((x == y).all() for x, y in zip(want, wordhash.run_hashes(50, one, two), strict=True))


def test_words_that_differ_in_the_pattern_of_their_letters(spark):
    """Every window holds the word that differs, so nothing goes, and no sets are linked."""
    rest = words(7, 59)
    long_ = [(k, f"{rest[:200]} {w} {rest[200:]}") for k, w in enumerate([alternating(1024), alternating(1024, "b", "a"), alternating(1023), alternating(1025)])]
    long_ = [(k, " ".join(t.split()[:60])) for k, t in long_]
    assert all(r["n_removed"] == 0 for r in substring_dedup.dedup(spark.createDataFrame(long_, "doc_id long, text string")).collect())
    few = [(k, " ".join([*words(8, 5).split(), w, *words(9, 6).split()])) for k, w in enumerate([alternating(1024), alternating(1024, "b", "a")])]
    assert all(r["kept"] for r in minhash_dedup.link(spark.createDataFrame(few, "doc_id long, text string")).collect())


def test_documents_whose_words_follow_such_a_pattern(spark):
    one, two = (" ".join(alternating(2048, *ab)) for ab in ("ab", "ba"))
    rows = [(1, one), (2, two.replace("a", "c")), (3, one)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2048, 0), 2: (2048, 0), 3: (2048, 2048)}
