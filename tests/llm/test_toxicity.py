import random
import zlib

import numpy as np
import pytest

from folioscan.llm import toxicity as T

from .conftest import WORDS, row, words

BAD = ["idiot", "stupid", "pathetic", "worthless"]
HIDE = {"i": "1", "o": "0", "s": "$", "a": "@", "t": "7"}


def hidden(word, rng):
    way = rng.randrange(4)
    if way == 0:
        return "".join(HIDE.get(c, c) if rng.random() < 0.6 else c for c in word)
    if way == 1:
        return " ".join(word)
    if way == 2:
        i = rng.randrange(len(word))
        return word[:i] + word[i] * 4 + word[i + 1 :]
    return ".".join(word)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        w = [x.rstrip("0123456789") for x in words(i, 60).split()]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append(row(i, " ".join(w)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, digest string, _id long, component string, size string, copies int, score double, row string, part string, label int"), spark.createDataFrame(labels, "doc_id long, toxic int"), labels


@pytest.fixture(scope="module")
def model(corpus):
    return T.fit(corpus[0], corpus[1])


def test_held_out_accuracy(corpus, model):
    truth = dict(corpus[2])
    rows = [r for r in T.score(corpus[0], model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_disguised_words_are_read(model):
    rng = random.Random(4)
    channel = T.Channel(model.costs)
    for plain, disguised in [("idiot", "1d10t"), ("stupid", "$tup1d"), ("pathetic", "p@theeeetic"), ("stupid", "s.t.u.p.i.d"), ("worthless", "w0rthle$$")]:
        assert channel.decode(disguised) == plain
    score, clean = model.scorer(), " ".join(x.rstrip("0123456789") for x in words(5, 40).split())
    caught = [score(f"{clean} {hidden(w, rng)} {clean} {hidden(w, rng)}") >= 0.5 for w in BAD * 10]
    assert sum(caught) >= 0.9 * len(caught)
    assert score(clean) < 0.5 and score(clean + " call 555 1234, costs $20 (or 15%)!!! a b c") < 0.5


def test_plain_words_are_left_alone(model):
    reader = T.Reader(model.costs)
    for w in [*WORDS, "schön", "2024", "don", "été"]:
        assert w in reader.readings(w) or not w.isalpha()


def test_odd_rows(spark, odd, empty, model):
    out = T.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert T.reject(odd, model).schema.simpleString() == odd.schema.simpleString()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(empty, T.fit(empty, none)).count() == 0
    assert {r["predicted"] for r in T.score(odd, T.fit(odd, none)).collect()} == {0}
    half = spark.createDataFrame([(1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    assert T.score(odd, T.fit(odd, half)).count() == odd.count()


def test_long_and_hostile_texts(model):
    score = model.scorer()
    for t in ("a" * 200_000, "$1" * 100_000, "a b " * 50_000, "@" * 1000, "\0", "x." * 1000):
        assert 0 <= score(t) <= 1


def test_signs_at_both_ends_are_read(model):
    reader, score = T.Reader(model.costs), model.scorer()
    for plain, disguised in [("stupid", "$tup!d"), ("idiot", "!d!ot"), ("idiot", "!dio+"), ("idiot", '"!d!o+",'), ("worthless", "worthle$$"), ("stupid", "$tupid***"), ("pathetic", "p@thet!(")]:
        assert plain in reader.readings(disguised), (disguised, reader.readings(disguised))
    # words that the character model has never seen
    assert "ass" in reader.readings("a$$") and "asshole" in reader.readings("@$$hole")
    for noisy in ("alpha$$$", "alpha***", "alpha!!", "(alpha)"):
        assert "alpha" in reader.readings(noisy)
    clean = " ".join(x.rstrip("0123456789") for x in words(5, 40).split())
    for disguised in ("$tup!d", "!d!o+", "worthle$$"):
        assert score(f"{clean} {disguised} {clean} {disguised}") >= 0.5, disguised


def test_spaced_out_words_are_read(model):
    channel, score = T.Channel(model.costs), model.scorer()
    known = T.Reader(model.costs, frozenset(f"w={w}" for w in BAD))
    for plain, text in [("stupid", "you are a s t u p i d person"), ("idiot", "y o u a r e a n i d i o t"), ("stupid", "s  t  u  p  i  d"), ("idiot", "i\nd\ni\no\nt"), ("stupid", "b e t a $ t u u u p 1 d"), ("worthless", "w o r t h l e s s")]:
        assert f"w={plain}" in known.features(text), text
    assert channel.words("a l p h a s t u p i d b e t a") == ["alpha", "stupid", "beta"]
    clean = " ".join(x.rstrip("0123456789") for x in words(5, 40).split())
    whole = clean.split()
    whole[7:7] = whole[25:25] = ["pathetic"]
    assert score(" ".join("".join(whole))) >= 0.5  # the whole text, far longer than a piece
    assert score(" ".join("".join(clean.split()))) < 0.5
    assert score(f"{clean} a s  t  u  p  i  d {clean} y o u i d i o t") >= 0.5


def test_long_tokens_are_read(model):
    reader, score = T.Reader(model.costs, frozenset(f"w={w}" for w in BAD)), model.scorer()
    clean = "".join(x.rstrip("0123456789") for x in words(5, 30).split())
    spelt = clean + "idiot" + clean
    for plain, token in [("stupid", "stu" + "u" * 50 + "pid"), ("stupid", "s" + "." * 60 + "tupid"), ("idiot", ".".join(spelt)), ("idiot", "-".join(spelt.replace("idiot", "1d10t"))), ("stupid", "/".join(["alpha"] * 20) + "/$tup1d/x"), ("stupid", "/".join(["alpha"] * 20) + "/stuuupid")]:
        assert plain in reader.readings(token), token
    text = " ".join(x.rstrip("0123456789") for x in words(5, 40).split())
    assert score(f"{text} {'stu' + 'u' * 50 + 'pid'} {text} {'.'.join(spelt)}") >= 0.5
    assert score(f"{text} {'.'.join(clean)} {text} https://www.example.com/{clean}?q={clean}&n=1") < 0.5


def test_long_tokens_take_linear_time(model):
    score = model.scorer()
    for t in ("x.y$" * 20_000, "a*b1" * 20_000, "a.b." * 20_000):
        assert 0 <= score(t) <= 1


def every_reading(places):
    """All strings of a lattice with their channel costs."""
    out = [("", 0.0)]
    for may in places:
        out = [(t + x, c + own) for t, c in out for x, own in may]
    return out


def language_cost(costs, text):
    a, b, total = 0, 0, 0.0
    for ch in text + " ":
        z = ord(ch) - 96 if "a" <= ch <= "z" else 0
        total += float(costs[a][b][z])
        a, b = b, z
    return total


@pytest.mark.parametrize("token", ["1d10t", "$tup1d", "sstuuupid", "w0rthl3$$", "a55h0l3", "id!!ot", "s-t.u_p1d", "f*ck", "0", "!!!", "llll", "b1+ch", "x"])
def test_decode_finds_the_cheapest_of_all_readings(token):
    """Against every reading of the lattice, under random character models."""
    for seed in range(4):
        costs = (np.random.default_rng(seed).random((27, 27, 27)) * 6).astype(np.float32)
        channel = T.Channel(costs)
        for places, got in ((channel.lattice(token), channel.decode(token)), (channel.apart(token), channel._text(channel._ends(channel.apart(token))[0][1]))):
            priced = [(c + language_cost(costs, t), t) for t, c in every_reading(places)]
            best = min(c for c, _ in priced)
            assert min(c for c, t in priced if t == got) == pytest.approx(best, abs=1e-4)


def test_a_very_long_disguised_token_is_decoded_whole():
    costs = (np.random.default_rng(0).random((27, 27, 27)) * 6).astype(np.float32)
    reader = T.Reader(costs)
    assert any(len(w) >= 400 for w in reader.readings("s7u9" * 125))
    spread = "stu" + "u" * 500 + "pid"
    assert any(len(w) < 12 for w in reader.readings(spread))


def test_odd_rows_and_empty_tables(spark, odd, empty):
    model = T.Model(np.zeros((27, 27, 27), dtype=np.float32), {"w=alpha": 1.0}, -0.5)
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 60]
    assert len(same) == 2 and len(set(same)) == 1
    kept = T.reject(odd, model)
    assert kept.schema.simpleString() == odd.schema.simpleString()
    assert kept.count() == sum(not r["predicted"] for r in rows)
    assert T.score(empty, model).count() == 0 and T.reject(empty, model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert T.score(empty, T.fit(empty, labels)).count() == 0
    held = spark.createDataFrame([(None,), (4,)], "doc_id long").select(T.held_out(T.F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] is not None for r in held)


def test_tokens_set_aside_have_no_known_reading():
    """A reader that knows its vocabulary finds what one without finds of it, whatever marks and signs are around letters."""
    rng = random.Random(11)
    costs = np.asarray(np.random.default_rng(11).uniform(0.5, 6, (T.LETTERS,) * 3), dtype=np.float32)
    vocabulary = frozenset(n for w in ("idiot", "aggro", "add", "loser", "llama", "scum", "ssun", "aab") for n in T.names(w))
    bases = ["idiot", "aggro", "add", "loser", "lama", "llama", "scum", "sun", "ab", "table", "agrodome", "ad", "sccuum", "losser", "straße", "été"]
    signs = list("!?.,|$@*#1(") + ["..", "!!", ".!", "!.", "", "", ""]
    for _ in range(4000):
        word = "".join(c * rng.choice([1, 1, 1, 1, 2, 3]) for c in rng.choice(bases))
        text = rng.choice(signs) + rng.choice(signs) + word + rng.choice(signs) + rng.choice(signs)
        assert T.Reader(costs, vocabulary).features(text) == {n for n in T.Reader(costs).features(text) if n.removesuffix("+") in vocabulary}, text


def test_a_doc_id_that_repeats_is_one_row_of_the_sample(spark):
    """Whatever the number of its rows, and of their texts."""
    from folioscan.llm import toxicity

    labelled = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5][:100]
    docs = [(k, f"plain word{k % 7} here" if k % 2 else f"awful awful{k % 5} here") for k in labelled]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in labelled], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = docs + [docs[0]] * 300
    again = toxicity.fit(spark.createDataFrame(many, "doc_id long, text string"), labels)
    assert sorted(once.weights) == sorted(again.weights) and once.weights
    assert all(abs(once.weights[w] - again.weights[w]) < 1e-6 for w in once.weights)
