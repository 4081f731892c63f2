"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text (operator 4).

A character trigram model is counted over all documents. A token that may be disguised (leetspeak, letters apart,
repeated letters, wild cards) becomes a lattice: each place offers the letters it may stand for, each at a channel cost,
and Viterbi decoding under the character model picks the reading. Signs at a token's edges may be letters or noise; all
these readings count. In a run of single characters every gap is nothing or the edge of a word, and all words of the best
path over the whole run count, as does each word of the vocabulary that the run spells. Other tokens are left alone.
A document's score is a logistic regression on which words, and beginnings of words, of a small vocabulary its restored
text holds, once or often.

The vocabulary and the weights are fitted on at most SAMPLE labelled rows (those of least hash, one of a doc_id), and never on held
out ones: those whose crc32(doc_id) is 0 modulo 5. Nothing but the text is an input of a score.

Defined cases: null and empty texts score as texts without words; a doc_id without a label is scored all the same; a
label that is null is no label; if one class has no labelled document every score is the share of toxic labels (0 if
there are none). Equal texts get equal scores; a very long text is read whole, token by token; rows that repeat a doc_id
are scored one by one, and their label is toxic if any of its rows in labels says so; a null doc_id counts as held out, as
it has no label; an empty table gives no rows. score() returns doc_id, score and predicted, a row for each row; reject()
returns the input's rows and columns, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common

#: Labelled documents that are fitted on, words in the vocabulary, least documents of a word.
SAMPLE, VOCABULARY, LEAST_DOCS = 6_000, 600, 8
#: Lengths of the beginnings of words that are features, and the share of a text's words that makes a feature strong.
PREFIXES, STRONG = (4, 5, 6, 7), 0.005
#: Letters of the character model; everything else is the edge of a word, 0.
LETTERS = 27
#: What a character may stand for in a disguised word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
WILD, VOWELS, MARKS = "*#%&?", "aeiou", ".,;:-_~'\"/\\^`·)[]{}<>="
#: Channel costs in nats: a leet letter, a wild card, a mark inside a word that isn't there, a letter kept twice.
LEET_COST, WILD_COST, MARK_COST, TWICE_COST = 0.5, 1.5, 0.3, 1.0
#: Cost of a word's edge in a gap between letters, beyond that of the gap.
EDGE_COST = 0.0
#: How much dearer than the best a reading with another ending may be, in nats.
SPREAD = 5.0

_APART = re.compile(r"(?<!\S)\S(?:\s++\S(?!\S)){2,}")
_RUN = re.compile(r"(\S)\1*")
_GAPPED = re.compile(rf"([^\s{re.escape(MARKS)}])(?:[\s{re.escape(MARKS)}]*+\1)*+|[\s{re.escape(MARKS)}]++")
_INNER = re.compile(rf"[{re.escape(MARKS)}]++")
_DOTTED = re.compile(rf"(?<![^{re.escape(MARKS)}])[^{re.escape(MARKS)}](?:[{re.escape(MARKS)}]++[^{re.escape(MARKS)}](?![^{re.escape(MARKS)}])){{2,}}")
_THRICE, _LETTER = re.compile(r"(.)\1\1"), re.compile("[a-z]")
_LITERAL = str.maketrans({c: may[0] for c, may in LEET.items()})
_WORDS = re.compile(r"[^\W\d_]+")
_EDGE = MARKS + WILD + "".join(c for c in LEET if not c.isalnum())


def _codes(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    return table[data]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, dtype=np.int64)
    for b in batches:
        for text in b.column(0):
            text = text.as_py()
            for lo in range(0, len(text), 1 << 20):
                c = _codes(np.frombuffer(b"  " * (lo == 0) + text[max(0, lo - 2) : lo + (1 << 20)] + b"  ", dtype=np.uint8))
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs in nats of each letter after two others, from all documents: LETTERS cubed numbers."""
    grams = common.map_arrow(docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")), _trigrams, "gram long, n long")
    counts = np.zeros(LETTERS**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # LETTERS cubed rows at most
        counts[r["gram"]] = r["n"]
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    three[0, 0, 0] = 0  # white space isn't language
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


class Channel:
    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character the strings that it may stand for, with their costs."""
        places = []
        for m in _RUN.finditer(token):
            c, n = m[1], len(m[0])
            if "a" <= c <= "z":
                places.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, TWICE_COST)] if n == 2 else [(c, 0.0), (c + c, TWICE_COST)])
            elif c in LEET:
                may = [(x * k, LEET_COST * n + TWICE_COST * (n > 1 and (k == 2) != (n == 2))) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))]
                places.append(may if c.isdigit() else [*may, ("", MARK_COST * 4)])
            elif c in WILD:
                places.append([*((x, WILD_COST * n) for x in VOWELS), ("", MARK_COST * 4)])
            elif c in MARKS or c.isspace():
                places.append([("", MARK_COST)])
            else:
                places.append([(c, 0.0)])
        return places

    @staticmethod
    def apart(text: str) -> list[list[tuple[str, float]]]:
        """lattice() of characters with gaps (white space, marks): a gap is nothing or the edge of a word, also inside a run."""
        places: list[list[tuple[str, float]]] = []
        for m in _GAPPED.finditer(text):
            if m[1] is None:
                if places and m.end() < len(text):  # none before the first place and after the last
                    places.append([("", MARK_COST), (" ", MARK_COST + EDGE_COST)])
                continue
            c, n = m[1], sum(x == m[1] for x in m[0])
            may = Channel.lattice(c * n)[0]
            if len(m[0]) > n:
                least: dict[str, float] = {}
                for x, own in may:
                    if x:
                        least[x[0]] = min(own, least.get(x[0], own))
                for x, own in least.items():
                    own += EDGE_COST
                    may = [*may, (f"{x} {x}", own), *([(f"{x}{x} {x}", own + TWICE_COST), (f"{x} {x}{x}", own + TWICE_COST)] if n > 2 else [])]
            places.append(may)
        return places

    def _ends(self, places: list[list[tuple[str, float]]]) -> list[tuple[float, tuple | None]]:
        """The cheapest path to each last pair of letters, best first: its cost and its strings, linked backwards."""
        best, costs = {(0, 0): (0.0, None)}, self.costs
        for may in places:
            step: dict = {}
            for (a, b), (cost, path) in best.items():
                for text, own in may:
                    x, y, total = a, b, cost + own
                    for ch in text:
                        z = ord(ch) - 96 if "a" <= ch <= "z" else 0
                        total += costs[x][y][z]
                        x, y = y, z
                    if (x, y) not in step or total < step[x, y][0]:
                        step[x, y] = (total, (path, text) if text else path)
            best = step
        ends = sorted((cost + costs[a][b][0], a, b) for (a, b), (cost, _) in best.items())
        return [(cost, best[a, b][1]) for cost, a, b in ends]

    @staticmethod
    def _text(path: tuple | None) -> str:
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def decode(self, token: str) -> str:
        """The cheapest reading of a token as one word."""
        return self._text(self._ends(self.lattice(token))[0][1])

    def words(self, text: str) -> list[str]:
        """The words of the cheapest reading of characters with gaps."""
        return self._text(self._ends(self.apart(text))[0][1]).split()

    def decodes(self, token: str) -> set[str]:
        """The readings of a token whose signs all stand for letters: the cheapest of each ending, within SPREAD nats of the best."""
        ends = self._ends([[x for x in may if x[0]] or may for may in self.lattice(token)])
        return {self._text(path) for cost, path in ends if cost <= ends[0][0] + SPREAD}


def names(word: str) -> list[str]:
    """What is known of a word: itself, and its beginnings."""
    return ["w=" + word, *("p=" + word[:k] for k in PREFIXES if len(word) > k)]


class Reader:
    """Texts to the features of their restored form; what a token gives is remembered."""

    def __init__(self, costs: np.ndarray, vocabulary: frozenset[str] | None = None):
        self.channel, self.vocabulary, self.known = Channel(costs), vocabulary, common.Memory()
        # the beginnings that any known word has: a plain word without one of them has no name, and isn't remembered
        self.starts = None if vocabulary is None else frozenset(n[2:][: PREFIXES[0]] for n in vocabulary)
        self.single = frozenset(_RUN.sub(r"\1", n[2:])[: PREFIXES[0]] for n in vocabulary or ())
        self.lexicon = sorted(w for n in vocabulary or () if n.startswith("w=") and len(w := n[2:]) >= PREFIXES[0])

    def readings(self, token: str) -> set[str]:
        core, signed = token.strip(_EDGE), token.strip(MARKS)
        words = {core} if core.isalpha() else set(_WORDS.findall(core))
        # signs beside the core may be letters or noise, on either side: it is read with and without them
        if signed != core and self._speaks(signed):
            words.add(self.channel.decode(signed))
            for part in {signed, signed.rstrip(_EDGE), signed.lstrip(_EDGE)} - {core, ""}:
                words.update(self.channel.decodes(part))
                if (literal := part.translate(_LITERAL)).isalpha():
                    words.add(literal)
        if core.isalpha():
            if len(core) > 2 and _THRICE.search(core):
                words.add(self.channel.decode(core))
        elif self._speaks(core):
            # a token of any length is read as one word, and with each mark as nothing or the edge of a word
            words.add(self.channel.decode(core))
            if _INNER.search(core):
                words.update(self.channel.words(core))
                parts = {p for p in re.split(r"[^\w@$!+|*]+", core) if len(p) > 2 and p != core}
                words.update(self.channel.decode(p) for p in parts if not p.isalpha() or _THRICE.search(p))
            if self.lexicon and _DOTTED.search(core):
                letters = _INNER.sub("", core)
                spelt = self.channel.decode(letters) + " " + letters.translate(_LITERAL)
                words.update(w for w in self.lexicon if w in spelt)
        return words

    @staticmethod
    def _speaks(token: str) -> bool:
        return bool(_LETTER.search(token)) or sum(c in LEET for c in token) > 2

    def _strange(self, token: str) -> bool:
        """Whether no reading of a token can be known: letters, with signs after them at most, that begin like no known word.

        All readings of such a token begin with its letters, once or twice each, so with repeats set aside they begin alike.
        """
        core = token.strip(MARKS).rstrip(_EDGE)
        if self.vocabulary is None or not (core.isascii() and core.isalpha()):
            return False
        begins = _RUN.sub(r"\1", core)[: PREFIXES[0]]
        return len(begins) == PREFIXES[0] and not any(begins[:k] in self.single for k in range(1, PREFIXES[0] + 1))

    def _names(self, token: str) -> tuple[str, ...]:
        found = set() if self._strange(token) else {n for w in self.readings(token) for n in names(w)}
        if self.vocabulary is not None:
            found &= self.vocabulary
        out = tuple(sys.intern(n) for n in found)
        self.known.place(token, out, 2 * len(token) + (8 if self.vocabulary is not None else 80) * len(out))
        return out

    def features(self, text: str) -> set[str]:
        """Names that occur, and with a + those that make up a share of STRONG of the words, twice at least."""
        low = text.lower()
        tokens = Counter(low.split())
        counts: dict[str, int] = {}
        known, starts = self.known, self.starts
        for t, n in tokens.items():
            plain = t.isalpha()
            if not plain and (bare := t.strip(MARKS)).isalpha():
                t, plain = bare, True  # marks around letters change no reading
            if plain and starts is not None and t[: PREFIXES[0]] not in starts and not _THRICE.search(t):
                continue
            found = known.get(t)
            if found is None:
                found = known.recall(t, 2 * len(t) + 80) or self._names(t)
            for name in found:
                counts[name] = counts.get(name, 0) + n
        for m in _APART.finditer(low):
            letters = "".join(m[0].split())
            joined = self.channel.decode(letters)
            found = Counter(name for w in self.channel.words(m[0]) for name in names(w))
            found |= Counter(names(joined))  # the run as one word
            # words of the vocabulary that the run spells wherever the character model puts the edges
            spelt = {w: max(joined.count(w), letters.translate(_LITERAL).count(w)) for w in self.lexicon}
            found |= Counter({name: n for w, n in spelt.items() if n for name in names(w)})
            for name, n in found.items():
                if self.vocabulary is None or name in self.vocabulary:
                    counts[name] = counts.get(name, 0) + n
        least = max(2.0, STRONG * sum(tokens.values()))
        return counts.keys() | {name + "+" for name, n in counts.items() if n >= least}


def _read_words(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs)
        for b in batches:
            words = [sorted(reader.features(t.as_py() or "")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and the intercept of a logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, costs: np.ndarray, weights: dict[str, float], intercept: float):
        self.costs, self.weights, self.intercept = costs, weights, intercept

    def scorer(self):
        weights, known = self.weights, frozenset(self.weights)
        reader = Reader(self.costs, frozenset(w.removesuffix("+") for w in known))

        def score(text: str | None) -> float:
            z = self.intercept + sum(sorted(weights[w] for w in known.intersection(reader.features(text or ""))))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """docs and labels (doc_id, toxic) to a model. The driver gets the character model, the vocabulary and sample rows of word places."""
    costs = character_model(docs, text)
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # a bounded table
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    # of rows that repeat a doc_id one text stays, so that the sample has as many rows as doc_ids
    least = common.materialise(rows.groupBy(F.col("_id").alias("_one")).agg(F.min("_hash").alias("_least"), F.count("*").alias("_rows")), "toxic-sample")
    again = (least.agg(F.max("_rows")).first()[0] or 0) > 1
    rows = rows.join(F.broadcast(least), (F.col("_id") == F.col("_one")) & (F.col("_hash") == F.col("_least"))).select("_doc", "toxic", "_text")
    read = common.map_arrow(rows, _read_words(costs), "doc_id long, toxic int, words array<string>")
    read = common.materialise(read.dropDuplicates(["doc_id"]) if again else read, "toxic-words")
    totals = read.groupBy("toxic").count().collect()
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in totals}
    if not n[0] or not n[1]:
        share = n[1] / max(1, n[0] + n[1])
        return Model(costs, {}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    per = read.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    p = F.col("n") / float(n[0] + n[1])
    z = (F.col("t") / float(n[1]) - (F.col("n") - F.col("t")) / float(n[0])) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1.0 / n[0] + 1.0 / n[1]))
    best = per.filter(F.abs(z) > 4).orderBy(F.desc(F.abs(z)), "word").limit(VOCABULARY)
    words = [r["word"] for r in best.select("word").collect()]
    at = {w: i for i, w in enumerate(words)}
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    got = read.select("toxic", F.array_intersect("words", known).alias("words")).collect()  # sample rows of the vocabulary's words
    x, y = np.zeros((len(got), len(words))), np.array([r["toxic"] for r in got], dtype=float)
    for i, r in enumerate(got):
        for w in r["words"]:
            x[i, at[w]] = 1
    w = _fit(x, y)
    return Model(costs, {word: float(w[i]) for word, i in at.items()}, float(w[-1]))


def _scored(model: Model, column: int, keep: bool):
    """Appends the scores, or keeps the rows that score under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = pa.array([score(t.as_py()) for t in b.column(column)], pa.float64())
            yield b.filter(pc.less(s, 0.5)) if keep else pa.RecordBatch.from_arrays([b.column(0), s], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score, predicted."""
    out = common.map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), _scored(model, 1, False), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not toxic."""
    return common.map_arrow(docs, _scored(model, docs.columns.index(text), True), docs.schema)


def query(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
