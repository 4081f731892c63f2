import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from folioscan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """Every prefix of every rebuilt conversation in one dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    convs = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    members, ended, above, depth, words = defaultdict(list), defaultdict(list), {}, {}, defaultdict(int)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        state = b""
        members[state].append(c)
        depth[state] = 0
        for d, t in enumerate(convs.get(base, [])[:h] + convs[c][h:]):
            state, before = hashlib.sha256(state + repr(t).encode()).digest(), state
            above[state], depth[state], words[state] = before, d + 1, len(t[1].split())
            members[state].append(c)
        ended[state].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in sorted(members, key=lambda x: -depth[x]):
        saved[x] += (len(members[x]) - 1) * words[x]
        leaves[x] += not children[x]
        if x in above:
            children[above[x]] += 1
            leaves[above[x]] += leaves[x]
            saved[above[x]] += saved[x]
    return sorted((m[0], depth[x], members[above[x]][0] if x in above else None, len(m), children[x], leaves[x], saved[x], hashlib.sha256(",".join(map(str, ended[x])).encode()).hexdigest()) for x, m in members.items())


def key(r):
    return r[1], r[0]


def check(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def planted():
    rng = random.Random(3)
    texts = ["", "a b", "c", "a b", "d  e f", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(0, 70), *range(-45, -20), 10**12] for t in rng.sample([None, 0, 1, 2, 2, 3], rng.randrange(1, 6))]
    rows += [(0, 9, "user", "tail")] * 3 + [(None, 1, "user", "nobody"), (5, None, None, None), (5, None, None, None)]
    return rows


def test_equals_a_dictionary_of_prefixes(spark):
    check(spark, planted())


def test_bases_that_are_absent_or_short(spark):
    check(spark, [(c, t, "user", f"t{t}") for c in range(21, 40) for t in range(c % 4)] + [(40, 0, "user", "only")] + [(c, t, "user", f"t{t}") for c in range(41, 60) for t in range(5)])


def test_long_conversations_and_many_copies(spark):
    """Longer than two stretches, with others that share and leave them on the way; more copies than a block holds."""
    n = 2 * prefix_trie.STRETCH + 300
    rows = [(c, t, "user", f"w{t} x") for c, m in ((100, n), (120, n), (140, 1500), (160, prefix_trie.STRETCH), (180, 1)) for t in range(m)]
    rows += [(120, n, "user", "more"), (140, 1500, "user", "else"), (160, prefix_trie.STRETCH, "user", "too")]
    rows += [(20 * c, 0, "user", "copy") for c in range(1000, 1000 + prefix_trie.BLOCK + 200)]
    check(spark, rows)


def test_paths_on_paths(spark):
    """Each conversation leaves the one before it a turn later."""
    rows = [(20 * c, t, "user", f"{max(0, c - t) if t <= c else 'z'}") for c in range(12) for t in range(14)]
    rows += [(20 * (30 - c), t, "user", "s" if t < c else f"{c}-{t}") for c in range(12) for t in range(13)]
    check(spark, rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_other_columns_are_not_read(spark):
    rows = [(1, 0, "user", "a"), (21, 0, "user", "a")]
    wide = spark.createDataFrame([(*r, "x", 7, b"z") for r in rows], SCHEMA + ", prefix string, depth int, digest binary")
    assert sorted(map(tuple, prefix_trie.trie(wide).collect()), key=key) == sorted(expected(rows), key=key)


def test_sql_gives_the_same():
    rows = planted()
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(c.execute(f"SELECT {', '.join(names)} FROM ({prefix_trie.SQL})").fetchall(), key=key) == sorted(expected(rows), key=key)
