"""Prefix trie of conversations (operator 11).

Nodes. A turn is the SHA-256 of its role and text, and a prefix the SHA-256 chain of its turns; texts themselves never
shuffle. Rows are numbered within their conversation by one range sort, so a conversation that holds a third of all rows
lies in many tasks; chains run over stretches of STRETCH turns, each of which starts from the chain of the stretches before
it. Prefixes are then grouped, with counts and minima made before the shuffle.

Totals: leaf-peeling message passing. A node's smallest member names it together with its depth, and the nodes of one name
are a path straight down the trie. So a path is peeled at once: it holds a counter of the paths that still hang on it;
those with none left are complete and send their subtree's totals to the path that they hang on, summed on the way, until
only the root's path finishes. There are as many rounds as paths lie on one another at most, not as many as turns. What
has arrived at each place of a path is summed up from its end, in stretches again.

The ids of the members that end in a node are sorted by range, joined into blocks, and a node's blocks are hashed one after
another: a hot node's task reads a row for BLOCK ids and holds one block.

Defined cases: null role and text are empty; rows of equal turn are ordered by the digest of role and text, so reruns agree;
repeated rows are turns of their own; a null conv_id is no conversation and its rows are left out; a conversation whose base
is absent and whose turns are all skipped has none, and ends in the root; conversations of any length and texts of any
length are read whole; an empty table has no root and gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import common

#: Turns of a stretch, ids of a block.
STRETCH, BLOCK = 1024, 4096
#: The prefix without turns.
ROOT = b""


def skipped(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base, in place of its own first ones."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, ...) with at: the place within the conversation's rows of this partition."""
    last, at = None, 0
    for batch in batches:
        ids, out = batch.column("conv_id").to_pylist(), []
        for c in ids:
            at = at + 1 if c == last else 0
            last = c
            out.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "at"])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, idx from 0, digest, words), and conversations (conv_id, n)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), common.word_count(F.col("text")).alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.spark_partition_id().alias("part"))
    stored = common.materialise(common.map_arrow(ranged, _numbered, "conv_id long, digest binary, words long, part int, at long"), "trie-turns")
    counts = stored.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    running = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.materialise(counts.select("conv_id", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n")), "trie-counts")
    # a partition goes on with one conversation of the partitions before it at most, so there are fewer of these than partitions
    on = F.broadcast(counts.filter("before > 0").select("conv_id", "part", "before"))
    turns = stored.join(on, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"), "digest", "words")
    return turns, counts.filter("before = 0").select("conv_id", "n")


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, k from 0, digest, words, last), and ids of those without any."""
    heads = turns.filter("idx < 3 AND conv_id % 20 = 0").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "words"))).alias("head"))
    convs = convs.select("conv_id", "n", skipped(F.col("conv_id")).alias("h"), F.expr("conv_id - conv_id % 20").alias("base")).join(heads, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<idx:bigint,digest:binary,words:bigint>>")), 1, F.col("h"))
    convs = convs.select("conv_id", "n", "h", taken.alias("taken"))
    convs = common.materialise(convs.withColumn("borrowed", F.size("taken").cast("long")).withColumn("length", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    own = turns.join(convs.select("conv_id", "h", "borrowed", "length"), "conv_id").filter("idx >= h").select("conv_id", (F.col("borrowed") + F.col("idx") - F.col("h")).alias("k"), "digest", "words", "length")
    lent = convs.select("conv_id", "length", F.explode("taken").alias("t")).select("conv_id", F.col("t.idx").alias("k"), "t.digest", "t.words", "length")
    rows = own.unionByName(lent)
    return rows.select("conv_id", "k", "digest", "words", (F.col("k") + 1 == F.col("length")).alias("last")), convs.filter("length = 0").select("conv_id")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, k, digest, seed, ...): the digests of a stretch are chained, from its seed."""
    last, state = None, b""
    for batch in batches:
        out = []
        for c, k, digest, seed in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "k", "digest", "seed")), strict=True):
            if (c, k // STRETCH) != last:
                last, state = (c, k // STRETCH), seed or b""
            state = hashlib.sha256(state + digest).digest()
            out.append(state)
        names = [x for x in batch.schema.names if x not in ("digest", "seed")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(out, pa.binary())], [*names, "prefix"])


def chained(rows: DataFrame, longest: int) -> DataFrame:
    """rows (conv_id, k, digest, ...) with prefix in place of digest: equal for equal sequences of the first k + 1 digests."""
    if longest <= STRETCH:
        seeded = rows.withColumn("seed", F.lit(None).cast("binary"))
    else:
        # full stretches are the turns of a shorter conversation, whose prefixes are the seeds of the stretches after them
        alone = _chain(rows.withColumn("seed", F.lit(None).cast("binary")))
        full = alone.filter(F.col("k") % STRETCH == STRETCH - 1).select("conv_id", F.expr(f"k div {STRETCH}").alias("k"), F.col("prefix").alias("digest"))
        full = common.materialise(full, "trie-stretches")
        seeds = chained(full, -(-longest // STRETCH)).select("conv_id", (F.col("k") + 1).alias("stretch"), F.col("prefix").alias("seed"))
        seeded = rows.withColumn("stretch", F.expr(f"k div {STRETCH}")).join(seeds, ["conv_id", "stretch"], "left").drop("stretch")
    return _chain(seeded)


def _chain(seeded: DataFrame) -> DataFrame:
    dealt = seeded.repartition("conv_id", F.expr(f"k div {STRETCH}")).sortWithinPartitions("conv_id", "k")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in seeded.schema.fields if f.name not in ("digest", "seed")]
    return common.map_arrow(dealt, _chained, ", ".join([*fields, "prefix binary"]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (prefix, conv_id) to (prefix, first, ids): the ids of BLOCK rows of one prefix at most, joined."""
    held, prefix = [], None

    def block() -> tuple:
        return prefix, held[0], ",".join(map(str, held))

    for batch in batches:
        out = []
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (p != prefix or len(held) == BLOCK):
                out.append(block())
                held = []
            prefix = p
            held.append(c)
        yield _batch(out, [("prefix", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    if held:
        yield _batch([block()], [("prefix", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (prefix, first, ids) to (prefix, ends_sha256)."""
    prefix, state = None, None
    fields = [("prefix", pa.binary()), ("ends_sha256", pa.string())]
    for batch in batches:
        out = []
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is not None and p == prefix:
                state.update(b",")
            else:
                if state is not None:
                    out.append((prefix, state.hexdigest()))
                prefix, state = p, hashlib.sha256()
            state.update(ids.encode())
        yield _batch(out, fields)
    if state is not None:
        yield _batch([(prefix, state.hexdigest())], fields)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def ends(rows: DataFrame) -> DataFrame:
    """(prefix, conv_id) to (prefix, ends_sha256): of the ids in numerical order, joined by commas."""
    blocks = common.map_arrow(rows.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id"), _blocks, "prefix binary, first long, ids string")
    return common.map_arrow(blocks.repartition("prefix").sortWithinPartitions("prefix", "first"), _hashed, "prefix binary, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """paths (conv_id, parent, place, hanging, leaves, saved): the same with the totals of what hangs on them, and below, added."""
    live, done = common.materialise(paths, "trie-live"), []
    while True:
        done.append(live.filter("hanging = 0"))
        waiting = live.filter("hanging > 0")
        if waiting.isEmpty():
            return functools.reduce(DataFrame.unionAll, done)
        sent = done[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_n"))
        plus = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        left = (F.col("hanging") - F.coalesce("_n", F.lit(0))).alias("hanging")
        live = common.materialise(waiting.join(sent, "conv_id", "left").select("conv_id", "parent", "place", left, plus("leaves", "_leaves"), plus("saved", "_saved")), "trie-live")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = numbered(conversations)
    turns_of, turnless = rebuilt(turns, convs)
    least, longest, n_convs = convs.agg(F.min("conv_id"), F.max("n"), F.count("*")).first()
    rows = common.materialise(chained(turns_of, (longest or 0) + 3).withColumn("depth", F.col("k") + 1).drop("k"), "trie-rows")
    nodes = rows.groupBy("prefix", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    schema = "prefix binary, depth long, conv_id long, n_convs long, words long"
    root = conversations.sparkSession.createDataFrame([(ROOT, 0, least, n_convs, 0)] if n_convs else [], schema)
    nodes = common.materialise(nodes.unionByName(root), "trie-nodes")

    # a path: the nodes of one name, from its top down to its end; it hangs on the node above its top
    span = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"))
    above = span.filter("top > 1").select("conv_id", (F.col("top") - 1).alias("depth")).join(rows.select("conv_id", "depth", "prefix"), ["conv_id", "depth"])
    above = common.materialise(above.select("prefix", F.col("conv_id").alias("child")), "trie-above")
    named = above.join(nodes.select("prefix", F.col("conv_id").alias("parent")), "prefix").select(F.col("child").alias("conv_id"), "parent")
    parent = F.when(F.col("top") == 1, F.lit(least)).otherwise(F.col("parent"))
    paths = common.materialise(span.join(named, "conv_id", "left").select("conv_id", "top", "bottom", parent.alias("parent"), F.when(F.col("top") > 0, F.col("top") - 1).alias("place")), "trie-paths")

    hang = paths.filter("place IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("place").alias("depth")).agg(F.count("*").alias("hanging"))
    own = nodes.join(paths.select("conv_id", "top", "bottom", "parent"), "conv_id").join(hang, ["conv_id", "depth"], "left")
    children = (F.col("depth") < F.col("bottom")).cast("long") + F.coalesce("hanging", F.lit(0))
    own = own.select("prefix", "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("hanging", F.lit(0)).alias("hanging"))
    own = common.materialise(own.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "trie-own")

    sums = own.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("hanging", "leaves", "saved")])
    whole = peeled(paths.select("conv_id", "parent", "place").join(sums, "conv_id").select("conv_id", "parent", "place", "hanging", "leaves", "saved"))
    arrived = whole.filter("place IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("place").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    each = own.join(arrived, ["conv_id", "depth"], "left").withColumn("stretch", F.expr(f"depth div {STRETCH}"))
    each = each.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")})
    from_end = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({c: F.sum(c).over(from_end) for c in ("leaves", "saved")})
    if (longest or 0) + 3 >= STRETCH:
        each = common.materialise(each, "trie-each")
        after = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
        later = each.groupBy("conv_id", "stretch").agg(F.max("leaves").alias("_l"), F.max("saved").alias("_s")).select("conv_id", "stretch", F.sum("_l").over(after).alias("_l"), F.sum("_s").over(after).alias("_s"))
        each = each.join(later, ["conv_id", "stretch"]).withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))})

    last = rows.filter("last").select("prefix", "conv_id").unionByName(turnless.select(F.lit(ROOT).alias("prefix"), "conv_id"))
    each = each.join(ends(last), "prefix", "left")
    return each.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir):
    return trie(common.read_table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS s FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, len(s) AS n, s, unnest(range(len(s) + 1)) AS depth FROM r
), l AS (
  SELECT conv_id, depth, n, CASE WHEN depth > 0 THEN len(regexp_extract_all(s[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, min(conv_id) OVER (PARTITION BY depth, s[1:depth]) AS node FROM p
), g AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ids FROM l GROUP BY node, depth
), e AS (
  SELECT g.*, a.node AS parent FROM g LEFT JOIN l a ON a.conv_id = g.node AND a.depth = g.depth - 1
), k AS (
  SELECT parent, depth - 1 AS depth, count(*) AS n FROM e WHERE parent IS NOT NULL GROUP BY parent, depth
), f AS (
  SELECT e.*, coalesce(k.n, 0) AS n_children FROM e LEFT JOIN k ON k.parent = e.node AND k.depth = e.depth
), s AS (
  SELECT a.node, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved_tokens FROM f JOIN l a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY a.node, a.depth
)
SELECT f.node AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN s ON s.node = f.node AND s.depth = f.depth
"""
