"""MinHash near-dedup with odd sketches (operator 6).

Every document's word shingles are hashed. HASHES MinHash values, in bands, propose candidates; OPH_BINS one-permutation
MinHash samples are folded into an odd sketch, a bitmap of the parity of samples per cell. The population count of the
XOR of two sketches estimates how many samples differ, precisely when few do: candidates below the threshold by more
than slack() are dropped, and the rest is confirmed on the full shingle sets.

Groups are never expanded into all pairs:
1. Rows with equal sets are one class, whatever their doc_ids.
2. In each band bucket every class is paired with the bucket's smallest; the pairs that the sketches leave are confirmed,
   and components are found.
3. Buckets whose classes are in several components are compared tile by tile, sketch against sketch. Large buckets are
   divided by the size of the sets first: sizes further apart than the threshold allows are never compared. The classes
   with a partner across components get their full sets, and the same tiles confirm pairs on them. A confirmed link joins
   two components, so a tile returns fewer links than it has classes; components are found once more, of the components.
A pair inside one component needs no confirmation, as it can't change the components; every other pair that shares a
bucket is judged. Rows in a band and bands follow from the threshold t (banding()): a pair at t shares no bucket with a
chance of (1 - t ** r) ** bands, at most MISS; 6 x 30 give 6.8e-7 at 0.85, 5 x 36 give 6.2e-7 at 0.8.

Sets are sets of 64-bit hashes of shingles. Defined cases: null and blank texts have no shingles and link with nothing;
a text of fewer words than a shingle is one shingle of all its words; a very long text is hashed whole; null doc_ids link
with nothing and stay; rows that repeat a doc_id are judged row by row, each with the set and the component of its own
text; of a component the row of the smallest doc_id stays in dedup(), on ties that of the least text hash, and one of rows
that agree in both; an empty table gives no rows. Other columns are not read, and kept by dedup() whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common, wordhash
from folioscan.llm.components import components

SHINGLE, PERCENT, HASHES, MISS = 5, 85, 180, 7e-7
OPH_BINS, CELLS, SLACK = 512, 2048, 0.08
#: Classes, and shingles of all its classes, in a block of a bucket; a tile compares two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


@functools.cache
def banding(percent: int) -> tuple[int, int]:
    """Rows in a band and bands: the longest rows whose bands miss a pair at the threshold with a chance of MISS at most."""
    fit = [r for r in range(1, HASHES + 1) if (1 - (percent / 100) ** r) ** (HASHES // r) <= MISS]
    if not fit:
        raise ValueError(f"{HASHES} hashes can't find pairs at {percent} percent")
    return max(fit), HASHES // max(fit)


@functools.cache
def slack(percent: int) -> float:
    """Five standard deviations of estimate() at the threshold, of the samples and of their sketch, and SLACK at least."""
    p = percent / 100
    apart = 2 * OPH_BINS * (1 - p)
    even = np.exp(-4 * apart / CELLS)
    sketch = (CELLS / 4 * (1 - even) - apart * even) / even / (2 * OPH_BINS) ** 2
    return max(SLACK, 5 * float(np.sqrt(p * (1 - p) / OPH_BINS + sketch)))


@functools.cache
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, before: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and how many precede each document."""
    (runs,) = wordhash.run_hashes(width, words)
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    left = before[1:][doc] - np.arange(len(words))
    at = np.flatnonzero(left >= width)
    docs, hashes = doc[at], runs[at]
    if len(few := np.flatnonzero((n > 0) & (n < width))):
        own = [wordhash.run_hashes(int(n[d]), words[before[d] : before[d + 1]])[0][0] for d in few]
        docs, hashes = np.concatenate([docs, few]), np.concatenate([hashes, np.asarray(own, dtype=np.uint64)])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[new], hashes[new]
    return hashes, np.searchsorted(docs, np.arange(len(n) + 1))


def digests(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set, from the places where sets begin; it doesn't depend on order."""
    return wordhash.mix(np.add.reduceat(wordhash.mix(sets + np.uint64(77)), begin))


_SIGNED = ["doc_id", "key", "n_shingles", "digest", "bands", "sketch", "samples"]


def _signatures(percent: int):
    """(doc_id, key, text) to the set's size, its digest, a hash per band, the odd sketch and how many samples it holds; nulls without a set."""
    r, n_bands = banding(percent)
    seeds = _seeds(r * n_bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, _, before in wordhash.hashed_batches(batch, 2, lower=True):
                sets, at = shingles(words, before)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                if len(none := np.flatnonzero(n == 0)):
                    bare = part.take(pa.array(none))
                    yield pa.RecordBatch.from_arrays([bare.column(0), bare.column(1), pa.array(np.zeros(len(none), dtype=np.int64)), *(pa.nulls(len(none), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32()))], _SIGNED)
                if not len(full):
                    continue
                begin = at[full]
                mins = np.empty((len(full), len(seeds)), dtype=np.uint64)
                for j, seed in enumerate(seeds):
                    x = sets * seed
                    x ^= x >> np.uint64(31)
                    mins[:, j] = np.minimum.reduceat(x * np.uint64(0x94D049BB133111EB), begin)
                bands = np.empty((len(full), n_bands), dtype=np.uint64)
                for b in range(n_bands):
                    h = np.full(len(full), b + 1, dtype=np.uint64)
                    for j in range(b * r, (b + 1) * r):
                        h = wordhash.mix(h * np.uint64(0x9E3779B97F4A7C15) + mins[:, j])
                    bands[:, b] = h
                digest = digests(sets, begin)
                # one-permutation samples: the least hash of each bin; their parity per cell
                doc = np.repeat(np.arange(len(full)), n[full])
                y = wordhash.mix(sets ^ np.uint64(0x5851F42D4C957F2D))
                key = doc.astype(np.uint64) * np.uint64(OPH_BINS) + (y >> np.uint64(55))
                order = np.lexsort((y, key))
                key, y, doc = key[order], y[order], doc[order]
                first = np.ones(len(key), dtype=bool)
                first[1:] = key[1:] != key[:-1]
                cells = wordhash.mix(y[first] + np.uint64(9)) % np.uint64(CELLS)
                parity = np.zeros((len(full), CELLS), dtype=np.uint8)
                np.add.at(parity, (doc[first], cells.astype(np.int64)), 1)
                sketch = np.packbits(parity & 1, axis=1)
                samples = np.bincount(doc[first], minlength=len(full))
                rows = part.take(pa.array(full))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n[full], pa.int64()), pa.array(digest.view(np.int64)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(samples, pa.int32())],
                    _SIGNED,
                )

    return run


def estimate(differ: np.ndarray, samples: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The greatest similarity that sketches which differ in so many cells speak for."""
    apart = -CELLS / 2 * np.log1p(-np.minimum(2 * differ / CELLS, 0.999))
    shared = (samples + others - apart) / 2
    return shared / np.maximum(np.maximum(samples, others), 1)


def _may_link(x: pa.Table | pa.RecordBatch, percent: int) -> np.ndarray:
    """Which rows' (sketch, samples, n_shingles, sketch2, samples2, n2) may be linked."""
    a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), dtype=np.uint64).reshape(-1, CELLS // 64) for c in ("sketch", "sketch2"))
    differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    na, nb = x.column("n_shingles").to_numpy(), x.column("n2").to_numpy()
    return (estimate(differ, x.column("samples").to_numpy(), x.column("samples2").to_numpy()) >= percent / 100 - slack(percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _filter_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield x.select(["a", "b"]).filter(pa.array(_may_link(x, percent)))

    return run


class _Tile:
    """Two blocks of a bucket, those of side 0 first."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table["side"].to_numpy(), kind="stable")))
        self.table, self.rows = table, table.num_rows
        self.first = int((table["side"].to_numpy() == 0).sum())
        self.comp, self.n, self.samples = (table[c].to_numpy().copy() for c in ("component", "n_shingles", "samples"))
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(-1, CELLS // 64)

    def partners(self, i: int, percent: int) -> np.ndarray:
        """Rows after i, of the other block if there is one, in other components, that the sketches leave."""
        lo = max(0 if self.first == self.rows else self.first, i + 1)
        n = self.n[lo:]
        j = lo + np.flatnonzero((self.comp[lo:] != self.comp[i]) & (100 * np.minimum(n, self.n[i]) >= percent * np.maximum(n, self.n[i])))
        differ = np.bitwise_count(self.sketch[j] ^ self.sketch[i]).sum(1, dtype=np.int64)
        return j[estimate(differ, self.samples[j], self.samples[i]) >= percent / 100 - slack(percent)]


_ENDS = ["band", "ca", "ba", "cb", "bb"]
_TILE = "band long, ca int, ba int, cb int, bb int, side int, node long, component long, n_shingles long, sketch binary, samples int"


def _open_rows(percent: int):
    """The rows of a tile that have a partner in it."""

    def run(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        some = np.zeros(tile.rows, dtype=bool)
        for i in range(tile.first):
            j = tile.partners(i, percent)
            some[j] = True
            some[i] |= len(j) > 0
        return tile.table.filter(pa.array(some))

    return run


def _joined(percent: int):
    """The pairs of components that a tile joins by links confirmed on the full sets: fewer than its rows."""

    def run(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        comp = tile.comp.copy()
        sets = [np.asarray(h) for h in tile.table["hashes"].combine_chunks().to_numpy(zero_copy_only=False)]
        found = []
        for i in range(tile.first):
            j = tile.partners(i, percent)
            for lo in range(0, len(j), 256):  # 256 sets at a time
                some = j[lo : lo + 256]
                every = np.concatenate([sets[k] for k in some])
                at = np.searchsorted(sets[i], every)
                hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == every
                ends = np.cumsum([len(sets[k]) for k in some])
                shared = np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))
                for k in some[100 * shared >= percent * (len(sets[i]) + tile.n[some] - shared)]:
                    if tile.comp[k] != tile.comp[i]:
                        found.append((comp[i], comp[k]))
                        tile.comp[tile.comp == tile.comp[k]] = tile.comp[i]
        return pa.table({"a": [int(x) for x, _ in found], "b": [int(x) for _, x in found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the digest of its set and the set, in the order of signed numbers."""
    for batch in batches:
        for _, words, _, before in wordhash.hashed_batches(batch, 0, lower=True):
            sets, at = shingles(words, before)
            full = np.flatnonzero(np.diff(at) > 0)
            if not len(full):
                continue
            node = digests(sets, at[full])
            sets, ends = sets.view(np.int64), np.append(at[full], at[-1])
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                sets[lo:hi].sort()
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets)).cast(pa.list_(pa.int64()))], ["node", "hashes"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", shared.alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb")).filter(f"100L * i >= {percent}L * (na + nb - i)")
    return common.materialise(links.select("a", "b"), tag)


def _tiles(placed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """placed (band, node, component, n_shingles) to rows of tiles, of buckets whose classes are in several components.

    A bucket of one block is one tile. A larger one is divided into cells by the size of the sets, so that sets which may
    be similar lie in the same or in adjacent cells; cells are blocks, and each two blocks of such cells are a tile.
    """
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    same = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    mixed = placed.groupBy("band").agg(F.countDistinct("component").alias("c"), F.count("*").alias("n"), parts.alias("parts"), *same).filter("c > 1 AND n > 2")
    # of buckets with the same members one is enough
    mixed = common.materialise(mixed.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "parts")).alias("x")).select("x.*"), "minhash-mixed")
    wide = float(np.log(100 / percent)) + 1e-9 if percent < 100 else 1.0
    cell = F.when(F.col("parts") > 1, F.floor(F.log(F.col("n_shingles")) / wide)).otherwise(F.lit(0)).cast("int")
    rows = common.materialise(placed.join(mixed, "band").select("band", "node", "component", "n_shingles", cell.alias("cell")), "minhash-cells")
    per = common.materialise(rows.groupBy("band", "cell").agg(parts.alias("blocks")), "minhash-blocks")
    around = per
    for name, off in (("after", -1), ("prior", 1)):
        around = around.join(per.select("band", (F.col("cell") + off).alias("cell"), F.col("blocks").alias(name)), ["band", "cell"], "left")
    around = common.materialise(around.na.fill(0), "minhash-around")
    c, k = F.col("cell"), F.col("block")
    names = ("ca", "ba", "cb", "bb", "side")

    def ends(blocks: str, *values) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.col(blocks) - 1, F.lit(0))), lambda o: F.struct(*[v(o).cast("int").alias(n) for n, v in zip(names, values, strict=True)]))
        return F.when(F.col(blocks) > 0, made).otherwise(F.slice(made, 1, 0))

    every = F.concat(
        ends("blocks", lambda o: c, lambda o: F.least(k, o), lambda o: c, lambda o: F.greatest(k, o), lambda o: F.when(k <= o, 0).otherwise(1)),
        ends("after", lambda o: c, lambda o: k, lambda o: c + 1, lambda o: o, lambda o: F.lit(0)),
        ends("prior", lambda o: c - 1, lambda o: o, lambda o: c, lambda o: k, lambda o: F.lit(1)),
    )
    dealt = rows.join(around, ["band", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sketches.drop("n_shingles"), "node")
    return dealt.select("band", "node", "component", "n_shingles", "sketch", "samples", F.explode(every).alias("e")).select("band", "e.*", "node", "component", "n_shingles", "sketch", "samples")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (a hash of the text, which tells rows of a doc_id apart) and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))


def classes(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """_rows() to stored rows (doc_id, key, n_shingles, digest), and (digest, component, component_id) of the classes."""
    fields = "doc_id long, key long, n_shingles long, digest long, bands array<long>, sketch binary, samples int"
    signed = common.materialise(common.map_arrow(rows, _signatures(percent), fields), "minhash-signatures")
    linkable = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    class_of = common.materialise(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("digest", "least.*"), "minhash-classes")
    reps = common.materialise(linkable.join(class_of, ["digest", "doc_id", "key"], "left_semi").dropDuplicates(["digest"]).withColumnRenamed("digest", "node"), "minhash-reps")

    banded = reps.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = common.materialise(banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "minhash-buckets")
    members = common.materialise(banded.join(shared.select("band", "centre"), "band"), "minhash-members")
    common.drop(shared)
    sketches = reps.select("node", "n_shingles", "sketch", "samples")
    other = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("sketch2"), F.col("samples").alias("samples2"))
    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    likely = common.map_arrow(stars.join(sketches.withColumnRenamed("node", "b"), "b").join(other, "a"), _filter_pairs(percent), "a long, b long")
    likely = common.materialise(likely, "minhash-likely")

    # the sets of all that may be paired; the text of one row of each class moves, once
    pool = members.select("node").distinct().join(class_of.withColumnRenamed("digest", "node"), "node").select("doc_id", "key")
    texts = rows.join(pool.hint("shuffle_hash"), ["doc_id", "key"], "left_semi").select("text")
    sets = common.map_arrow(texts, _sets, "node long, hashes array<long>")
    if not linkable.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])  # rows that agree in doc_id and text
    sets = common.materialise(sets, "minhash-sets")
    links = _confirmed(likely, sets, percent, "minhash-links")
    label = components(links)
    common.drop(likely, links)

    placed = members.join(label, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    placed = common.materialise(placed, "minhash-placed")
    common.drop(members)
    open_ = common.materialise(_tiles(placed, sketches, percent).groupBy(*_ENDS).applyInArrow(_open_rows(percent), _TILE), "minhash-open")
    more = common.materialise(open_.join(sets, "node").groupBy(*_ENDS).applyInArrow(_joined(percent), "a long, b long"), "minhash-more")
    top = components(more)
    common.drop(placed, open_, sets)
    first = class_of.join(label, class_of["digest"] == label["node"], "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("part"))
    whole = first.join(top, first["part"] == top["node"], "left").select("digest", "doc_id", F.coalesce("component", "part").alias("component"))
    whole = common.materialise(whole, "minhash-whole")
    least = common.materialise(whole.groupBy("component").agg(F.min("doc_id").alias("component_id")), "minhash-least")
    return signed.select("doc_id", "key", "n_shingles", "digest"), common.materialise(whole.join(least, "component").select("digest", "component", "component_id"), "minhash-components")


def _placed(rows: DataFrame, percent: int) -> DataFrame:
    """A row per row: doc_id, key, n_shingles, component (null: linked with nothing and without a class), component_id."""
    signed, found = classes(rows, percent)
    return signed.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))).join(found, "digest", "left").drop("digest")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    component = F.coalesce("component_id", "doc_id")
    return _placed(_rows(docs, doc_id, text), percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one of each component, and all that link with nothing."""
    placed = common.materialise(_placed(_rows(docs, doc_id, text), percent).filter("component IS NOT NULL"), "minhash-placed-rows")
    stays = common.materialise(placed.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("stays")), "minhash-stays")
    gone = placed.join(stays, "component").filter("struct(doc_id, key) <> stays").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = common.materialise(gone, "minhash-gone")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.join(gone, ["_id", "_key"], "left_anti")
    again = common.materialise(placed.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).count().filter("count > 1").select("_id", "_key"), "minhash-again")
    if not again.isEmpty():  # rows that agree in doc_id and text: one stays
        some = common.materialise(kept.join(again, ["_id", "_key"], "left_semi").withColumn("_n", F.monotonically_increasing_id()), "minhash-repeated")
        one = common.materialise(some.groupBy("_id", "_key").agg(F.min("_n").alias("_n")).select("_n"), "minhash-one")
        kept = kept.join(again, ["_id", "_key"], "left_anti").select("_row").unionByName(some.join(one, "_n", "left_semi").select("_row"))
    return kept.select("_row.*")


def query(spark, sf_dir):
    return link(common.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), v AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM v
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
