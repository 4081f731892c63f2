"""Embedding near-dedup by PCA-ordered tiled comparison (operator 2).

Vectors are scaled to length 1 and rotated onto the principal axes of a bounded sample (the rotation changes speed, not
results). Vectors with cosine t or more are at most sqrt(2 - 2t) apart, so also along each axis: cells of that width along
the first axis need comparing with themselves and their neighbours only. A cell of more than BLOCK vectors is divided along
the second axis, and then along the third; what is larger still is split into blocks of BLOCK vectors by hash, whatever its
size. Every two blocks of neighbouring cells are a tile. Inside a tile the leading STEP dimensions are accumulated first;
the rest of a product is at most the product of the suffix norms, and a pair whose bound is under the threshold stops.
Products within MARGIN of the threshold are taken again on the vectors as given, in one order for either end of a pair.

Vectors move as their own bytes, floats as floats; tiles scale and rotate them again. Tiles return no pairs: the number of
links of each vector, and a spanning forest of the tile's links, from which components are found. Sums and components
don't depend on how vectors were dealt.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components, vectors without a label or a
vec_id link with nothing and are their own component; vectors of different lengths are not compared; of tied or equal
vectors all are linked, and the smallest vec_id stands for them; rows that repeat a vec_id are compared as vectors of their
own, and each gets the id's summed figures; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm import common
from folioscan.llm.components import components

THRESHOLD, SAMPLE, BLOCK, STEP = 0.93, 4096, 2048, 16
#: What rounding may change of a product, and the axes along which cells are divided.
MARGIN, AXES = 1e-9, 3


def principal_axes(rows: list[list[float]]) -> np.ndarray:
    x, lengths = scaled(np.asarray(rows))
    x /= lengths[:, None]
    return np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1]))[1][:, ::-1].copy()


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two each, which changes no bit and keeps squares in range; and their lengths."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def rotated(x: np.ndarray, lengths: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    u = x / lengths[:, None]
    return u @ axes if axes is not None and u.shape[1] == len(axes) else u


def _celled(axes: np.ndarray | None, width: float):
    """(vec_id, label, dims, embedding) to its cells along the first axes and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column(2).to_numpy()
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dims)])
            cells = np.zeros((len(dims), AXES), dtype=np.int32)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                u = rotated(*scaled(flat[ends[rows][:, None] + np.arange(d)]), axes)
                some = min(AXES, d)
                cells[rows, :some] = np.floor(u[:, :some] / width)
            raw = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(cells[:, k]) for k in range(AXES)), raw], ["vec_id", "label", "dims", *(f"c{k}" for k in range(AXES)), "vec"])

    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def join_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The compressed forest after linking a[i] with b[i]."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _roots(parent)


def linked(a: np.ndarray, b: np.ndarray, threshold: float, step: int, exact) -> np.ndarray:
    """Which pairs of rows of a and b (unit vectors) have a product of threshold or more; exact(i, j) says so where rounding matters."""
    dims, at = a.shape[1], min(step, a.shape[1])
    rest = lambda x, k: np.sqrt(np.maximum(0.0, (x[:, k:] ** 2).sum(1)))
    products = a[:, :at] @ b[:, :at].T
    ra, rb = rest(a, at), rest(b, at)
    open_ = products + ra[:, None] * rb[None, :] >= threshold - MARGIN
    while at < dims and open_.any():
        nxt = min(dims, at + step)
        if open_.mean() > 0.02:
            products += a[:, at:nxt] @ b[:, at:nxt].T
            ra, rb = rest(a, nxt), rest(b, nxt)
            open_ &= products + ra[:, None] * rb[None, :] >= threshold - MARGIN
        else:
            ra, rb = rest(a, nxt), rest(b, nxt)
            i, j = np.nonzero(open_)
            for lo in range(0, len(i), 1 << 15):
                p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                products[p, q] += np.einsum("ij,ij->i", a[p, at:nxt], b[q, at:nxt])
                open_[p, q] = products[p, q] + ra[p] * rb[q] >= threshold - MARGIN
        at = nxt
    hit = open_ & (products >= threshold + MARGIN)
    i, j = np.nonzero(open_ & ~hit & (products >= threshold - MARGIN))
    for lo in range(0, len(i), 1 << 13):
        p, q = i[lo : lo + (1 << 13)], j[lo : lo + (1 << 13)]
        hit[p, q] = exact(p, q)
    return hit


def _tile(threshold: float, step: int, axes: np.ndarray | None, kind: type):
    def run(table: pa.Table) -> pa.Table:
        ids, side = table["vec_id"].to_numpy(), table["side"].to_numpy()
        x, lengths = scaled(np.frombuffer(b"".join(table["vec"].to_pylist()), dtype=kind).reshape(len(ids), -1))
        order = np.argsort(side, kind="stable")
        ids, x, lengths, na = ids[order], x[order], lengths[order], int((side == 0).sum())
        u = rotated(x, lengths, axes)
        same = na == len(ids)
        off = 0 if same else na
        counts, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for lo in range(0, na, 256):
            exact = lambda p, q, lo=lo: (x[p + lo] * x[q + off]).sum(1) / (lengths[p + lo] * lengths[q + off]) >= threshold
            hit = linked(u[lo : min(lo + 256, na)], u[off:], threshold, step, exact)
            if same:
                hit[np.arange(hit.shape[0]), lo + np.arange(hit.shape[0])] = False
            i, j = np.nonzero(hit)
            counts[lo : lo + hit.shape[0]] += hit.sum(1)
            if not same:
                counts[off:] += hit.sum(0)
            parent = join_links(parent, i + lo, j + off)
        some = np.flatnonzero(counts)
        return pa.table({"vec_id": ids[some], "n": counts[some], "root": ids[parent[some]]}, schema=pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return run


def _tiles(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The cell and block of every vector, and (cell, block) to the tiles that it is a side of."""
    group, fine = ["label", "dims"], [f"c{k}" for k in range(AXES)]
    per = rows.groupBy(*group, *fine).agg(F.count("*").alias("n0"))
    # windows over cells, of which a label has a bounded number
    for k in range(1, AXES + 1):
        per = per.withColumn(f"n{k}", F.sum("n0").over(Window.partitionBy(*group, *fine[:k])))
    whole, keys = F.lit(True), ["c0"]
    for k in range(1, AXES):
        whole = whole & (F.col(f"n{k}") > block)  # divided along axis k
        per = per.withColumn(f"k{k}", F.when(whole, F.col(f"c{k}")))
        keys.append(f"k{k}")
    size = F.col(f"n{AXES}")
    for k in reversed(range(1, AXES)):
        size = F.when(F.col(f"k{k}").isNull(), F.col(f"n{k}")).otherwise(size)
    per = common.materialise(per.withColumn("blocks", F.ceil(size / block).cast("int")).withColumn("cell", F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("*")) for k in keys])).select(*group, *fine, *keys[1:], "cell", "blocks"), "embedding-cells")
    cells = per.select(*group, *keys, "cell", "blocks").distinct()
    each = cells.select(*group, *keys, "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a, b = (each.select(*group, *[F.col(c).alias(f"{side}_{c}") for c in [*keys, "cell", "block"]]) for side in "ab")
    # blocks meet by equal keys of their first two axes, so that no key holds a label: one side asks for the cells around its own.
    # Where a side isn't divided along the second axis, the pair meets by a key of its own ("any", "none"), once
    second, name = keys[1], lambda c: F.concat(F.lit("at"), c.cast("string"))
    asks = F.when(F.col(f"a_{second}").isNull(), F.array(F.lit("any"))).otherwise(F.array(F.lit("none"), *[name(F.col(f"a_{second}") + d) for d in (-1, 0, 1)]))
    offers = F.when(F.col(f"b_{second}").isNull(), F.array(F.lit("any"), F.lit("none"))).otherwise(F.array(F.lit("any"), name(F.col(f"b_{second}"))))
    a = a.withColumn("_c0", F.explode(F.array(*[F.col("a_c0") + d for d in (-1, 0, 1)]))).withColumn("_c1", F.explode(asks))
    b = b.withColumn("_c0", F.col("b_c0")).withColumn("_c1", F.explode(offers))
    near = F.expr("abs(a_c0 - b_c0) <= 1 AND (a_cell < b_cell OR (a_cell = b_cell AND a_block <= b_block))")
    for k in keys[1:]:
        near = near & F.expr(f"coalesce(abs(a_{k} - b_{k}) <= 1, true)")
    tiles = a.join(b, [*group, "_c0", "_c1"]).filter(near).withColumn("tile", F.concat_ws("|", "a_cell", "a_block", "b_cell", "b_block"))
    one = F.expr("a_cell = b_cell AND a_block = b_block")
    ends = tiles.select(*group, "tile", F.explode(F.when(one, F.array(F.struct(F.col("a_cell").alias("cell"), F.col("a_block").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(*[F.struct(F.col(f"{s}_cell").alias("cell"), F.col(f"{s}_block").alias("block"), F.lit(k).alias("side")) for k, s in enumerate("ab")])
    )).alias("e")).select(*group, "tile", "e.*")
    dealt = rows.join(per, [*group, *fine]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    return dealt.select(*group, "cell", "block", "vec_id", "vec"), ends


def link(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """vectors (vec_id, label, embedding) to (vec_id, n_links) of the linked ones, and links (a, b) that span the components."""
    v = F.col("embedding")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    v = v if element == "float" else v.cast("array<double>")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size(v).alias("dims"), v.alias("embedding"))
    good = named.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & F.exists(v, lambda e: e != 0))
    widest = good.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    axes = None
    if widest:
        some = good.filter(F.col("dims") == widest[0]["dims"]).orderBy(F.xxhash64("vec_id")).limit(sample)
        axes = principal_axes([r["embedding"] for r in some.select("embedding").collect()])
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    cells = ", ".join(f"c{k} int" for k in range(AXES))
    rows = common.materialise(common.map_arrow(good, _celled(axes, width), f"vec_id long, label string, dims int, {cells}, vec binary"), "embedding-rows")
    dealt, ends = _tiles(rows, block)
    work = dealt.join(ends, ["label", "dims", "cell", "block"]).select("label", "dims", "tile", "side", "vec_id", "vec")
    out = work.groupBy("label", "dims", "tile").applyInArrow(_tile(threshold, step, axes, kind), "vec_id long, n long, root long")
    out = common.materialise(out, "embedding-tiles")
    return out.groupBy("vec_id").agg(F.sum("n").alias("n_links")), out.filter("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    counts, links = link(vectors, threshold, **sizes)
    labels = components(links)
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir):
    return dedup(common.read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""
