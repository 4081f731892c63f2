"""Byte-level BPE encoding and decoding by overlapping chunks (operator 5).

A text longer than CHUNK characters is cut into chunks that overlap by OVERLAP. Each chunk is pre-tokenised by itself,
in parallel; its first pre-tokens may be cut wrongly, as it starts anywhere. Where the pre-tokens of a chunk and those
of the next one have a common boundary inside their overlap they have resynchronised, and agree from there on (matching
goes on from a position without looking back): the chunks are stitched at that place. Then the pieces are encoded by
the ranks. A text without a common boundary in some overlap (one endless word) is pre-tokenised whole instead. Texts of
one chunk need no stitching and no shuffle. Decoding concatenates the tokens' raw bytes.

Pieces are merged by the library's core, which takes a stretch between two boundaries of the text at a time.

Defined cases: null text is encoded as the empty text (no ids; hashes of nothing); special strings in a text are
ordinary text; rows with equal or null doc_ids are kept apart by their own row key. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import common

#: Characters of a chunk and of an overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 11

_OTHER_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_loaded: dict = {}


class Codec:
    """The ranks of a vocabulary file with the pattern that splits text before merging."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = regex.compile(pattern).findall
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.bytes_of}

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        known = self.ranks.get(raw)
        return [known] if known is not None else self.core.encode_single_piece(raw)

    def encode(self, text: str) -> list[int]:
        """The ids of a stretch that starts and ends at boundaries."""
        return self.core.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """Of the ids in decimals, and of the decoded bytes."""
        return hashlib.sha256(" ".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def boundaries(pieces: list[str], start: int, until: int) -> list[int]:
    """Ends of the pieces, as places in the text; those at until or after it are not certain and left out."""
    out = [start]
    for p in pieces:
        start += len(p)
        if start >= until:
            break
        out.append(start)
    return out


def stitch_place(c: Codec, text: str, start: int, nxt: int, overlap: int) -> int | None:
    """The first boundary that the pre-tokens from start and those from the overlap before nxt have in common.

    text holds the places start to nxt of a document. What precedes the overlap needs matching only from the last unit
    that begins before it, as units begin at boundaries of either chunk.
    """
    lo = nxt - overlap
    back = lo - start
    begin = 0
    if not _OTHER_SPACE.search(text):
        window = text[:back]
        begin = max((m.start() for m in re.finditer(r"(?<=[^ \t-\r])[ \t-\r]", window[-4096:])), default=-1)
        begin = begin + max(0, len(window) - 4096) if begin >= 0 else 0
    ours = boundaries(c.pieces(text[begin:]), start + begin, nxt)
    theirs = set(boundaries(c.pieces(text[back:]), lo, nxt))
    # only where something other than white space ends: what follows can't have been looked at
    return next((b for b in ours if b >= lo and b in theirs and (b == start or not text[b - start - 1].isspace())), None)


def _whole(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            counts, ids_digests, decoded, arrays = [], [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                one, two = c.digests(ids)
                counts.append(len(ids))
                ids_digests.append(one)
                decoded.append(two)
                if with_ids:
                    arrays.append(np.asarray(ids, dtype=np.int32))
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *counts], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32))).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def _cut(chunk: int, overlap: int):
    """(row, doc_id, text) to a row per chunk, which starts an overlap before its share: row, doc_id, k, start, last, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                places = [(s, min(len(text), s + chunk)) for s in range(0, len(text), chunk)]
                for i in range(0, len(places), 16):
                    some = places[i : i + 16]
                    yield pa.RecordBatch.from_pydict({
                        "row": [row] * len(some), "doc_id": pa.array([doc] * len(some), pa.int64()), "k": pa.array([s // chunk for s, _ in some], pa.int32()),
                        "start": pa.array([max(0, s - overlap) for s, _ in some], pa.int64()), "last": [e == len(text) for _, e in some], "part": [text[max(0, s - overlap) : e] for s, e in some],
                    })

    return run


def _chunked(path: str, pattern: str, overlap: int):
    """Chunks to their encoded pieces: what precedes the place that the chunk before chose is left for the stitching.

    head holds the pieces that end inside the overlap with the chunk before, ids the rest up to where the next chunk takes over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            rows = []
            for k, start, last, part in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                nxt = start + len(part)
                place = nxt if last else stitch_place(c, part, start, nxt, overlap)
                head, ids = [], []
                if place is not None:
                    body = part[: place - start]
                    if k:  # the boundaries up to the end of the overlap, with how many ids precede each
                        first, at = [], start
                        cut_at = body.find(" ", overlap)
                        while 0 < cut_at and (body[cut_at - 1].isspace()):
                            cut_at = body.find(" ", cut_at + 1)
                        cut_at = len(body) if cut_at < 0 or _OTHER_SPACE.search(body) else cut_at
                        for p in c.pieces(body[:cut_at]):
                            head.append({"at": at, "n": len(first)})
                            first += c.piece_ids(p)
                            at += len(p)
                        head = [h for h in head if h["at"] <= start + overlap] + ([{"at": at, "n": len(first)}] if at <= start + overlap else [])
                        ids = first + c.encode(body[cut_at:])
                    else:
                        ids = c.encode(body)
                rows.append((place, head, ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32())]))), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["row", "doc_id", "k", "place", "head", "ids"],
            )

    return run


def _stitched(path: str, pattern: str, with_ids: bool):
    """One document's chunks, in order, to its row; n_tokens is null where the chunks can't be stitched."""

    def run(table: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        rows = sorted(table.select(["k", "place", "head", "ids"]).to_pylist(), key=lambda r: r["k"])
        ids: list[int] | None = []
        for r, before in zip(rows, [None, *rows], strict=False):
            skip = 0
            if before is not None and before["place"] is not None:
                skip = next((h["n"] for h in r["head"] or [] if h["at"] == before["place"]), None)
            if r["place"] is None or skip is None:
                ids = None
                break
            ids += r["ids"][skip:]
        done = ids is not None
        one, two = c.digests(ids) if done else (None, None)
        cols = {
            "row": table["row"][:1], "doc_id": table["doc_id"][:1], "n_tokens": pa.array([len(ids) if done else None], pa.int64()),
            "ids_sha256": pa.array([one], pa.string()), "decoded_sha256": pa.array([two], pa.string()),
        }
        return pa.table(cols | ({"ids": pa.array([ids], pa.list_(pa.int32()))} if with_ids else {}))

    return run


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: ids too."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = lambda some: common.map_arrow(some, _whole(path, pattern, with_ids), f"doc_id long, {fields}")
    short = whole(rows.filter(F.octet_length("text") <= chunk))
    # the row key names rows whose doc_ids agree: copies of one text and doc_id give equal rows, so a number among them is enough
    long_ = rows.filter(F.octet_length("text") > chunk)
    keyed = common.materialise(long_.select(F.concat_ws(":", F.expr("uuid()")).alias("row"), "doc_id", "text"), "bpe-long")
    chunks = common.map_arrow(keyed, _cut(chunk, overlap), "row string, doc_id long, k int, start long, last boolean, part string").repartition("row", "k")
    coded = common.map_arrow(chunks, _chunked(path, pattern, overlap), "row string, doc_id long, k int, place long, head array<struct<at:long,n:int>>, ids array<int>")
    joined = common.materialise(coded.groupBy("row").applyInArrow(_stitched(path, pattern, with_ids), f"row string, doc_id long, {fields}"), "bpe-stitched")
    odd = keyed.join(joined.filter("n_tokens IS NULL").select("row"), "row", "left_semi").select("doc_id", "text")
    odd = whole(odd)
    return short.unionByName(joined.filter("n_tokens IS NOT NULL").drop("row")).unionByName(odd)


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir):
    return encode(common.read_table(spark, sf_dir, "documents"), *tokenizer())
