"""Token-id files of patched frame-of-reference blocks.

A segment holds the ids of whole documents in ascending doc_id order.  Its ids are
cut into blocks of 128.  A block stores its least id, and every id less that base in
as many bits as `PERCENTILE` of its ids need; the rest are exceptions, kept as
(place, value) lists.  An index of block starts gives random access.  Layout, all
little-endian:

    "PFR1" | u32 documents, u32 blocks, u32 exceptions, u64 ids
    i64 doc_id[documents] | u8 doc_id is null[documents] | u32 ids in it[documents]
    u32 base[blocks] | u8 width[blocks] | u8 exceptions in it[blocks] | u32 start[blocks], in 16-byte units
    packed bits | u8 place[exceptions] | u32 value[exceptions]

Segments are written by Spark as the binary column of Parquet files, so any store
that Spark reaches will do; range partitions of doc_id are encoded independently, and
only one total per partition is needed to number all ids.

Cases: a null or empty text has only the end id; a null doc_id sorts first; repeated
rows are documents of their own, ordered by text; no rows give no segments; other
columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common, tokens

BLOCK, PERCENTILE, SEGMENT_IDS = 128, 90, 1 << 20
PARTITION_BYTES = 16 << 20
_HEAD = struct.Struct("<4sIIIQ")
_U64 = np.uint64


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(128, blocks) values below 2**w -> (blocks, 2 w) words."""
    out = np.zeros((2 * w, v.shape[1]), _U64)
    for i in range(BLOCK):
        at, shift = divmod(i * w, 64)
        out[at] |= v[i] << _U64(shift)
        if shift + w > 64:
            out[at + 1] |= v[i] >> _U64(64 - shift)
    return out.T


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[1]), _U64)
    mask = _U64((1 << w) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * w, 64)
        x = words[at] >> _U64(shift)
        if shift + w > 64:
            x = x | words[at + 1] << _U64(64 - shift)
        out[i] = x & mask
    return out


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment from the documents' ids one after another."""
    blocks = -(-len(ids) // BLOCK)
    full = np.empty((blocks, BLOCK), np.uint32)
    full.reshape(-1)[: len(ids)] = ids
    if len(ids):
        full.reshape(-1)[len(ids) :] = ids[-1]
    base = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = full - base[:, None]
    bits = np.frexp(over.astype(np.float64))[1].astype(np.uint8)  # of 0: 0
    width = np.partition(bits, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if blocks else np.zeros(0, np.uint8)
    outside = bits > width[:, None]
    b, place = np.nonzero(outside)
    value = over[b, place]
    over[outside] = 0
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(width, out=start[1:])
    packed = np.zeros(2 * int(start[-1]), _U64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            v = np.ascontiguousarray(over[own].T).astype(_U64)
            packed[(2 * start[own])[:, None] + np.arange(2 * int(w))] = _pack(v, int(w))
    known = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join(
        [
            _HEAD.pack(b"PFR1", len(doc_ids), blocks, len(value), len(ids)),
            known.tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            lengths.astype("<u4").tobytes(),
            base.astype("<u4").tobytes(),
            width.astype(np.uint8).tobytes(),
            np.bincount(b, minlength=blocks).astype(np.uint8).tobytes(),
            start[:-1].astype("<u4").tobytes(),
            packed.astype("<u8", copy=False).tobytes(),
            place.astype(np.uint8).tobytes(),
            value.astype("<u4").tobytes(),
        ]
    )


class Segment:
    """A parsed segment; `ids` decodes all, `block` only one."""

    def __init__(self, data: bytes):
        magic, docs, self.blocks, exceptions, self.n_ids = _HEAD.unpack_from(data)
        if magic != b"PFR1":
            raise ValueError("not a segment of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.base, self.width, self.counts, self.start = take("<u4", self.blocks), take("u1", self.blocks), take("u1", self.blocks), take("<u4", self.blocks).astype(np.int64)
        self.packed = take("<u8", 2 * int(self.width.sum(dtype=np.int64)))
        self.place, self.value = take("u1", exceptions), take("<u4", exceptions)
        self.exception = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def _decode(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BLOCK), np.uint32)
        for w in np.unique(self.width[which]):
            own = np.flatnonzero(self.width[which] == w)
            if w:
                words = self.packed[(2 * self.start[which[own]])[:, None] + np.arange(2 * int(w))]
                out[own] = _unpack(words, int(w)).T
        row = np.repeat(np.arange(len(which)), self.counts[which])
        if len(row):
            first = np.repeat(self.exception[which] - np.concatenate([[0], np.cumsum(self.counts[which], dtype=np.int64)[:-1]]), self.counts[which])
            at = np.arange(len(row)) + first
            out[row, self.place[at]] = self.value[at]
        return out + self.base[which][:, None]

    def ids(self) -> np.ndarray:
        return self._decode(np.arange(self.blocks)).reshape(-1)[: self.n_ids]

    def block(self, i: int) -> np.ndarray:
        """The ids of block i alone."""
        return self._decode(np.array([i]))[0][: self.n_ids - i * BLOCK]


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts into segments: (part int, seq int, n_ids long, payload binary), kept
    in the shared folder; ascending (part, seq) is ascending doc_id."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(1, -(-common.text_bytes(rows) // PARTITION_BYTES))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = tokens.encoder(tokenizer).ids, TaskContext.get().partitionId(), 0
        ids, parts, n_ids = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in parts], np.int64)
            payload = encode_segment(ids, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([n_ids], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = encode(text.as_py()) + end
                ids.append(doc_id)
                parts.append(x)
                n_ids += len(x) // 4
                if n_ids >= SEGMENT_IDS:
                    yield flush()
                    seq, ids, parts, n_ids = seq + 1, [], [], 0
        if ids:
            yield flush()

    return common.kept(ordered.mapInArrow(run, "part int, seq int, n_ids long, payload binary"), "token-ids")


#: Partitions whose segments are added up by one task.
GROUP = 1024


def starts(segments: DataFrame) -> DataFrame:
    """(part, seq, before): ids of all segments before each.  Sums of groups of partitions are
    added up first, a row for `GROUP` partitions; then each group's segments by themselves."""
    sizes = segments.select("part", "seq", "n_ids", F.floor(F.col("part") / GROUP).cast("int").alias("group"))
    none = F.lit(0).cast("long")
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("total"))
    order = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("total").over(order), none).alias("first"))
    own = Window.partitionBy("group").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(groups, "group").select("part", "seq", (F.col("first") + F.coalesce(F.sum("n_ids").over(own), none)).alias("before"))


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from segments.

    Documents get their place within the segment; where the segment starts is joined to these
    short rows, and payloads stay where they are."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"part": [], "seq": [], "doc_id": [], "place": [], "n_tokens": [], "ids_crc32": []}
        for part, seq, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            s = Segment(payload.as_py())
            data = memoryview(s.ids().astype("<u4", copy=False).tobytes())
            offsets = np.concatenate([[0], np.cumsum(s.lengths)])
            out["part"] += [part] * len(s.doc_ids)
            out["seq"] += [seq] * len(s.doc_ids)
            out["doc_id"] += s.doc_ids
            out["place"] += offsets[:-1].tolist()
            out["n_tokens"] += s.lengths.tolist()
            out["ids_crc32"] += [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        kinds = {"part": pa.int32(), "seq": pa.int32()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    rows = common.arrow_map(segments.select("part", "seq", "payload"), run, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(starts(segments), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every text of documents through the file format and back."""
    segments = write(common.documents(spark, sf_dir), common.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read(segments)
