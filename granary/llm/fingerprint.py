"""MinHash fingerprints of documents and near-duplicate classes by signature bands.

A fingerprint has `HASHES` values.  Value i is the least of a_i * x + b_i mod 2**32 (a
permutation, as a_i is odd) over the 32-bit hashes x of a text's k-word shingles, of
which 16 mixed bits are kept.  The share of equal values of two fingerprints estimates
the Jaccard similarity of the texts' shingle sets.

Near duplicates: fingerprints are cut into `BANDS` bands; texts that share a band are
candidates, joined in Spark as posting lists and verified exactly (`links.linked`).

Cases: a null or empty text, or one without words, has the fingerprint of all ones
(ffff...), alike only to itself; a text of fewer than k words is one shingle; rows are
ordered by doc_id (nulls first), repeated ones by text; one row alone is its own next;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common, jaccard, links
from granary.llm import textkernel as K

HASHES, BANDS = 128, 32
PARTITION_BYTES = 16 << 20
_RANDOM = K.mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_A = (_RANDOM >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = _RANDOM.astype(np.uint32)[:, None]
_STEP = 2048


def signatures(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of `HASHES` 16-bit values for each text."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full((len(off) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    for i in range(len(off) - 1):
        for at in range(off[i], off[i + 1], _STEP):
            h = x[None, at : min(at + _STEP, off[i + 1])] * _A
            h += _B
            np.minimum(low[i], h.min(axis=1), out=low[i])
    out = K.mix64(low.astype(np.uint64)).astype(np.uint16)
    out[np.diff(off) == 0] = 0xFFFF
    return out


def of_texts(texts: pa.Array, k: int) -> np.ndarray:
    return signatures(*K.shingles(*K.words(texts), k))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids: pa.Array, texts: list[str], sig: np.ndarray, next_texts: list[str], next_sig: np.ndarray, k: int) -> dict[str, pa.Array]:
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, next_texts, strict=True)]
    other = of_texts(pa.array(edited, pa.large_string()), k)
    return {
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": links.binary([x.astype(">u2").tobytes() for x in sig]),
        "edited_fingerprint": links.binary([x.astype(">u2").tobytes() for x in other]),
        "near_edited": pa.array(likeness(sig, other)),
        "near_next": pa.array(likeness(sig, next_sig)),
    }


def fingerprints(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half of characters is
    replaced by the first as many of the next document.

    Texts move once, into ranges of doc_id.  Each range also reports its first and its last
    document; a second, small step joins every range's last with the next range's first."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, -(-common.text_bytes(rows) // PARTITION_BYTES))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # id, text, signature of the last row so far

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            out = {c.split()[0]: pa.nulls(1, t) for c, t in zip(_ROW.split(", "), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)}
            out |= {"doc_id": pa.array([doc_id], pa.int64()), "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "text": pa.array([text], pa.string())}
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, sig = b.column(0).to_pylist(), b.column(1).to_pylist(), of_texts(b.column(1), k)
            if held is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts, sig = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], sig])
            held = (ids[-1], texts[-1], sig[-1])
            m = len(ids) - 1
            if m:
                out = _rows(pa.array(ids[:-1], pa.int64()), texts[:-1], sig[:-1], texts[1:], sig[1:], k)
                yield pa.RecordBatch.from_pydict(out | {"kind": pa.array([0] * m, pa.int32()), "part": pa.array([part] * m, pa.int32()), "text": pa.nulls(m, pa.string())})
        if held is not None:
            yield edge(2, held[0], held[1])

    found = common.kept(ordered.mapInArrow(run, f"{_ROW}, kind int, part int, text string"), "fingerprints")
    names = [c.split()[0] for c in _ROW.split(", ")]
    first = found.where("kind = 1").select("part", F.col("text").alias("next_text"))
    # one short row a range
    order = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    last = found.where("kind = 2").select("part", "doc_id", "text").join(order, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")

    def join_edges(b: pa.RecordBatch) -> pa.RecordBatch:
        sig, next_sig = of_texts(b.column(1), k), of_texts(b.column(2), k)
        return pa.RecordBatch.from_pydict(_rows(b.column(0), b.column(1).to_pylist(), sig, b.column(2).to_pylist(), next_sig, k))

    done = found.where("kind = 0").select(*names).unionByName(common.arrow_map(last, join_edges, _ROW))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return done.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 75, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents whose fingerprints share a
    band and whose shingle sets overlap by 0.75 or more, verified exactly."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = jaccard.features(docs, k, frequencies=False)
    nodes = common.kept(jaccard.node_table(rows), "nodes")
    width = HASHES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if not b.num_rows:
                continue
            s, off = K.distinct(*K.shingles(*K.words(b.column(1)), k))
            node, n = links.digest(s, off), np.diff(off)
            own = []
            for i, x in enumerate(node.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    own.append(i)
            if not own:
                continue
            sig = signatures(s, off)[own].reshape(len(own), BANDS, width).astype(np.uint64)
            token = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for j in range(width):
                token = K.mix64(token + sig[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(token.reshape(-1).view(np.int64)),
                "doc": pa.array(np.repeat(b.column(0).to_numpy()[own], BANDS)),
                "node": pa.array(np.repeat(node[own], BANDS)),
                "n": pa.array(np.repeat(n[own].astype(np.int32), BANDS)),
                "pos": pa.array(np.zeros(len(own) * BANDS, np.int32))
            })

    postings = docs.where("doc_id is not null").mapInArrow(run, "token long, doc long, node long, n int, pos int")
    return jaccard.with_components(rows, nodes, links.linked(postings, nodes, docs, k, numerator, denominator))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(common.documents(spark, sf_dir))
