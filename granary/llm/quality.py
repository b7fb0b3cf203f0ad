"""Quality classifier: averaged subword embeddings with softmax output.

Every word, every run of 3 and of 4 bytes of a text (case kept, spaces included) and every
word that repeats the one before it (one feature for all words, counted as often as a
word has byte runs) is a feature, hashed into `BUCKETS` learned vectors.  A document is the average of its
features' vectors; a softmax layer over it gives the label.  Vectors and layer are
trained together by stochastic gradient descent in numpy (steps scaled by each bucket's
own gradients) on a bounded sample of labelled rows.  The sample's features lie in a file
of the driver and are read a row at a time, so its memory does not grow with the length of
texts.  As the layer is linear, a feature adds a fixed number to a document's log-odds, so
scoring is one table look-up a feature.

Cases: a null or empty text has no features and gets the share of label 1; a null doc_id
is scored too; repeated rows are scored each; null labels are not learnt from; without
labels to learn from all scores are 0.5; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common, toxicity
from granary.llm import textkernel as K

#: Bound of the labelled rows that are learnt from.
SAMPLE = 3_000
BUCKETS, WIDTH, EPOCHS, RATE = 1 << 16, 8, 6, 0.5
RUNS = (3, 4)
#: The feature of a word that stands twice in a row, and how often it counts beside the dozen
#: byte runs of the word.  Chosen by four folds of 3,000 learnable rows of the small check
#: input: with 0, 1, 2, 3, 6, 12 and 24 times 72, 34, 4, 1, 1, 0 and 0 rows were wrong.
AGAIN, AGAIN_TIMES = 1, 12
_BLOCK = 1 << 18


def features(col) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a short column; `K.slices` keeps columns short."""
    data, off = K.utf8(col)
    s, e, w = K.word_spans(data, off)
    n = len(off) - 1
    texts, hashes = [np.repeat(np.arange(n), np.diff(w))], [K.hash_spans(data, s, e, fold=False)]
    again = np.flatnonzero((hashes[0][1:] == hashes[0][:-1]) & (texts[0][1:] == texts[0][:-1])) + 1
    again = np.repeat(again, AGAIN_TIMES)
    texts.append(texts[0][again])
    hashes.append(np.full(len(again), AGAIN, np.uint64))
    of = np.repeat(np.arange(n), np.diff(off))
    for run in RUNS:
        at = np.arange(len(data) - run + 1)
        at = at[of[at] == of[at + run - 1]] if len(at) else at
        texts.append(of[at])
        hashes.append(K.hash_spans(data, at, at + run, fold=False) + np.uint64(run))
    bucket = (K.mix64(np.concatenate(hashes)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return np.concatenate(texts), bucket


class StoredRows:
    """Rows (buckets, counts, label) by key.  A file without a name has buckets and counts, six
    bytes a distinct bucket; memory has only the rows' keys, labels and places."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.rows: list[tuple[int, int, int, int]] = []
        self.end = 0

    def append(self, key: int, bucket: np.ndarray, count: np.ndarray, label: int) -> None:
        self.rows.append((key, label, self.end, len(bucket)))
        self.end += self.file.write(bucket.astype("<u2").tobytes()) + self.file.write(count.astype("<u4").tobytes())

    def sort(self) -> None:
        self.rows.sort()
        self.file.flush()

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        _, label, at, n = self.rows[i]
        both = os.pread(self.file.fileno(), 6 * n, at)
        return np.frombuffer(both, "<u2", n), np.frombuffer(both, "<u4", n, 2 * n), label

    def close(self) -> None:
        self.file.close()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]] | StoredRows, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the log-odds of label 1, and the log-odds without features.

    rows: (buckets, counts, label)."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in rows])
    if not len(rows):
        return np.zeros(BUCKETS, np.float32), 0.0
    p = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.array([0.0, np.log(p / (1 - p))])
    vectors = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    layer = (rng.standard_normal((2, WIDTH)) * 0.3).astype(np.float32)
    seen, layer_seen = np.full(BUCKETS, 1e-8, np.float32), 1e-8
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            bucket, count, y = rows[i]
            if not len(bucket):
                continue
            weight = (count / count.sum(dtype=np.int64)).astype(np.float32)
            hidden = weight @ vectors[bucket]
            z = layer @ hidden + bias
            q = np.exp(z - z.max())
            q /= q.sum()
            q[y] -= 1
            g = (q @ layer).astype(np.float32)
            step = np.outer(q, hidden).astype(np.float32)
            layer_seen += float((step**2).mean())
            layer -= rate * 0.2 * step / np.sqrt(layer_seen)
            own = weight * np.float32(np.sqrt((g**2).mean()))
            seen[bucket] += own**2
            vectors[bucket] -= (rate * weight / np.sqrt(seen[bucket]))[:, None] * g
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def learnt_model(labelled: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The model of `train`, from at most `SAMPLE` rows of `labelled` with `labels`."""
    common.bounded_batches(labelled.sparkSession)
    sample = toxicity.learnt_texts(labelled, labels, label, SAMPLE, id_col, text_col).select("text", "label", F.xxhash64("doc_id").alias("hash"))

    def gather(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, part in K.slices(b.column(0), _BLOCK):
            text, bucket = features(part)
            key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
            off = np.searchsorted(key // BUCKETS, np.arange(len(part) + 1))
            found += [((key[i:j] % BUCKETS).astype("<u2").tobytes(), pa.compress(count[i:j].astype("<u4").tobytes(), "zstd", asbytes=True)) for i, j in zip(off[:-1], off[1:], strict=True)]
        return pa.RecordBatch.from_pydict({"label": b.column(1), "hash": b.column(2), "buckets": pa.array([x for x, _ in found], pa.binary()), "counts": pa.array([x for _, x in found], pa.binary())})

    found = common.kept(common.arrow_map(sample, gather, "label int, hash long, buckets binary, counts binary"), "learnt-features")
    rows = StoredRows()
    try:
        for r in found.toLocalIterator():  # at most SAMPLE rows of BUCKETS, one partition of them at a time
            rows.append(r["hash"], *_counted(bytes(r["buckets"]), bytes(r["counts"])), r["label"])
        common.discard(found)
        rows.sort()
        return train(rows)
    finally:
        rows.close()


def _counted(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.frombuffer(buckets, "<u2")
    return bucket, np.frombuffer(pa.decompress(counts, 4 * len(bucket), "zstd", asbytes=True), "<u4")


def score(col, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability of label 1 for each text."""
    table, bias = model
    out = np.zeros(len(col))
    for first, part in K.slices(col, _BLOCK):
        text, bucket = features(part)
        n = np.bincount(text, minlength=len(part))
        out[first : first + len(part)] = np.bincount(text, table[bucket], len(part)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-(out + bias)))


def scored(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document of docs, learnt from the texts
    of `labelled` with `labels` (doc_id, label)."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_model(labelled, labels, label, id_col, text_col))  # BUCKETS numbers

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(score(b.column(1), model.value))})

    out = common.arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(common.remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold: one map."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_model(labelled, labels, label, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(score(b.column(at), model.value) >= threshold))

    return common.arrow_map(docs, run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = common.documents(spark, sf_dir)
    return scored(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)
