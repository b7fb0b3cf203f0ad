"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and the first bytes of longer ones (`BEGINNINGS`, so inflected forms meet).
All terms of a text are dimensions.  A term's weight is its inverse frequency over all
documents times `FLOOR`, and more the more it goes with the label among the examples; so
every term counts and a copy of an example has similarity 1.  Document frequencies are
added up in `CELLS` cells of the terms' hashes by one pass over all documents; terms that
share a cell share its count, the terms themselves stay apart.

The examples, a bounded sample of labelled rows without near copies, are an inverted index.
Similar ones stand in blocks, and every posting list has the greatest weight of each of its
blocks.  For a chunk of texts the terms that most examples have are multiplied as a matrix;
block maxima of all other terms bound what they can add, and posting lists are walked only
in blocks that can still reach one of the text's nearest `NEIGHBOURS`, so these are exact.

The vote of the nearest, weighted by similarity and drawn towards the share of the label, is
calibrated by a logistic curve over the votes that each example gets from the others.  A text
without any term gets the share of the label among examples without one.

Cases: a null or empty text has no terms; a null doc_id is scored too; repeated rows are
scored each; labels other than 0 and 1 are not learnt from, of repeated labels the greatest
counts, of a repeated labelled doc_id the least text; without any label to learn from all
scores are 0; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common, fingerprint, links
from granary.llm import textkernel as K

#: Bound of the labelled rows that are learnt from.
SAMPLE = 3_000
#: Weight of a term that does not go with the label; unlabelled rows added to a term's share
#: of the label; likelihood ratio from which on a term's share is believed by half.
FLOOR, PRIOR, HALF = 0.05, 4.0, 20.0
#: Chosen on learnable rows of the small check input alone: learnt from 300 of them, six draws,
#: of 250 other toxic ones 0.78 are caught; with 5 alone 0.73, with 5 and 7 0.72, with 4, 5, 6 and
#: 7 0.79, for more terms.
BEGINNINGS = (4, 6)
NEIGHBOURS, PULL = 15, 0.5
#: How far the calibration is held at the votes themselves, in examples.
RIDGE = 4.0
#: Terms that are multiplied as a matrix, texts scored at once, examples a block.
DENSE, CHUNK, BLOCK = 2048, 64, 16
CELLS, PIECES = 1 << 21, 16

_SEP = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_SHIFT = np.uint64(64 - CELLS.bit_length() + 1)


def terms(col) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word and word beginning of a column."""
    data, off = K.utf8(col)
    s, e, w = K.word_spans(data, off, _SEP)
    text = np.repeat(np.arange(len(off) - 1), np.diff(w))
    texts, hashes = [text], [K.hash_spans(data, s, e)]
    for n in BEGINNINGS:
        own = e - s > n
        texts.append(text[own])
        hashes.append(K.mix64(K.hash_spans(data, s[own], s[own] + n) + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def counted(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of the distinct terms of every text, in order of text."""
    text, h = terms(col)
    u, inverse = np.unique(h, return_inverse=True)
    key, count = np.unique(text * np.int64(len(u)) + inverse, return_counts=True)
    return key // max(1, len(u)), u[key % max(1, len(u))], count


# -- what is learnt ----------------------------------------------------------------


def learnt_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most `bound` labelled rows that may be learnt from, by smallest
    hash of doc_id; rows whose crc32(doc_id) mod 4 is 2 are never among them."""
    may = labels.where((common.remainder(F.col(id_col), 4) != 2) & F.col(label).isin(0, 1))
    one = may.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learnt_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text) of the rows of `learnt_rows`, one for each doc_id."""
    learnt = common.kept(learnt_rows(docs, labels, label, bound, id_col), "learnt")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(learnt), "doc_id")  # at most `bound` rows of two numbers
    return common.kept(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")), "learnt-texts")


def without_copies(sample: DataFrame) -> np.ndarray:
    """doc_ids, one of each group of near copies, so that a copied text does not make all its
    words look like signs of its label.  Copies share one of three triples of least hashes."""

    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        least = fingerprint.of_texts(b.column(1), 5)[:, :12].astype(np.int64)
        out = {f"key{i}": pa.array((((least[:, 4 * i] << 16 | least[:, 4 * i + 1]) << 16 | least[:, 4 * i + 2]))) for i in range(3)}
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | out)

    t = common.arrow_map(sample.select("doc_id", "text"), keys, "doc_id long, key0 long, key1 long, key2 long").toArrow().sort_by("doc_id")  # at most SAMPLE rows
    ids, *rest = (c.to_numpy() for c in t.columns)
    own = np.arange(len(ids))
    for key in rest:
        own = own[np.sort(np.unique(key[own], return_index=True)[1])]
    return ids[own]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequencies of all cells, and the number of documents.  Each task adds
    up its texts; the cells are added up in Spark by piece: 8 MB at any size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(CELLS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, own in K.slices(b.column(0)):
                at, n = np.unique(cell(counted(own)[1]), return_counts=True)
                count[at] += n
        if rows:
            n = [rows] + [0] * (PIECES - 1)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "rows": pa.array(n, pa.int64()), "counts": links.binary([pack(x) for x in count.reshape(PIECES, -1)])})

    def pack(x: np.ndarray) -> bytes:
        return pa.compress(x.astype("<u8").tobytes(), "zstd", asbytes=True)

    def unpack(x: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(x, 8 * (CELLS // PIECES), "zstd", asbytes=True), "<u8").astype(np.int64)

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PIECES, np.int64)
        for x in t.column("counts"):
            total += unpack(x.as_py())
        return pa.table({"piece": t.column("piece").slice(0, 1), "rows": pa.array([sum(t.column("rows").to_pylist())], pa.int64()), "counts": links.binary([pack(total)])})

    kind = "piece int, rows long, counts binary"
    df, n = np.zeros((PIECES, CELLS // PIECES), np.int64), 0
    for r in docs.select("text").mapInArrow(part, kind).groupBy("piece").applyInArrow(merge, kind).collect():  # PIECES rows
        df[r["piece"]] = unpack(bytes(r["counts"]))
        n += r["rows"]
    return idf_of(df.reshape(-1), n).astype(np.float32), n


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """At least a tenth, as a cell may count more terms than there are documents."""
    return np.maximum(np.log((n + 1) / (df + 1)) + 1, 0.1)


def association(yes: np.ndarray, no: np.ndarray, yes_all: float, no_all: float) -> np.ndarray:
    """From 0 to 1: how far a term goes with the label, from the examples with it."""
    if not yes_all or not no_all:
        return np.zeros(len(yes))
    total, both = yes_all + no_all, np.maximum(yes + no, 1)
    part = lambda x, of: x * np.log(np.maximum(x, 1) / (of * both / total))
    ratio = np.maximum(0, 2 * (part(yes, yes_all) + part(no, no_all)))
    share = yes_all / total
    lift = np.maximum(0, ((yes + PRIOR * share) / (yes + no + PRIOR) - share) / (1 - share))
    return lift**2 * ratio / (ratio + HALF)


def term_weights(sample: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the examples (doc_id, label, text), sorted, and their weights."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        text, h, _ = counted(b.column(1))
        label = b.column(0).to_numpy()[text]
        u, inverse = np.unique(h, return_inverse=True)
        total = lambda x: pa.array(np.bincount(inverse, x, len(u)).astype(np.int64))
        return pa.RecordBatch.from_pydict({"term": pa.array(u.view(np.int64)), "yes": total(label), "no": total(1 - label)})

    all_of = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    found = common.arrow_map(sample.select("label", "text"), count, "term long, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    term, yes, no = (c.to_numpy() for c in found.toArrow().columns)  # at most the terms of SAMPLE texts
    chosen = term.view(np.uint64) if len(term) else np.zeros(0, np.uint64)
    weight = idf[cell(chosen)] * (FLOOR + association(yes, no, float(all_of.get(1, 0)), float(all_of.get(0, 0))))
    order = np.argsort(chosen)
    return chosen[order], weight[order].astype(np.float32)


@dataclass
class Vectors:
    """Weighs the terms of texts: those of examples by their weights, all others by rarity alone."""

    chosen: np.ndarray
    weight: np.ndarray
    idf: np.ndarray

    def of(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in chosen, value) of terms that examples have, in order of text; the
        length of each text's whole vector, and how many terms it has."""
        text, h, count = counted(col)
        tf = 1 + np.log(count)
        at = np.searchsorted(self.chosen, h)
        at[at == len(self.chosen)] = 0
        own = self.chosen[at] == h if len(self.chosen) else np.zeros(len(h), bool)
        value = tf * FLOOR * self.idf[cell(h)]
        value[own] = tf[own] * self.weight[at[own]]
        length = np.sqrt(np.bincount(text, value**2, len(col)))
        return text[own], at[own], value[own].astype(np.float32), length, np.bincount(text, minlength=len(col))


# -- the index ---------------------------------------------------------------------


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every i and every j from start[i] up to stop[i]."""
    count = stop - start
    of = np.repeat(np.arange(len(start)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


@dataclass
class Index:
    """Unit vectors of the examples as posting lists: term t is in the examples
    `rows[start[t]:start[t + 1]]`.  Examples stand in blocks of `BLOCK`; the parts of a list
    that lie in one block are its entries, each with the greatest weight in it."""

    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    share: float
    share_without: float
    parts: dict = field(default_factory=dict)

    @staticmethod
    def of_vectors(ids: np.ndarray, labels: np.ndarray, length: np.ndarray, places: np.ndarray, weights: np.ndarray, n_terms: int) -> Index:
        """From the vectors, `length[i]` terms of example i after those of the one before.
        Examples with the same label and the same heaviest term come to stand together."""
        none = length == 0
        share = float(labels.mean()) if len(labels) else 0.0
        without = float(labels[none].sum() + share) / (none.sum() + 1) if len(labels) else 0.0
        row = np.repeat(np.arange(len(ids)), length)
        heavy = np.full(len(ids), -1, np.int64)
        by_weight = np.lexsort((weights, row))
        last = np.cumsum(length)[~none] - 1
        heavy[~none] = places[by_weight[last]]
        order = np.lexsort((ids, heavy, labels))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        by_term = np.lexsort((rank[row], places))
        start = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n_terms))])
        return Index(ids[order], labels[order], start, rank[row][by_term].astype(np.int32), weights[by_term].astype(np.float32), share, min(without, share))

    def prepared(self) -> dict:
        """The matrix of the terms that most examples have, and the entries of all others."""
        if not self.parts:
            often = np.diff(self.start)
            top = np.argsort(-often, kind="stable")[:DENSE]
            at = np.full(len(often), -1, np.int32)
            at[top] = np.arange(len(top))
            blocks = -(-len(self.ids) // BLOCK)
            m = np.zeros((len(top), blocks * BLOCK), np.float32)
            of, post = spread(self.start[top], self.start[top + 1])
            m[of, self.rows[post]] = self.weights[post]
            term, block = np.repeat(np.arange(len(often), dtype=np.int32), often), self.rows // BLOCK
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0, np.float32)
            self.parts |= {"at": at, "m": m, "blocks": blocks, "entries": np.searchsorted(term[first], np.arange(len(often) + 1)), "block": block[first], "most": most, "first": np.append(first, len(term)).astype(np.int32)}
        return self.parts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}}

    def nearest(self, own_ids: np.ndarray, text: np.ndarray, place: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Products with, and places of, the k nearest examples of every text, itself not
        counted; ties by place; product 0 and place -1 where there are fewer."""
        n = len(own_ids)
        sims, places = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        if not len(self.ids) or not len(text):
            return sims, places
        p = self.prepared()
        blocks, width = p["blocks"], p["m"].shape[1]
        often = p["at"][place] >= 0
        q = np.zeros((n, len(p["m"])), np.float32)
        q[text[often], p["at"][place[often]]] = value[often]
        s = q @ p["m"]
        own = np.full((n, width), False)
        own[:, : len(self.ids)] = own_ids[:, None] == self.ids[None, :]
        s[own] = -np.inf
        text, place, value = text[~often], place[~often], value[~often]
        # what the other terms can add in a block at most
        of, entry = spread(p["entries"][place], p["entries"][place + 1])
        at = text[of] * blocks + p["block"][entry]
        bound = np.bincount(at, value[of] * p["most"][entry], n * blocks).reshape(n, blocks)
        least = np.partition(s, width - k, axis=1)[:, width - k] if width > k else np.full(n, -np.inf)
        reach = s.reshape(n, blocks, BLOCK).max(axis=2) + bound >= least[:, None] * (1 - 1e-5) - 1e-6
        live = reach.reshape(-1)[at]
        of, entry = of[live], entry[live]
        which, post = spread(p["first"][entry], p["first"][entry + 1])
        of = of[which]
        s += np.bincount(text[of] * width + self.rows[post], value[of] * self.weights[post], n * width).reshape(n, width).astype(np.float32)
        least = np.partition(s, width - k, axis=1)[:, width - k] if width > k else np.zeros(n)
        for i, x in enumerate(s):
            near = np.flatnonzero((x >= least[i]) & (x > 0))
            near = near[np.lexsort((near, -x[near]))][:k]
            sims[i, : len(near)], places[i, : len(near)] = x[near], near
        return sims, places


def vote(col, own_ids: np.ndarray, vectors: Vectors, index: Index) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Of every text: the similarity-weighted vote of its nearest examples, drawn towards the
    share of all; whether it has terms; the nearest examples' doc_ids, nearest first."""
    n = len(col)
    text, place, value, length, count = vectors.of(col)
    yes, every, evidence = np.zeros(n), np.zeros(n), []
    cut = np.searchsorted(text, np.arange(0, n + CHUNK, CHUNK))
    for j, lo in enumerate(range(0, n, CHUNK)):
        a, b, hi = cut[j], cut[j + 1], min(n, lo + CHUNK)
        sims, places = index.nearest(own_ids[lo:hi], text[a:b] - lo, place[a:b], value[a:b])
        sims = sims / np.maximum(length[lo:hi], 1e-12)[:, None]
        every[lo:hi] = sims.sum(axis=1)
        if len(index.ids):
            yes[lo:hi] = (sims * index.labels[np.maximum(places, 0)]).sum(axis=1)
            evidence += [index.ids[p[p >= 0]].tolist() for p in places]
        else:
            evidence += [[]] * (hi - lo)
    return (yes + PULL * index.share) / (every + PULL), count > 0, evidence


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a logit(vote) + b))) of the label, by Newton steps."""
    a, b = 1.0, 0.0
    if not 0 < labels.sum() < len(labels):
        return a, b
    x = logit(votes)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        g = np.array([((p - labels) * x).sum() + RIDGE * (a - 1), (p - labels).sum() + RIDGE * b])
        h = np.array([[(w * x * x).sum() + RIDGE, (w * x).sum()], [(w * x).sum(), w.sum() + RIDGE]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(b)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


@dataclass
class Model:
    vectors: Vectors
    index: Index
    a: float = 1.0
    b: float = 0.0

    def score(self, ids: pa.Array, col) -> tuple[np.ndarray, list[list[int]]]:
        own = ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        if not len(self.index.ids):
            return np.zeros(len(col)), [[]] * len(col)
        score, evidence = np.zeros(len(col)), []
        for at, part in K.slices(col):  # memory does not grow with a batch
            v, some, near = vote(part, own[at : at + len(part)], self.vectors, self.index)
            score[at : at + len(part)] = np.where(some, 1 / (1 + np.exp(-(self.a * logit(v) + self.b))), self.index.share_without)
            evidence += near
        return score, evidence


def _lists(text: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def learnt_model(docs: DataFrame, labelled: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> Model:
    """Examples of `labelled` with `labels` (doc_id, label); frequencies of all of docs."""
    common.bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    sample = learnt_texts(labelled, labels, label, SAMPLE, id_col, text_col)
    single = context.broadcast(without_copies(sample))  # at most SAMPLE numbers
    # kept, so that what follows is one Python worker a task
    own = common.kept(common.arrow_map(sample.select("doc_id", "label", "text"), lambda b: b.filter(pa.array(np.isin(b.column(0).to_numpy(), single.value))), "doc_id long, label int, text string"), "examples")
    idf, _ = frequencies(docs.select(F.col(text_col).alias("text")))
    vectors = Vectors(*term_weights(own, idf), idf)
    shared = context.broadcast(vectors)  # CELLS numbers and the terms of SAMPLE texts

    def vector(b: pa.RecordBatch) -> pa.RecordBatch:
        text, place, value, length, _ = shared.value.of(b.column(2))
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "label": b.column(1), "places": _lists(text, b.num_rows, place.astype(np.int32)), "weights": _lists(text, b.num_rows, (value / length[text]).astype(np.float32))})

    t = common.arrow_map(own, vector, "doc_id long, label int, places array<int>, weights array<float>").toArrow()  # at most SAMPLE vectors
    flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy() for c in t.column(name).chunks]])
    length = np.concatenate([np.zeros(0, np.int64), *[np.diff(c.offsets.to_numpy()) for c in t.column("places").chunks]])
    index = Index.of_vectors(t.column("doc_id").to_numpy(), t.column("label").to_numpy().astype(np.float64), length, flat("places", np.int32), flat("weights", np.float32), len(vectors.chosen))
    model = Model(vectors, index)
    judge = context.broadcast(index)

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        votes, some, _ = vote(b.column(2), b.column(0).to_numpy(), shared.value, judge.value)
        return pa.RecordBatch.from_pydict({"label": b.column(1), "some": pa.array(some), "vote": pa.array(votes)})

    if len(index.ids):
        y, some, votes = (c.to_numpy() for c in common.arrow_map(own, judged, "label int, some boolean, vote double").toArrow().columns)  # at most SAMPLE rows
        model.a, model.b = curve(votes[some], y[some])
    judge.unpersist()
    shared.unpersist()
    return model


def scored(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence array<long>) of every document of docs,
    learnt from the texts of `labelled` with `labels` (doc_id, label)."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_model(docs, labelled, labels, label, id_col, text_col))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score, evidence = model.value.score(b.column(0), b.column(1))
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(score), "evidence": pa.array(evidence, pa.list_(pa.int64()))})

    out = common.arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", F.coalesce(common.remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def filtered(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose own score is below the threshold: one map."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_model(docs, labelled, labels, label, id_col, text_col))
    ids, text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.value.score(b.column(ids), b.column(text))[0] < threshold))

    return common.arrow_map(docs, run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = common.documents(spark, sf_dir)
    return scored(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
