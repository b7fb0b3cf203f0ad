"""Similarity join of word n-gram sets under Jaccard, by rare-first prefix filtering.

A set is put in order of how frequent its members are, rarest first.  Two sets of sizes
n and m with |a and b| >= t |a or b| share a member among the first n - ceil(t n) + 1
and m - ceil(t m) + 1; so documents are joined on these prefix members only.  Pairs then
pass a length filter, a positional filter (what is left after the shared member must
suffice), a suffix filter (counts by range of hash bound the symmetric difference) and
one exact verification.

Frequencies come from a pass over all documents that adds members up in 2**20 cells;
their order need not be exact for the join to be: any fixed order is right, and
frequent members stand out of the cells at any size.

Cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer than k words has one member; rows with equal sets link; a row
with a null doc_id has a null component_id and links with nothing; repeated rows are
returned each; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common, links
from granary.llm import textkernel as K

FREQUENCY_CELLS, PIECES = 1 << 20, 64
_SHIFT = np.uint64(64 - FREQUENCY_CELLS.bit_length() + 1)


def features(docs: DataFrame, k: int, frequencies: bool = True) -> DataFrame:
    """One pass over all texts: a row (doc_id, node, n, cells) a document, and, with
    frequencies, rows (piece, counts) of each partition's part of the frequency cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # seen holds the distinct sets of one task's share of the table, 8 bytes each
        count, seen = np.zeros(FREQUENCY_CELLS, np.int64), set()
        any_row = False
        for b in batches:
            if not b.num_rows:
                continue
            any_row = True
            s, off = K.distinct(*K.shingles(*K.words(b.column(1)), k))
            node = links.digest(s, off)
            if frequencies:
                first = np.unique(node, return_index=True)[1]
                fresh = np.array([i for i in first.tolist() if int(node[i]) not in seen], np.int64)
                seen.update(node[fresh].tolist())
                own = np.zeros(len(node), bool)
                own[fresh] = True
                count += np.bincount((s[np.repeat(own, np.diff(off))] >> _SHIFT).astype(np.int64), minlength=FREQUENCY_CELLS)
            h = links.histograms(s, off)
            n = len(node)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0),
                "node": pa.array(node),
                "n": pa.array(np.diff(off)),
                "cells": links.binary([x.tobytes() for x in h]),
                "piece": pa.nulls(n, pa.int32()),
                "counts": pa.nulls(n, pa.binary())
            })
        if frequencies and any_row:
            parts = count.astype("<u4").reshape(PIECES, -1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(PIECES, pa.int64()),
                "node": pa.nulls(PIECES, pa.int64()),
                "n": pa.nulls(PIECES, pa.int64()),
                "cells": pa.nulls(PIECES, pa.binary()),
                "piece": pa.array(range(PIECES), pa.int32()),
                "counts": links.binary([x.tobytes() for x in parts])
            })

    return common.kept(docs.mapInArrow(run, "doc_id long, node long, n long, cells binary, piece int, counts binary"), "features")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The frequency cells of all documents, added up in Spark by piece; 4 MB at any size."""

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(FREQUENCY_CELLS // PIECES, np.uint64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_py(), "<u4")
        return pa.table({"piece": t.column("piece").slice(0, 1), "counts": links.binary([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()])})

    out = np.zeros((PIECES, FREQUENCY_CELLS // PIECES), np.uint32)
    kind = "piece int, counts binary"
    for r in rows.where("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(merge, kind).collect():
        out[r["piece"]] = np.frombuffer(bytes(r["counts"]), "<u4")
    return out.reshape(-1)


def prefixes(docs: DataFrame, k: int, numerator: int, denominator: int, frequency: np.ndarray) -> DataFrame:
    """(token, doc, node, n, pos): the rare-first prefix of every set, once for equal sets of a
    partition, so a group of copies makes at most one list entry a partition."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if not b.num_rows:
                continue
            s, off = K.distinct(*K.shingles(*K.words(b.column(1)), k))
            node = links.digest(s, off).tolist()
            often = shared.value[(s >> _SHIFT).astype(np.int64)]
            docs_of = b.column(0).to_numpy()
            token, sizes, own, at = [], [], [], []
            for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                if hi == lo or node[i] in seen:
                    continue
                seen.add(node[i])
                n = hi - lo
                first = n + 1 - -(-numerator * n // denominator)
                token.append(s[lo:hi][np.argsort(often[lo:hi], kind="stable")[:first]])
                sizes.append(n)
                own.append(node[i])
                at.append(docs_of[i])
            if not token:
                continue
            lengths = np.array([len(x) for x in token])
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(np.concatenate(token).view(np.int64)),
                "doc": pa.array(np.repeat(np.array(at, np.int64), lengths)),
                "node": pa.array(np.repeat(np.array(own, np.int64), lengths)),
                "n": pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                "pos": pa.array(pos.astype(np.int32))
            })

    return docs.mapInArrow(run, "token long, doc long, node long, n int, pos int")


def node_table(rows: DataFrame) -> DataFrame:
    """(node, doc_id, n, cells): one row for equal sets, with their smallest doc_id."""
    own = rows.where("piece is null and doc_id is not null and n > 0")
    return own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("cells").alias("cells"))


def with_components(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    of = nodes.select("node", "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"))
    own = rows.where("piece is null").select("doc_id", "node", "n")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return own.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def similar(docs: DataFrame, k: int = 5, numerator: int = 75, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents under links."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = features(docs, k)
    frequency = frequencies(rows)
    nodes = common.kept(node_table(rows), "nodes")
    found = links.linked(prefixes(docs.where("doc_id is not null"), k, numerator, denominator, frequency), nodes, docs, k, numerator, denominator)
    return with_components(rows, nodes, found)


def deduplicated(docs: DataFrame, k: int = 5, numerator: int = 75, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one document of each class: that with the smallest
    doc_id.  Rows of one doc_id are one document; of those with equal texts one stays.  Rows
    without a doc_id stay."""
    found = common.kept(similar(docs, k, numerator, denominator, id_col, text_col).select("doc_id", "component_id"), "classes")
    out = links.without(docs, found.where("doc_id <> component_id").select("doc_id"), id_col)
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    ids = again.select(F.col("doc_id").alias("_again"))
    return links.without(out, again, id_col).union(out.join(ids, F.col(id_col) == F.col("_again"), "left_semi").dropDuplicates([id_col, text_col]))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents whose five-word shingles overlap by 0.75."""
    return similar(common.documents(spark, sf_dir))


#: All pairs that share a shingle, and what links reach.
ORACLE_SQL = """WITH RECURSIVE word AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM word),
one AS (SELECT doc_id, unnest(g) AS s FROM grams),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, low AS component_id FROM grams JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) ON x = doc_id"""
