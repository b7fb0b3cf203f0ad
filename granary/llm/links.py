"""Links between texts: star pairs, exact verification and connected components.

Texts with equal shingle sets are one node.  A node is known by a 64-bit digest of its
set; its smallest doc_id stands for it when its text is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm import textkernel as K

#: Bits of the filter of wanted doc_ids (8 MB); with more ids it only passes more rows.
FILTER_BITS = 1 << 26
#: Cells of the histogram behind the suffix filter.
CELLS = 256


def digest(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One int64 for each set of sorted hashes; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix64(sets), dtype=np.uint64)])
    flip = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(off).astype(np.uint64)
    a, b = total[off[1:]] - total[off[:-1]], flip[off[1:]] - flip[off[:-1]]
    out = K.mix64(a + K.mix64(b + n)).astype(np.uint64)
    out[(out == 0) & (n > 0)] = 1
    out[n == 0] = 0
    return out.view(np.int64)


def histograms(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of each set's members by range of hash, at most 255 a cell.  The sum of
    differences of two histograms is never more than the sets' symmetric difference."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    cell = (sets >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    out = np.bincount(row * CELLS + cell, minlength=n * CELLS)
    return np.minimum(out, 255).astype(np.uint8).reshape(n, CELLS)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def runs(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by key, with the keys."""
    for b in batches:
        if b.num_rows:
            yield b, key(b)


def star_pairs(postings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Every node of a posting list with the list's first node in the given order, that one
    included; lists of one node are left out.

    postings: (*keys, node, n, more columns).  One streaming pass over sorted partitions:
    nothing but the first row of the current list is held, however long the list."""
    columns = [c for c in postings.columns if c not in keys]
    ordered = postings.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = {f.name: f.dataType.simpleString() for f in postings.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} {kinds[c]}" for c in columns] + [f"first_{c} {kinds[c]}" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key and row of the current list's first posting
        told = False  # whether that row was given out
        for b in batches:
            if not b.num_rows:
                continue
            arrays = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
            ks = np.stack([arrays[k].astype(np.int64) for k in keys], axis=1)
            new = np.ones(len(ks), bool)
            new[1:] = (ks[1:] != ks[:-1]).any(axis=1)
            if held is not None and tuple(ks[0]) == held[0]:
                new[0] = False
            # place of the first posting for every row; -1 is the held one
            first = np.maximum.accumulate(np.where(new, np.arange(len(ks)), -1))
            firsts = {}
            for c in columns:
                v = arrays[c][np.maximum(first, 0)]
                firsts[c] = v if held is None else np.where(first < 0, np.asarray(held[1][c], v.dtype), v)
            keep = np.flatnonzero(firsts["node"] != arrays["node"])
            if len(keep):
                lists, at = np.unique(first[keep], return_index=True)
                head = keep[at[(lists >= 0) | (not told)]]  # once for each list of two nodes at least
                out = {k: np.concatenate([arrays[k][head], arrays[k][keep]]) for k in keys}
                out |= {c: np.concatenate([firsts[c][head], arrays[c][keep]]) for c in columns}
                out |= {f"first_{c}": np.concatenate([firsts[c][head], firsts[c][keep]]) for c in columns}
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in out.items()})
            at = int(first[-1])
            if at >= 0:
                held, told = (tuple(ks[-1]), {c: arrays[c][at] for c in columns}), False
            told = told or bool(len(keep) and first[keep[-1]] == at)

    return ordered.mapInArrow(run, schema)


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of the doc_ids: `FILTER_BITS` bits, whatever their number.

    Each partition's bits are ORed by range of bits in Spark; the driver gets one bounded
    bitmap."""
    span = FILTER_BITS >> 6  # bits a piece, 64 pieces

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        any_row = False
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            any_row = any_row or len(x) > 0
            bits[_bit(x)] = True
        if any_row:
            piece = np.packbits(bits).reshape(64, -1)
            own = np.flatnonzero(piece.any(axis=1))
            yield pa.RecordBatch.from_pydict({"piece": pa.array(own.astype(np.int32)), "bits": binary([piece[i].tobytes() for i in own])})

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(span >> 3, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": binary([out.tobytes()])})

    kind = "piece int, bits binary"
    rows = ids.coalesce(32).mapInArrow(part, kind).groupBy("piece").applyInArrow(merge, kind).collect()
    out = np.zeros((64, span >> 3), np.uint8)
    for r in rows:
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _bit(x: np.ndarray) -> np.ndarray:
    return (K.mix64(x.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members binary) of the wanted nodes: sorted 64-bit shingle hashes.

    docs: (doc_id, text); wanted: (node, doc_id), a row a node.  A bounded bitmap keeps
    nearly all other texts out of the shuffle; the join keeps out the rest."""
    bitmap = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted.select("doc_id")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = b.column(0)
        at = _bit(ids.fill_null(0).to_numpy(zero_copy_only=False))
        ok = (bitmap.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        if not ok.any():
            return None
        own = b.filter(pa.array(ok))
        s, off = K.distinct(*K.shingles(*K.words(own.column(1)), k))
        return pa.RecordBatch.from_pydict({"doc_id": own.column(0), "node": pa.array(digest(s, off)), "members": binary([s[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)])})

    found = common.arrow_map(docs, run, "doc_id long, node long, members binary")
    return found.join(wanted, ["doc_id", "node"], "left_semi").drop("doc_id").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets overlap enough, verified once and exactly, as
    (a, b) of the nodes' smallest doc_ids.

    nodes: (node, doc_id, n, cells).  First the suffix filter drops pairs whose histograms
    differ by more than a linked pair's sets can; then the sets of the rest are compared:
    denominator * |a and b| >= numerator * |a or b|."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "n", "cells")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in (b.column(6), b.column(7)))
        n = b.column(4).to_numpy() + b.column(5).to_numpy()
        least = -(-numerator * n // (numerator + denominator))  # of the intersection
        ok = np.abs(x - y).sum(axis=1) <= n - 2 * least
        return b.select([0, 1, 2, 3]).filter(pa.array(ok))

    names = ["a", "b", "a_doc_id", "b_doc_id"]
    passed = common.kept(common.arrow_map(both.select(*names, "a_n", "b_n", "a_cells", "b_cells"), near, ", ".join(f"{c} long" for c in names)), "pairs")
    ends = passed.select(F.col("a").alias("node"), F.col("a_doc_id").alias("doc_id")).union(passed.select("b", "b_doc_id"))
    sets = common.kept(sets_of(docs, common.kept(ends.distinct(), "pair-nodes"), k), "pair-sets")
    full = passed.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for p, q in zip(b.column(2), b.column(3), strict=True):
            u, v = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            ok.append(denominator * both >= numerator * (len(u) + len(v) - both))
        out = b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        return pa.RecordBatch.from_arrays(out.columns, names=["a", "b"])

    return common.arrow_map(full.select("a_doc_id", "b_doc_id", "x", "y"), check, "a long, b long")


def _cells(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of nodes of different classes within the cells of long lists.

    rows: (token, i, j, block, node, n, pos, class), at most about 2 * `CELL_ROWS` a cell."""
    ordered = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pairs(t: pa.RecordBatch | pa.Table) -> pa.RecordBatch | None:
        """All cells of the table at once: every row with the next, the next but one, ..."""
        token, i, j, block, node, n, pos, cls = (t.column(c).to_numpy() for c in ("token", "i", "j", "block", "node", "n", "pos", "class"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cut = np.append(np.flatnonzero(new), len(token))
        end = np.repeat(cut[1:], np.diff(cut))
        across = i != j
        a, b = [], []
        x = np.arange(len(token))
        for step in range(1, int(np.diff(cut).max())):
            x = x[x + step < end[x]]
            y = x + step
            ok = cls[x] != cls[y]
            ok &= ~across[x] | (block[x] != block[y])
            n_x, n_y = n[x], n[y]
            need = -(-numerator * (n_x + n_y) // (numerator + denominator))
            ok &= np.minimum(n_x - pos[x], n_y - pos[y]) >= need
            ok &= denominator * np.minimum(n_x, n_y) >= numerator * np.maximum(n_x, n_y)
            a.append(node[x[ok]])
            b.append(node[y[ok]])
        if not a:
            return None
        pair = np.stack([np.minimum(np.concatenate(a), np.concatenate(b)), np.maximum(np.concatenate(a), np.concatenate(b))], axis=1)
        pair = np.unique(pair, axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])}) if len(pair) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | pa.Table | None = None  # the last cell, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            ks = np.stack([t.column(c).to_numpy() for c in range(3)], axis=1)
            last = int(np.flatnonzero((ks != ks[-1]).any(axis=1)).max(initial=-1)) + 1
            if last and (out := pairs(t.slice(0, last))) is not None:
                yield out
            held = t.slice(last)
        if held is not None and (out := pairs(held)) is not None:
            yield out

    return ordered.select("token", "i", "j", "block", "node", "n", "pos", "class").mapInArrow(run, "a long, b long").distinct()


#: Rows of one posting list that are compared with one another in one piece of work; a
#: longer list becomes blocks, and every pair of blocks a piece of its own.
CELL_ROWS = 2048
ROUNDS = 5


def linked(postings: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(id, component) of all nodes with a link, by smallest doc_id.

    postings: (token, doc, node, n, pos), doc a row of the node; nodes that may be linked
    share a token.  First each node is compared with the first document of its lists, and
    what links becomes classes; further rounds take other centres, as long as a list of
    several classes is longer than `CELL_ROWS`.  Then all pairs of different classes in a
    list are compared; a group of thousands of copies is one class by then and makes no
    pairs.  No list is cut."""
    rows = kept_rows = common.kept(star_pairs(postings, ["token"], ["doc", "node"]), "postings")
    n, m = F.col("n"), F.col("first_n")
    need = F.ceil(F.lit(numerator) * (n + m) / F.lit(numerator + denominator))
    likely = (F.col("node") != F.col("first_node")) & (F.least(n - F.col("pos"), m - F.col("first_pos")) >= need) & (F.least(n, m) * denominator >= F.greatest(n, m) * numerator)
    pair = [F.least("node", "first_node").alias("a"), F.greatest("node", "first_node").alias("b")]
    links = common.kept(verified(rows.where(likely).select(*pair).distinct(), nodes, docs, k, numerator, denominator), "links")
    for turn in range(ROUNDS):
        rows = rows.select("token", "node", "n", "pos")
        of = nodes.select("node", "doc_id").join(components(links).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("class"))
        rows = rows.join(of, "node")
        mixed = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token", "rows")
        last, rows = kept_rows, common.kept(rows.join(mixed, "token"), "class-postings")
        kept_rows = rows
        common.discard(last)
        longest = rows.agg(F.max("rows")).first()[0] or 0
        if longest <= CELL_ROWS or turn == ROUNDS - 1:
            break
        stars = star_pairs(rows.drop("rows"), ["token"], [F.xxhash64("token", "node", F.lit(turn))])
        stars = stars.where(likely & (F.col("class") != F.col("first_class")))
        links = links.unionByName(common.kept(verified(stars.select(*pair).distinct(), nodes, docs, k, numerator, denominator), "links"))
    blocks = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
    cells = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    more = verified(_cells(cells, numerator, denominator), nodes, docs, k, numerator, denominator)
    return components(links.unionByName(more))


#: Far more steps than the logarithm of any number of edges squared.
STEPS = 200


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b): the smallest id that links reach.

    Large-star and small-star steps (Kiveris and others, 2014) until the edges are stars:
    every id has one edge to a smaller one, and that one has none.  Every step is grouping
    by minimum and a join, so a hub is split like any skewed join."""
    edge = common.kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(STEPS):
        if _stars(edge):
            return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        # large star: larger neighbours of every id go to the smallest of its neighbourhood
        both = edge.union(edge.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the id itself, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, edge = edge, common.kept(small, "edges")
        common.discard(last)
    raise RuntimeError("components did not settle")


def _stars(edge: DataFrame) -> bool:
    """Whether every id of edges (u, v) has one v, and no v is a u."""
    n, ids = edge.agg(F.count("*"), F.count_distinct("u")).first()
    return n == ids and edge.join(edge.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()


def without(docs: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """docs, all columns, without the rows whose id is among drop (doc_id).

    A bounded bitmap of the dropped ids lets nearly all other rows pass where they are;
    rows that may be dropped are joined exactly.  Rows with a null id stay."""
    bitmap = docs.sparkSession.sparkContext.broadcast(wanted_filter(drop))
    at = docs.columns.index(id_col)

    def side(hit: bool):
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = b.column(at).cast(pa.int64())
            x = _bit(ids.fill_null(0).to_numpy(zero_copy_only=False))
            ok = (bitmap.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            return b.filter(pa.array(ok == hit))

        return common.arrow_map(docs, run, docs.schema)

    own = drop.select(F.col("doc_id").alias("_dropped")).distinct()
    return side(False).union(side(True).join(own, F.col(id_col) == F.col("_dropped"), "left_anti"))
