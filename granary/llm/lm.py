"""Language-model scores by a weighted backoff automaton, learnt from the corpus itself.

Tokens are words (A-Z folded) and one end a text.  With counts c of words, pairs and
triples in all training texts, a word w after the words u, v has

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = (c(v, w) + PAIR p(w)) / (c(v) + PAIR)
    p(w | u v) = (c(u, v, w) + TRIPLE p(w | v)) / (c(u, v) + TRIPLE)

(Dirichlet smoothing), each of which adds up to 1 over all known words and one unknown.
The first word of a text follows a start only.  These are a weighted automaton: a pair
(u, v) is a state whose arcs are the triples, each with the weight of its probability;
its failure arc, of weight TRIPLE / (c(u, v) + TRIPLE), leads to the state v, whose arcs
are the pairs; that one fails with PAIR / (c(v) + PAIR) to the root, whose arcs are the
words.  A text is read once from left to right; the automaton carries the state and adds
up log-probabilities.

The model grows with the corpus and is never in one place.  Texts are dealt into blocks
of a fixed size.  Words, pairs and triples are known by keys of `KEY_BITS`; a block asks, by
range of key, for those that it holds, giving its own training counts.  The owner of a
range adds up the counts of all blocks and answers each with just what it asked for; a
block builds the part of the automaton that its texts can reach and scores them.  Keys are
hashes of whole n-grams, so the pairs of a very frequent word are spread over all ranges.
A block sends at most one message a range and none to ranges of which it holds no key, so
messages never outnumber the distinct n-grams of the blocks.

Cases: a null or empty text is one end; a null doc_id is scored and never learnt from;
repeated rows are learnt and scored each; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common, links
from granary.llm import textkernel as K

BLOCK_BYTES = 8 << 20
#: Of n distinct n-grams a share of about n / 2**KEY_BITS has a key that another one has too.
KEY_BITS = 56
#: Weight of the shorter context in counts, chosen by folds of the training texts.
PAIR, TRIPLE = 400.0, 5.0
END, START = np.uint64(0xFFFFFFFFFFFFFFFE), np.uint64(0x0000000000000001)
_HEAD = struct.Struct("<QII")
_ZSTD = pa.Codec("zstd", compression_level=1)
_ONE = np.uint64(1)


def encoded(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane: high bytes of small ones cost nothing."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _ZSTD.compress(planes, asbytes=True)


def decoded(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


@dataclass
class Tokens:
    """A block's texts as places in its sorted distinct words, pairs and triples."""

    words: np.ndarray  # hashes; START and END are among them
    ids: np.ndarray  # word at each position
    off: np.ndarray  # positions of each text
    pairs: np.ndarray  # distinct codes of (word before, word)
    pair: np.ndarray  # each position's place among them
    triples: np.ndarray  # distinct codes of (pair before, word)
    triple: np.ndarray  # the place of each position that is not a text's first
    later: np.ndarray  # those positions

    @staticmethod
    def of(col) -> Tokens:
        h, w = K.words(col)
        n = len(w) - 1
        off = w + np.arange(n + 1)
        full = np.empty(len(h) + n, np.uint64)
        ends = off[1:] - 1
        own = np.ones(len(full), bool)
        own[ends] = False
        full[own], full[ends] = h, END
        words, ids = np.unique(np.append(full, START), return_inverse=True)
        start, ids = ids[-1], ids[:-1]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[off[:-1]] = start
        pairs, pair = np.unique(before * np.int64(len(words)) + ids, return_inverse=True)
        first = np.zeros(len(ids), bool)
        first[off[:-1]] = True
        later = np.flatnonzero(~first)
        triples, triple = np.unique(pair[later - 1] * np.int64(len(words)) + ids[later], return_inverse=True)
        return Tokens(words, ids, off, pairs, pair, triples, triple, later)

    def keys(self) -> np.ndarray:
        """Keys of words, pairs and triples, in this order.  Those of words are odd, all others even."""
        n = len(self.words)
        word = K.mix64(self.words)
        pair = K.mix64(word[self.pairs // n] * np.uint64(0x9E3779B97F4A7C15) + word[self.pairs % n])
        triple = K.mix64(pair[self.triples // n] * np.uint64(0xC2B2AE3D27D4EB4F) + word[self.triples % n])
        cut = np.uint64(64 - KEY_BITS)
        return np.concatenate([word >> cut | _ONE, pair >> cut & ~_ONE, triple >> cut & ~_ONE])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often the texts with train have each, in order of `keys`; the start is no token."""
        used = np.repeat(train, np.diff(self.off))
        own = lambda at, of, size: np.bincount(at[used[of]], minlength=size)
        every = np.arange(len(self.ids))
        return np.concatenate([own(self.ids, every, len(self.words)), own(self.pair, every, len(self.pairs)), own(self.triple, self.later, len(self.triples))])


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of sorted keys by range."""
    edge = np.array([(i << KEY_BITS) // n for i in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def request(col, train: np.ndarray, n_ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, what a block asks for there, with its training counts)."""
    t = Tokens.of(col)
    keys = t.keys()
    order = np.argsort(keys)
    keys, count = keys[order], t.counts(train)[order]
    cuts = _cuts(keys, n_ranges)
    for r in range(n_ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            steps, own = encoded(np.diff(keys[a:b], prepend=np.uint64(0))), encoded(count[a:b])
            yield r, b"".join([_HEAD.pack(b - a, len(steps), len(own)), steps, own])


def _parsed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, m = _HEAD.unpack_from(data)
    at = _HEAD.size
    return np.cumsum(decoded(data[at : at + k], n), dtype=np.uint64), decoded(data[at + k : at + k + m], n)


def answer(requests: list[bytes]) -> tuple[list[bytes], int, int]:
    """Counts of what each request of a range asks for; its training tokens and distinct words."""
    parts = [_parsed(x) for x in requests]
    keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(which, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    out, i = [], 0
    for p in parts:
        own = encoded(count[which[i : i + len(p[0])]])
        out.append(_HEAD.pack(len(p[0]), len(own), 0) + own)
        i += len(p[0])
    words = count[(keys & _ONE).astype(bool)]
    return out, int(words.sum()), int((words > 0).sum())


@dataclass
class Automaton:
    """States are pairs of words, single words, and the root.

    A pair's arcs are `triples`, codes of (pair, word), with their weights and the pairs they
    lead to.  A pair fails to its second word, whose arcs are `pairs`, codes of (word, word),
    and lead to themselves; a word fails to the root, which has an arc for each word."""

    n_words: int
    codes: np.ndarray  # sorted codes of all pairs, which number the states
    triples: np.ndarray
    triple_weights: np.ndarray
    triple_to: np.ndarray
    pair_weights: np.ndarray  # of every pair, NaN where it is no arc
    pair_fail: np.ndarray
    word_fail: np.ndarray
    root: np.ndarray

    def score(self, ids: np.ndarray, off: np.ndarray, start: int) -> np.ndarray:
        """Log10 probability of each sequence ids[off[i]:off[i + 1]].  All sequences are read
        in step, each carrying its own state."""
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        alive = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), side="right")
        first, total = off[:-1][order], np.zeros(len(order))
        word, pair = np.full(len(order), start, np.int64), None
        for t, m in enumerate(alive.tolist()):
            last, now = word[:m], ids[first[:m] + t]
            step, reached = np.empty(m), np.empty(m, np.int64)
            left = slice(None)  # texts whose state has no arc for the word
            if pair is not None and len(self.triples):
                code = pair[:m] * self.n_words + now
                at = np.searchsorted(self.triples, code)
                at[at == len(self.triples)] = 0
                hit = self.triples[at] == code
                step[hit], reached[hit] = self.triple_weights[at[hit]], self.triple_to[at[hit]]
                left = np.flatnonzero(~hit)
            u, w = last[left], now[left]
            if len(w):  # the failure arc to the state of the last word, and from there to the root
                to = np.searchsorted(self.codes, u * self.n_words + w)
                more = self.pair_weights[to]
                none = np.isnan(more)
                more[none] = self.word_fail[u[none]] + self.root[w[none]]
                step[left] = more if pair is None else more + self.pair_fail[pair[:m][left]]
                reached[left] = to
            total[:m] += step
            word, pair = now, reached
        out = np.empty(len(order))
        out[order] = total
        return out


def automaton(t: Tokens, count: np.ndarray, n_train: int, v_train: int) -> Automaton:
    """What a block's texts can reach, from the counts of its keys."""
    n, p, start, end = len(t.words), len(t.pairs), np.searchsorted(t.words, START), np.searchsorted(t.words, END)
    of_word, of_pair, of_triple = (x.astype(np.float64) for x in np.split(count, [n, n + p]))
    root = (of_word + 0.5) / (n_train + 0.5 * (v_train + 1))
    context = of_word.copy()
    context[start] = of_word[end]  # as many starts as ends
    last, now = t.pairs // n, t.pairs % n
    pair = (of_pair + PAIR * root[now]) / (context[last] + PAIR)
    before = t.triples // n
    to = np.empty(len(t.triples), np.int64)
    to[t.triple] = t.pair[t.later]
    triple = (of_triple + TRIPLE * pair[to]) / (of_pair[before] + TRIPLE)
    arc = of_triple > 0
    return Automaton(n, t.pairs, t.triples[arc], np.log10(triple[arc]), to[arc], np.where(of_pair > 0, np.log10(pair), np.nan), np.log10(TRIPLE / (of_pair + TRIPLE)), np.log10(PAIR / (context + PAIR)), np.log10(root))


def score(col, answers: list[bytes], n_train: int, v_train: int) -> dict[str, np.ndarray]:
    """Scores of a block's texts from the answers to its requests, in order of range."""
    t = Tokens.of(col)
    found = []
    for data in answers:
        n, k, _ = _HEAD.unpack_from(data)
        found.append(decoded(data[_HEAD.size : _HEAD.size + k], n))
    keys = t.keys()
    count = np.empty(len(keys), np.int64)
    count[np.argsort(keys)] = np.concatenate(found)
    a = automaton(t, count, n_train, v_train)
    per = lambda x: np.add.reduceat(x, t.off[:-1])  # noqa: E731  every text has its end
    return {"n_tokens": np.diff(t.off), "n_known": per((count[t.ids] > 0).astype(np.int64)), "base_score": per(a.root[t.ids]), "score": a.score(t.ids, t.off, int(np.searchsorted(t.words, START)))}


_PACK = "block int, pack binary"


def _packed(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Rows by block, many to a compressed pack, so texts move through the shuffle small."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.sort_by("block")
            b = t.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            packs = [_write(t.slice(i, j - i).drop_columns("block")) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(b[cuts[:-1]], pa.int32()), "pack": links.binary(packs)})

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > BLOCK_BYTES * 4:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.select(block.alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "train").mapInArrow(run, _PACK)


def _write(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(packs) -> pa.Table:
    parts = [pa.ipc.open_stream(x.as_py()).read_all() for x in packs]
    t = pa.concat_tables(parts)
    return t.set_column(t.column_names.index("text"), "text", t.column("text").cast(pa.large_string())).combine_chunks()


def scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learnt
    from the rows where the column expression `train` holds."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n = max(1, -(-common.text_bytes(rows) // BLOCK_BYTES))

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own = _unpacked(t.column("pack"))
        found = list(request(own.column("text"), own.column("train").to_numpy(), n))
        return pa.table({"range": pa.array([r for r, _ in found], pa.int32()), "block": pa.array([key[0].as_py()] * len(found), pa.int32()), "request": links.binary([x for _, x in found])})

    def own_range(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out, tokens, distinct = answer([x.as_py() for x in t.column("request")])
        return pa.table({"range": t.column("range"), "block": t.column("block"), "answer": links.binary(out), "tokens": pa.array([tokens] * len(out), pa.int64()), "words": pa.array([distinct] * len(out), pa.int64())})

    packs = _packed(rows, n)
    asked = packs.groupBy("block").applyInArrow(ask, "range int, block int, request binary")
    answered = common.kept(asked.groupBy("range").applyInArrow(own_range, "range int, block int, answer binary, tokens long, words long"), "lm-answers")
    total = answered.groupBy("range").agg(F.first("tokens").alias("tokens"), F.first("words").alias("words")).agg(F.sum("tokens"), F.sum("words")).first()
    n_train, v_train = total[0] or 0, total[1] or 0

    def read(key: tuple[pa.Scalar, ...], t: pa.Table, answers: pa.Table) -> pa.Table:
        own = _unpacked(t.column("pack"))
        out = score(own.column("text"), [x.as_py() for x in answers.sort_by("range").column("answer")], n_train, v_train)
        return pa.table({
            "doc_id": own.column("doc_id"),
            "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array(np.full(len(own), n_train), pa.int64()),
            "base_score": pa.array(out["base_score"]),
            "score": pa.array(out["score"])
        })

    kind = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.groupBy("block").cogroup(answered.select("block", "range", "answer").groupBy("block")).applyInArrow(read, kind)


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from four fifths of them."""
    docs = common.documents(spark, sf_dir)
    held = F.coalesce(common.remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    out = scores(docs, common.remainder(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
